"""SentencePiece encoding by suffix-array matching, and decoding.

A batch sets its distinct pre-tokens end to end and builds their suffix array. Every piece of the vocabulary is binary
searched for its range of occurrences; the occurrences are edges of a graph over text positions, sorted by position and
relaxed in that order. The model is a merge model, so relaxing asks whether the best path to an edge's start may be
followed by the edge's piece: two pieces may stand side by side if no merge over their border comes first. Each position
then has one last piece, and the path back from the end is the encoding.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proselens.llm.common import table
from proselens.llm.pretokens import MARK, cut
from proselens.llm.suffix_dedup import suffix_array
from proselens.llm.token_counts import library

UNKNOWN, START = -1, -2
LATE = np.int64(1) << 40


class Pieces:
    """The vocabulary as tables. rank: order of merging; left, right: the last merge of a piece (-1 for characters)."""

    def __init__(self, model: str):
        sp = library(model)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: sp.get_score(i) for i in plain}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        runs = {t for t in self.id if len(t) > 1 and not t.strip(MARK)}
        order = sorted((t for t in self.id if len(t) > 1 and t not in runs), key=lambda t: -self.score[t])
        self.rank = np.full(n + 2, -1, np.int64)  # characters, unknown and start are there before any merge
        for k, t in enumerate(order):
            self.rank[self.id[t]] = k
        self.left, self.right = np.full(n + 2, -1, np.int64), np.full(n + 2, -1, np.int64)
        self.pieces: list[str] = [t for t in self.id if len(t) == 1]
        for t in order:
            last = self.merge(list(t), keep=True)
            if last and "".join(last) == t:
                self.left[self.id[t]], self.right[self.id[t]] = self.id[last[0]], self.id[last[1]]
                self.pieces.append(t)
        keys, made = [], []
        for t in order:
            for k in range(1, len(t)):
                if t[:k] in self.id and t[k:] in self.id:
                    keys.append(self.id[t[:k]] * n + self.id[t[k:]])
                    made.append(self.rank[self.id[t]])
        by = np.argsort(keys)
        self.n, self.keys, self.made = n, np.array(keys)[by], np.array(made)[by]
        # Longest-first binary search needs the pieces' bytes.
        self.raw = sorted((t.encode(), self.id[t]) for t in self.pieces)
        self.longest = max(len(b) for b, _ in self.raw)
        short = [(b, i) for b, i in self.raw if len(b) <= 8]
        self.low = np.array([int.from_bytes(b.ljust(8, b"\0"), "big") for b, _ in short], np.uint64)
        self.high = np.array([int.from_bytes(b.ljust(8, b"\xff"), "big") for b, _ in short], np.uint64)
        self.short = [(i, len(b)) for b, i in short]
        self.long = [(b, i) for b, i in self.raw if len(b) > 8]
        self.lead = np.array([int.from_bytes(b[:8], "big") for b, _ in self.long], np.uint64)
        self.out = [b"" if sp.is_control(i) else bytes([int(t[3:5], 16)]) if sp.is_byte(i) else t.replace(MARK, " ").encode() for i, t in enumerate(self.text)]
        self.out[sp.unk_id()] = " ⁇ ".encode()
        self.runs: dict[int, list[int]] = {}

    def merge(self, symbols: list[str], keep: bool = False) -> list[str] | None:
        """Plain merging: best score first, then leftmost. keep: the two parts of the last merge, if all become one."""
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list = []

        def push(i: int, j: int) -> None:
            both = symbols[i] + symbols[j]
            if both in self.id:
                heapq.heappush(heap, (-self.score[both], i, j, symbols[i], symbols[j]))

        for i in range(n - 1):
            push(i, i + 1)
        last = None
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if symbols[i] != a or symbols[j] != b or after[i] != j:
                continue
            last = [a, b]
            symbols[i], symbols[j] = a + b, ""
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        left = [s for s in symbols if s]
        return (last if len(left) == 1 else None) if keep else left

    def marks(self, n: int) -> list[int]:
        """Encoding of n word marks in a row."""
        if n not in self.runs:
            self.runs[n] = [self.id[s] for s in self.merge([MARK] * n)]
        return self.runs[n]

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b may stand after piece a: no merge over the border comes before those that make a and b.

        Undo, from the whole pieces down, the later of the two border symbols (the right one if equal: of equal merges
        the left comes first). While x and y stand at the border, their merge would come first if it beats the merges
        that take x and y away: strictly on the left, where an equal one is further left, and at a tie on the right.
        """
        ok = np.ones(len(a), bool)
        x, y = a.copy(), b.copy()
        take_x, take_y = np.full(len(a), LATE), np.full(len(a), LATE)
        live = np.flatnonzero((x >= 0) & (y >= 0))
        while len(live):
            key = x[live] * self.n + y[live]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            made = np.where(self.keys[at] == key, self.made[at], LATE)
            bad = (made < take_x[live]) & (made <= take_y[live])
            ok[live[bad]] = False
            live = live[~bad]
            rx, ry = self.rank[x[live]], self.rank[y[live]]
            going = (rx >= 0) | (ry >= 0)
            live, rx, ry = live[going], rx[going], ry[going]
            left = rx > ry
            i, j = live[left], live[~left]
            take_x[i] = rx[left]
            x[i] = self.right[x[i]]
            take_y[j] = ry[~left]
            y[j] = self.left[y[j]]
        return ok

    def encode(self, words: list[str]) -> list[list[int]]:
        flat, n = self.coded(words)
        return [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]

    def coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words without newlines, none of which is empty or starts with two marks: all ids end to end,
        and how many each word has."""
        data = "\n".join(words).encode() + b"\n"
        raw = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero(raw == 10)
        begin = np.concatenate([[0], ends[:-1] + 1])
        sa = suffix_array(raw, self.longest)
        padded = np.concatenate([raw, np.zeros(self.longest + 8, np.uint8)])
        word = padded[: len(data) + self.longest].astype(np.uint64)
        for s in (1, 2, 4):
            word = (word[:-s] << np.uint64(8 * s)) | word[s:]
        lead = word[sa]
        ranges = [np.searchsorted(lead, self.low), np.searchsorted(lead, self.high, "right")]
        ids, sizes = [i for i, _ in self.short], [n for _, n in self.short]
        froms, tos = [ranges[0]], [ranges[1]]
        firsts, lasts = np.searchsorted(lead, self.lead), np.searchsorted(lead, self.lead, "right")
        for j in np.flatnonzero(firsts < lasts).tolist():  # beyond 8 bytes, search on inside the range
            (b, i), x, y = self.long[j], int(firsts[j]), int(lasts[j])
            for o in range(8, len(b), 8):
                if x == y:
                    break
                c = b[o : o + 8]
                part = word[sa[x:y] + o]
                y = x + int(np.searchsorted(part, np.uint64(int.from_bytes(c.ljust(8, b"\xff"), "big")), "right"))
                x = x + int(np.searchsorted(part, np.uint64(int.from_bytes(c.ljust(8, b"\0"), "big"))))
            if x < y:
                froms.append([x])
                tos.append([y])
                ids.append(i)
                sizes.append(len(b))
        x, y = np.concatenate(froms), np.concatenate(tos)
        n = y - x
        start = sa[np.repeat(x - np.cumsum(n) + n, n) + np.arange(n.sum())]
        piece, size = np.repeat(np.array(ids), n), np.repeat(np.array(sizes), n)
        # A character that is no piece is an edge of its own.
        heads = np.flatnonzero((raw & 0xC0) != 0x80)
        known = np.zeros(len(raw), bool)
        known[start[self.rank[piece] < 0]] = True
        odd = heads[~known[heads] & (raw[heads] != 10)]
        width = np.diff(np.append(heads, len(raw)))[np.searchsorted(heads, odd)]
        start, piece, size = np.concatenate([start, odd]), np.concatenate([piece, np.full(len(odd), UNKNOWN)]), np.concatenate([size, width])
        place = start - np.repeat(begin, ends + 1 - begin)[start]
        order = np.argsort(place, kind="stable")
        start, piece, size, place = start[order], piece[order], size[order], place[order]
        last, back = np.full(len(raw) + 1, -3, np.int64), np.zeros(len(raw) + 1, np.int64)
        # last[p]: the last piece of the encoding of the word's part before p; a word's begin shares its place with no end.
        last[begin] = START
        cuts = np.flatnonzero(np.diff(place, prepend=-1, append=-1)).tolist()
        for a, b in zip(cuts[:-1], cuts[1:]):
            s, p, z = start[a:b], piece[a:b], size[a:b]
            prior = last[s]
            reached = prior != -3
            s, p, z, prior = s[reached], p[reached], z[reached], prior[reached]
            fits = self.may_follow(prior, p)
            s, p, z = s[fits], p[fits], z[fits]
            last[s + z] = p
            back[s + z] = s
        # Back from the words' ends; a token is noted where it starts, an unknown character's bytes where they stand.
        token, has, at, who = np.full(len(raw), -1, np.int32), np.zeros(len(words), np.int64), ends.copy(), np.arange(len(words))
        while len(at):
            s, t = back[at], last[at]
            known, odd = t != UNKNOWN, np.flatnonzero(t == UNKNOWN)
            token[s[known]] = t[known]
            np.add.at(has, who[known], 1)
            for w, x, y in zip(who[odd].tolist(), s[odd].tolist(), at[odd].tolist()):
                token[x:y] = [self.byte[c] for c in data[x:y]]
                has[w] += y - x
            going = s != begin[who]
            at, who = s[going], who[going]
        return token[token >= 0], has

    def coded_pretokens(self, words: list[str], batch: int = 256 << 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of any distinct pre-tokens, as one array, and where in it each one's start and how many they are.

        Marks before the last one merge among themselves after all else has merged. Pre-tokens are independent, so they
        are indexed in batches of about `batch` characters: the edges take some hundreds of bytes a byte of text. A
        longer pre-token is a batch of its own.
        """
        plain = [w for w in words if w[0] != "\n" and (w[0] != MARK or (len(w) > 1 and w[1] != MARK))]
        at = dict(zip(plain, range(len(plain)))) if len(plain) < len(words) else {}
        odd = []  # newlines, and marks before a mark
        for k, w in enumerate(words if at or not plain else ()):
            if w not in at:
                rest = w.lstrip(MARK)
                odd.append((k, w, len(w) - len(rest), at.setdefault(MARK + rest, len(at)) if rest and w[0] != "\n" else -1))
        core = list(at) if odd else plain
        filled = np.cumsum(np.fromiter(map(len, core), np.int64, len(core))) if core else np.zeros(0, np.int64)
        flats, counts, x = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        while x < len(core):
            y = max(x + 1, int(np.searchsorted(filled, (filled[x - 1] if x else 0) + batch)))
            flat, n = self.coded(core[x:y])
            flats.append(flat)
            counts.append(n)
            x = y
        flat, n = np.concatenate(flats), np.concatenate(counts)
        start = np.cumsum(n) - n
        if not odd:
            return flat, start, n
        more, total = [], len(flat)
        starts, sizes = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        is_odd = np.zeros(len(words), bool)
        for k, w, marks, c in odd:
            if c < 0:
                ids = self.marks(marks) if marks else self.byte[10:11] * len(w)
            else:
                rest = flat[start[c] : start[c] + n[c]].tolist()
                ids = self.marks(marks) + rest[1:] if rest[0] == self.id.get(MARK) else self.marks(marks - 1) + rest
            is_odd[k], starts[k], sizes[k] = True, total, len(ids)
            total += len(ids)
            more.extend(ids)
        starts[~is_odd], sizes[~is_odd] = start[: len(plain)], n[: len(plain)]
        return np.concatenate([flat, np.array(more, np.int32)]), starts, sizes

    def encode_pretokens(self, words: list[str], batch: int = 512 << 10) -> list[list[int]]:
        flat, start, n = self.coded_pretokens(words, batch)
        return [flat[a : a + k].tolist() for a, k in zip(start.tolist(), n.tolist())]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes of the pieces, without the space that encoding puts first."""
        return b"".join([self.out[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


@lru_cache(2)
def tables(model: str) -> Pieces:
    return Pieces(model)


class Memo:
    """Numbers of pre-tokens and their ids, end to end. Cleared when it holds `most` pre-tokens, so that it stays small."""

    def __init__(self, pieces: Pieces, most: int):
        self.pieces, self.most = pieces, most
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.flat, self.start, self.n = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.numbers]
        if self.numbers and len(self.numbers) + len(new) > self.most:
            self.clear()
            new = list(dict.fromkeys(words))
        if new:
            flat, start, n = self.pieces.coded_pretokens(new)
            self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new))))
            self.start = np.concatenate([self.start, start + len(self.flat)])
            self.n = np.concatenate([self.n, n])
            self.flat = np.concatenate([self.flat, flat])

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids end to end, and where each word's end."""
        self.learn(words)
        at = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        start, n = self.start[at], self.n[at]
        ends = np.cumsum(n)
        return self.flat[np.repeat(start - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)], ends


def encode(docs: DataFrame, model: str, most: int = 1 << 20, memo: int = 400_000) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, decoded) of each row of docs(doc_id, text); other columns are left out.

    A task takes its rows in batches of about `most` characters, indexes the pre-tokens that it hasn't met, and keeps
    their ids (of `memo` pre-tokens at most); nothing is shuffled, so a lost task runs again by itself. A null or empty
    text has no ids and decodes to the empty text; doc_id keeps its type and may be null or repeat. decoded is what the
    ids give back: the text, but for the word mark itself, which the model can't tell from a space.
    """
    kind = docs.schema["doc_id"].dataType
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches):
        p = tables(model)
        known = Memo(p, memo)

        def coded(ids: pa.Array, texts: list) -> pa.RecordBatch:
            rows = [cut(t) for t in texts]
            flat, ends = known.ids([w for r in rows for w in r])
            places = np.concatenate([[0], ends])[np.cumsum([0, *map(len, rows)])]
            codes = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(flat, pa.int32()))
            back = [p.decode(flat[a:b].tolist()) for a, b in zip(places[:-1].tolist(), places[1:].tolist())]
            return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(places), pa.int64()), codes, pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

        for b in batches:
            at, some, n = 0, [], 0
            for k, t in enumerate(b.column(1)):
                some.append(t.as_py())
                n += len(some[-1] or "")
                if n >= most or k == b.num_rows - 1:
                    yield coded(b.column(0).slice(at, len(some)), some)
                    at, some, n = k + 1, [], 0

    return docs.select("doc_id", "text").mapInArrow(run, out)


def decode(coded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """coded with text: what the ids give back. Null ids give null; a column of coded called text is replaced."""
    own = [f for f in coded.schema.fields if f.name != "text"]

    def run(batches):
        p = tables(model)
        for b in batches:
            texts = [None if x is None else p.decode(x) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "text"])

    return coded.select(*[f.name for f in own]).mapInArrow(run, T.StructType([*own, T.StructField("text", T.StringType())]))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids under piece_bpe_32k.model and the digest of the text decoded from them."""
    out = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
