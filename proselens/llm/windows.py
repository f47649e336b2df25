"""Windows of fixed length that occur in several documents, found exactly and without moving unique text.

Both exact substring operators run on this engine; they differ in the unit (words or bytes) and in how a bucket
decides which windows are equal.

1. Documents are dealt into blocks of bounded bytes by a hash of their id. A block hashes all k-grams, takes the
   minimum over each window, and announces its distinct minimisers, packed, to hash buckets.
2. A bucket answers each block with two bits a minimiser: does it occur in two or more documents, and is it hot? Equal
   windows have equal minimisers, so windows whose minimiser has no second document can't repeat, and their text never
   moves. Announced minimisers are cut to as many bits as the corpus needs; that two of them coincide moves more text
   than needed and changes nothing else.
3. Consecutive windows that share a minimiser form one packed string. A block sends each different string of shared
   minimisers once (with the smallest doc_id and the places where it stands) to the bucket of its minimiser. A passage
   in a third of all documents so gives one row a block, not one a document. The strings of a hot minimiser are cut into
   single windows, which go to the buckets of their own hashes.
4. The bucket hands all its different strings, in slices of whole minimisers and bounded bytes, to the operator's method,
   which groups equal windows exactly, and returns the covered places to the blocks.

The blocks' exchange of texts is the same subtree in all three steps, so Spark shuffles the texts once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proselens.llm.common import free_name, others, parts_for, text_bytes

#: Bytes of strings that a bucket hands to the operator's method at once, but for a minimiser that alone has more.
SLICE = 1 << 20
#: A minimiser with more strings than this, over all blocks, is hot.
HOT = 1 << 16
NO_ID = np.iinfo(np.int64).max
_SPAN = np.dtype([("row", "<i4"), ("start", "<i4"), ("end", "<i4")])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Units:
    """The texts of a block, end to end. Unit i is data[at[i]:to[i]]; document r has the units first[r]..first[r+1]."""

    data: bytes
    at: np.ndarray | None
    to: np.ndarray | None
    first: np.ndarray
    grams: np.ndarray

    def cut(self, a: int, b: int) -> bytes:
        """The packed string of units a..b (b excluded)."""
        return self.data[a:b] if self.at is None else self.data[self.at[a] : self.to[b - 1]]


def byte_units(texts: list[bytes], k: int = 16) -> Units:
    """Bytes as they are; k-grams are of 16 bytes."""
    data = b"".join(texts)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    if len(b) < k:
        return Units(data, None, None, first, np.zeros(0, np.uint64))
    for s in (1, 2, 4):
        b = b[:-s] | (b[s:] << np.uint64(8 * s))
    return Units(data, None, None, first, _mix(_mix(b[:-8]) + b[8:]))


def word_units(texts: list[bytes], k: int = 4) -> Units:
    """Words are cut at ASCII white space and stand one space apart in data."""
    joined = [b" ".join(t.split()) for t in texts]
    data = b" ".join(j for j in joined if j)
    n = np.array([j.count(b" ") + 1 if j else 0 for j in joined], np.int64)
    first = np.concatenate([[0], np.cumsum(n)])
    if not data:
        none = np.zeros(0, np.int64)
        return Units(data, none, none, first, np.zeros(0, np.uint64))
    raw = np.frombuffer(data, np.uint8)
    gaps = np.flatnonzero(raw == 32)
    at, to = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
    # A word's hash: differences of a running polynomial, moved back to exponent zero by the inverse of its base.
    power = np.full(len(raw), 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power)])
    back = np.full(len(raw), pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    word = _mix((run[to] - run[at]) * back[at])
    if len(word) < k:
        return Units(data, at, to, first, np.zeros(0, np.uint64))
    m = len(word) - k + 1
    gram = word[:m].copy()
    for j in range(1, k):
        gram = _mix(gram) + word[j : j + m]
    return Units(data, at, to, first, _mix(gram))


def minimisers(u: Units, size: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of windows of one document with the same minimiser: the minimiser, first window, number, row."""
    total, w = int(u.first[-1]), size - k + 1
    none = np.zeros(0, np.int64)
    if total < size:
        return np.zeros(0, np.uint64), none, none, none
    low, span = u.grams, 1
    while span * 2 <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if w > span:
        low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
    n = total - size + 1
    edge = np.zeros(n + 1, np.int8)
    begin, length = u.first[:-1], np.diff(u.first)
    rows = np.flatnonzero(length >= size)
    begin, length = begin[rows], length[rows]
    edge[begin] = 1
    cut = np.concatenate([[True], low[1:n] != low[: n - 1]])
    starts = np.flatnonzero(cut | (edge[:n] == 1))
    # Windows over the end of a document belong to no run.
    which = np.searchsorted(begin, starts, side="right") - 1
    last = begin + length - size
    ok = (which >= 0) & (starts <= last[np.maximum(which, 0)])
    ends = np.append(starts[1:], n)
    starts, ends, which = starts[ok], ends[ok], which[ok]
    ends = np.minimum(ends, last[which] + 1)
    # A minimum is small; mixing makes the keys even again, and each still stands for one hash.
    return _mix(low[starts]), starts, ends - starts, rows[which]


def _ordered(t: pa.Table, id_col: str, text_col: str) -> tuple[pa.Table, list[bytes], np.ndarray]:
    """Rows in an order that depends on their content alone, since shuffles deliver them in any order."""
    t = t.sort_by([(id_col, "ascending"), (text_col, "ascending")])
    texts = t.column(text_col).cast(pa.large_binary()).to_pylist()
    ids = t.column(id_col).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
    return t, [x or b"" for x in texts], ids


def _distinct(low: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in order; whether each occurs under two or more ids here; and how often it occurs."""
    order = np.argsort(low, kind="stable")
    s, d = low[order], ids[order]
    if not len(s):
        return s, np.zeros(0, bool), np.zeros(0, np.int64)
    heads = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[heads], np.minimum.reduceat(d, heads) != np.maximum.reduceat(d, heads), np.diff(np.append(heads, len(s)))


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, which compresses well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def squeeze(fields: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(3).compress(np.array([len(fields), *map(len, fields)], "<u8").tobytes() + b"".join(fields))


def unsqueeze(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    ends = (8 * n + 8 + np.cumsum(np.frombuffer(raw, "<u8", n, 8))).tolist()
    return [raw[a:b] for a, b in zip([8 * n + 8, *ends], ends)]


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket of 63-bit keys; never falls as the key grows, so sorted keys give sorted buckets."""
    return ((keys >> np.uint64(31)) * np.uint64(n)) >> np.uint64(32)


def spans_by_row(packed: list[bytes]) -> np.ndarray:
    s = np.frombuffer(b"".join(packed), _SPAN)
    return s[np.lexsort((s["start"], s["row"]))]


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in zip(spans["start"].tolist(), spans["end"].tolist()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(
    docs: DataFrame,
    units: Callable[..., Units],
    size: int,
    k: int,
    equal: Callable[[list[bytes], list[int], int], list[np.ndarray]],
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = 4 << 20,
    hot: int = HOT,
) -> DataFrame:
    """All columns of docs, and: n_units, n_removed, n_spans (long), kept (binary).

    Removed is each unit covered by a window of `size` units that also starts in a document with a smaller id, judged
    on the input. equal(payloads, docs, size) gets different packed strings with their smallest ids and returns for
    each an array: per window the smallest id that has it. A null id counts as larger than all; a null text as empty;
    rows with the same id don't remove each other's text. Columns of docs that are named like the four, in any case of
    letters, are replaced. A document stays whole in one block, however long it is.
    """
    block_col = free_name("block", docs)
    own = others(docs, "n_units", "n_removed", "n_spans", "kept")
    total = text_bytes(docs, text_col)
    n_blocks = parts_for(total, block_bytes)
    n_keys = parts_for(total, 16 * block_bytes)
    n_strings = parts_for(total, 2 * block_bytes)
    shift = np.uint64(max(0, 53 - total.bit_length()))  # of 63 bits, ten more than count the text's bytes are kept
    dealt = docs.select(F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))), F.lit(n_blocks)).alias(block_col), *own)

    def runs(t: pa.Table):
        t, texts, ids = _ordered(t, id_col, text_col)
        u = units(texts, k)
        low, start, count, row = minimisers(u, size, k)
        return u, ids, (low >> np.uint64(1) >> shift, start, count, row)

    def announce(key, t):
        u, ids, (low, _, _, row) = runs(t)
        keys, multi, often = _distinct(low, ids[row])
        b = _bucket(keys << shift, n_keys)
        heads = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
        sent = []
        for x, y in zip(heads, np.append(heads[1:], len(b))):
            many = np.flatnonzero(often[x:y] > 16)
            steps = np.diff(keys[x:y], prepend=np.uint64(0))
            sent.append(squeeze([_planes(steps), np.packbits(multi[x:y]).tobytes(), _planes(many.astype("<u4")), _planes(often[x:y][many].astype("<u8"))]))
        return pa.table({"bucket": pa.array(b[heads].astype(np.int64)), "block": pa.array([key[0].as_py()] * len(sent), pa.int64()), "keys": pa.array(sent, pa.binary())})

    def answer(key, t):
        got = [unsqueeze(x) for x in t.column("keys").to_pylist()]
        keys = [np.cumsum(_numbers(x[0], "<u8"), dtype=np.uint64) for x in got]
        hashes, where, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        many, rows, at = np.zeros(len(hashes), bool), count.copy(), 0
        for x, y in zip(got, keys):
            here = where[at : at + len(y)]
            many[here[np.unpackbits(np.frombuffer(x[1], np.uint8), count=len(y)).astype(bool)]] = True
            np.add.at(rows, here[_numbers(x[2], "<u4")], _numbers(x[3], "<u8").astype(np.int64))
            at += len(y)
        bits = [np.split(x[where], np.cumsum([len(y) for y in keys])[:-1]) for x in ((count > 1) | many, rows > hot)]
        return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "bits": pa.array([np.packbits(np.concatenate(x)).tobytes() for x in zip(*bits)], pa.binary()), "n": pa.array([len(x) for x in keys], pa.int64())})

    sent_schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])

    def strings(key, t, answers):
        """One row for each bucket: its strings end to end, and where each stands."""
        empty = sent_schema.empty_table()
        if not t.num_rows or not answers.num_rows:
            return empty
        u, ids, (low, start, count, row) = runs(t)
        keys, _, _ = _distinct(low, ids[row])
        answers = answers.sort_by("bucket")
        both = [np.unpackbits(np.frombuffer(b, np.uint8), count=2 * n).reshape(2, n).astype(bool) for b, n in zip(answers.column("bits").to_pylist(), answers.column("n").to_pylist())]
        shared, heavy = np.concatenate(both, axis=1)
        at = np.searchsorted(keys, low)
        low = low << shift
        one = np.flatnonzero(shared[at] & heavy[at])
        if len(one):  # single windows, each by its own hash
            a = np.repeat(start[one] - np.cumsum(count[one]) + count[one], count[one]) + np.arange(count[one].sum())
            own_key = np.fromiter((xxhash.xxh64_intdigest(u.cut(i, i + size)) >> 1 for i in a.tolist()), np.uint64, len(a))
            more = own_key, a, np.ones(len(a), np.int64), np.repeat(row[one], count[one])
        take = np.flatnonzero(shared[at] & ~heavy[at])
        low, start, count, row = low[take], start[take], count[take], row[take]
        if len(one):
            low, start, count, row = (np.concatenate(x) for x in zip((low, start, count, row), more))
        # Windows in order of bucket and minimiser, so that each bucket's strings are one slice.
        order = np.argsort(low, kind="stable")
        low, start, count, row = low[order], start[order], count[order], row[order]
        found: dict[bytes, int] = {}
        places, kept = np.empty(len(low), np.int64), []
        for i, (a, c) in enumerate(zip(start.tolist(), count.tolist())):
            j = places[i] = found.setdefault(u.cut(a, a + c + size - 1), len(found))
            if j == len(kept):
                kept.append(i)
        if not kept:
            return empty
        order = np.argsort(places, kind="stable")
        heads = np.append(np.searchsorted(places[order], np.arange(len(kept))), len(order))
        row, start = row[order], start[order]
        lows, texts = low[kept], list(found)
        bucket = _bucket(lows, n_strings).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])).tolist()
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            x, y = heads[a], heads[b]
            occ = row[x:y], start[x:y] - u.first[row[x:y]], ids[row[x:y]]
            numbers = [np.diff(lows[a:b], prepend=np.uint64(0)), np.array([len(x) for x in texts[a:b]], "<u4"), np.diff(heads[a : b + 1]).astype("<u4"), occ[0].astype("<u4"), occ[1].astype("<u4"), occ[2].astype("<i8")]
            rows.append((bucket[a], key[0].as_py(), squeeze([*map(_planes, numbers), b"".join(texts[a:b])])))
        return pa.table([pa.array(c, kind) for c, kind in zip(zip(*rows), sent_schema.types)], schema=sent_schema)

    def judge(key, t):
        got = [unsqueeze(x) for x in t.column("data").to_pylist()]
        lows = np.concatenate([np.cumsum(_numbers(x[0], "<u8"), dtype=np.uint64) for x in got])
        counts, row, start, doc = (np.concatenate([_numbers(x[i], k) for x in got]).astype(np.int64) for i, k in ((2, "<u4"), (3, "<u4"), (4, "<u4"), (5, "<i8")))
        block = np.repeat(t.column("block").to_numpy(), [len(x[3]) // 4 for x in got])
        texts: list[bytes] = []
        for x in got:
            ends = np.cumsum(_numbers(x[1], "<u4"), dtype=np.int64).tolist()
            texts.extend(x[6][a:b] for a, b in zip([0, *ends], ends))
        del got
        heads = np.cumsum(counts) - counts
        least = np.minimum.reduceat(doc, heads)
        order = np.argsort(lows, kind="stable")
        ends = np.flatnonzero(np.diff(lows[order], append=lows[order[-1]] + np.uint64(1)) != 0) + 1
        at, spans = 0, [np.zeros((0, 4), np.int64)]
        filled = np.cumsum([len(texts[i]) for i in order.tolist()])
        for end in ends.tolist():  # a slice ends with a minimiser
            if filled[end - 1] - (filled[at - 1] if at else 0) < SLICE and end < len(order):
                continue
            some, at = order[at:end], end
            strings: dict[bytes, int] = {}
            which = np.array([strings.setdefault(texts[i], len(strings)) for i in some.tolist()])
            first = np.full(len(strings), NO_ID)
            np.minimum.at(first, which, least[some])
            lowest = equal(list(strings), first.tolist(), size)
            long = np.array([len(x) + size - 1 for x in lowest])
            lowest_of, highest_of = np.array([x.min() for x in lowest]), np.array([x.max() for x in lowest])
            occ = np.repeat(heads[some] - np.cumsum(counts[some]) + counts[some], counts[some]) + np.arange(counts[some].sum())
            w = np.repeat(which, counts[some])
            whole = doc[occ] > highest_of[w]
            o = occ[whole]
            spans.append(np.stack([block[o], row[o], start[o], start[o] + long[w[whole]]], 1))
            part = ~whole & (doc[occ] > lowest_of[w])
            o, more = occ[part], []
            for j, d, b, r, s in zip(w[part].tolist(), doc[o].tolist(), block[o].tolist(), row[o].tolist(), start[o].tolist()):
                hit = np.flatnonzero(np.diff((lowest[j] < d).view(np.int8), prepend=0, append=0)).tolist()
                more.extend((b, r, s + x, s + y + size - 1) for x, y in zip(hit[::2], hit[1::2]))
            if more:
                spans.append(np.array(more, np.int64))
        spans = np.concatenate(spans)
        spans = spans[np.argsort(spans[:, 0], kind="stable")]
        cuts = np.flatnonzero(np.diff(spans[:, 0], prepend=-1, append=-1)).tolist() if len(spans) else [0]
        packed = np.empty(len(spans), _SPAN)
        packed["row"], packed["start"], packed["end"] = spans[:, 1], spans[:, 2], spans[:, 3]
        return pa.table({"block": pa.array([int(spans[a, 0]) for a in cuts[:-1]], pa.int64()), "spans": pa.array([packed[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())})

    kept_fields = [*[docs.schema[c] for c in own], T.StructField("n_units", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())]

    def cut(key, t, found):
        t, texts, _ = _ordered(t, id_col, text_col)
        n_units, n_removed, n_spans, kept = [], [], [], []
        spans = spans_by_row(found.column("spans").to_pylist())
        heads = np.searchsorted(spans["row"], np.arange(len(texts) + 1))
        for r, text in enumerate(texts):
            runs_ = merged(spans[heads[r] : heads[r + 1]])
            parts = text if units is byte_units else text.split()
            n_units.append(len(parts))
            n_removed.append(sum(b - a for a, b in runs_))
            n_spans.append(len(runs_))
            pieces, at = [], 0
            for a, b in [*runs_, (len(parts), len(parts))]:
                pieces.append(parts[at:a])
                at = b
            kept.append(b"".join(pieces) if units is byte_units else b" ".join(x for p in pieces for x in p))
        t = t.drop_columns([block_col])
        for name, values, kind in (("n_units", n_units, pa.int64()), ("n_removed", n_removed, pa.int64()), ("n_spans", n_spans, pa.int64()), ("kept", kept, pa.binary())):
            t = t.append_column(name, pa.array(values, kind))
        return t

    told = dealt.groupBy(block_col).applyInArrow(announce, "bucket long, block long, keys binary")
    told = told.groupBy("bucket").applyInArrow(answer, "block long, bucket long, bits binary, n long")
    sent = dealt.groupBy(block_col).cogroup(told.groupBy("block")).applyInArrow(strings, "bucket long, block long, data binary")
    found = sent.groupBy("bucket").applyInArrow(judge, "block long, spans binary")
    return dealt.groupBy(block_col).cogroup(found.groupBy("block")).applyInArrow(cut, T.StructType(kept_fields))
