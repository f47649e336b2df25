"""Benchmark decontamination by pigeonhole edit matching.

A test item may differ from a passage by a budget of e edits. Cut into e + 1 pieces, at least one piece of it stands
there unchanged, so every place is found by exact piece hits and verified with Myers' bit-parallel edit distance.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proselens.llm.common import table

HITS = "hits"
KIND = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("end", T.LongType())]))


def plain(text: str | None) -> str:
    """Lower case, runs of white space as one space."""
    return " ".join((text or "").lower().split())


def distance(item: str, text: str, most: int, masks: dict[str, int] | None = None) -> tuple[int, int] | None:
    """(smallest edit distance of item to any part of text, where that part ends), if at most `most`; ends first wins."""
    m = len(item)
    if masks is None:
        masks = {}
        for i, c in enumerate(item):
            masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, (most + 1, -1)
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full  # a part may begin anywhere: nothing is carried in
        pv = ((mh << 1) & full) | (~(xv | ph) & full)
        mv = ph & xv
        if score < best[0]:
            best = (score, j + 1)
            if not score:
                break
    return best if best[1] >= 0 else None


class Matcher:
    def __init__(self, items: tuple[tuple[int, str], ...], rate: float):
        self.items, self.auto = [], ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for number, (item, text) in enumerate(items):
            e = int(len(text) * rate)
            masks: dict[str, int] = {}
            for i, c in enumerate(text):
                masks[c] = masks.get(c, 0) | 1 << i
            self.items.append((item, text, e, masks))
            for k in range(e + 1):
                a, b = len(text) * k // (e + 1), len(text) * (k + 1) // (e + 1)
                pieces.setdefault(text[a:b], []).append((number, a))
        for p, where in pieces.items():
            self.auto.add_word(p, (len(p), where))
        self.auto.make_automaton()

    def find(self, text: str) -> list[dict]:
        """Per item that stands in the text within its budget: smallest distance, and where that place ends."""
        if not len(self.auto):
            return []
        places: dict[int, list[int]] = {}
        for end, (n, where) in self.auto.iter(text):
            for number, offset in where:
                places.setdefault(number, []).append(end + 1 - n - offset)
        out: dict[int, tuple[int, int]] = {}
        for number, starts in places.items():
            item, pattern, e, masks = self.items[number]
            starts.sort()
            best, i = None, 0
            while i < len(starts) and not (best and best[0] == 0):
                j = i
                while j + 1 < len(starts) and starts[j + 1] - starts[j] <= len(pattern):
                    j += 1
                a, b = max(0, starts[i] - e), starts[j] + len(pattern) + e
                at = text.find(pattern, a, b)
                got = (0, at + len(pattern)) if at >= 0 else None
                if got is None and e:
                    got = distance(pattern, text[a:b], e, masks)
                    got = got and (got[0], got[1] + a)
                if got and (best is None or got < best):
                    best = got
                i = j + 1
            if best and (item not in out or best < out[item]):
                out[item] = best
        return [{"item_id": i, "distance": d, "end": e} for i, (d, e) in sorted(out.items())]


@lru_cache(4)
def matcher(items: tuple[tuple[int, str], ...], rate: float) -> Matcher:
    return Matcher(items, rate)


def mark(docs: DataFrame, items: DataFrame, rate: float = 0.06, text: str = "text", block_chars: int = 4 << 20) -> DataFrame:
    """docs with hits: array of (item_id, distance, end), the items of items(item_id, text) that stand in the text within
    rate times their length of edits, both in lower case with single spaces.

    Items go out in blocks of bounded size, each against all documents, so neither side is joined or collected whole.
    Null and empty texts have no hits; null or empty items and null item ids are left out; of equal ids the closest
    counts. A column of docs called hits is replaced.
    """
    own = [f for f in docs.schema.fields if f.name != HITS]
    kind = T.StructType([*own, T.StructField(HITS, KIND)])
    out, block, chars = docs.select(*[f.name for f in own], F.array().cast(KIND).alias(HITS)), [], 0

    def with_block(df: DataFrame, some: tuple) -> DataFrame:
        def run(batches):
            m = matcher(some, rate)
            for b in batches:
                old = b.column(HITS).to_pylist()
                new = [x + m.find(plain(t)) for x, t in zip(old, b.column(text).to_pylist())]
                at = b.schema.get_field_index(HITS)
                yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

        return df.mapInArrow(run, kind)

    for r in items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text").toLocalIterator():
        t = plain(r["text"])
        if t:
            block.append((r["item_id"], t))
            chars += len(t)
        if chars >= block_chars:
            out, block, chars = with_block(out, tuple(block)), [], 0
    return with_block(out, tuple(block)) if block else out


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, distance) of every document and item of benchmark that stands in it."""
    hits = mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", F.explode(HITS).alias("h")).select("doc_id", "h.item_id", "h.distance")
