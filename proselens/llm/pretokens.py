"""Exchange of distinct pre-tokens: every block of documents sends each of its different pre-tokens once to a hash
bucket, a bucket works once on each distinct pre-token, and packed answers return to the blocks.

A pre-token of the sentencepiece model is a run of word marks with the letters after it, letters that follow a newline,
or a run of newlines. No piece of the model has a mark after a letter or holds a newline, so no merge crosses an edge.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselens.llm.common import parts_for, text_bytes

MARK = "▁"
CUT = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n+")
FIELDS = ["keys", "sizes", "texts", "a", "b", "c"]
SCHEMA = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("kind", pa.int64()), *[(f, pa.binary()) for f in FIELDS]])
DDL = ", ".join(["bucket long, block long, kind long", *[f"{f} binary" for f in FIELDS]])


def cut(text: str | None) -> list[str]:
    """The pre-tokens of a text, in order; none of an empty or null text."""
    return CUT.findall(MARK + text.replace(" ", MARK)) if text else []


def pack(words: list[str]) -> tuple[bytes, bytes]:
    raw = [w.encode() for w in words]
    return np.array([len(x) for x in raw], "<u4").tobytes(), b"".join(raw)


def unpack(sizes: bytes, data: bytes) -> list[str]:
    ends = np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64).tolist()
    return [data[a:b].decode() for a, b in zip([0, *ends], ends)]


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, list, list[str]]]:
    """(block number, ids, texts) with about `most` characters each. The number is the same if a task runs again."""
    part, seq = TaskContext.get().partitionId(), 0
    ids, texts, n = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids.append(i)
            texts.append(t or "")
            n += len(texts[-1])
            if n >= most or len(ids) == 60_000:
                yield part << 32 | seq, ids, texts
                ids, texts, n, seq = [], [], 0, seq + 1
    if ids:
        yield part << 32 | seq, ids, texts


def exchange(docs: DataFrame, send: Callable, work: Callable, join: Callable, out: str, most: int = 4 << 20) -> DataFrame:
    """send(texts) -> (words, per-word payload function, document row fields); see the two users.

    send gets a block's texts and returns its different words, a function of the words' numbers that packs what goes
    with them, and the fields a, b, c of the block's own row. work gets a bucket's rows and yields (row, a, b, c).
    join gets a block's own row and its answers and returns a table.
    """
    n = parts_for(text_bytes(docs), 16 << 20)

    def told(batches):
        for block, ids, texts in blocks(batches, most):
            words, payload, own = send(texts)
            at = np.array([xxhash.xxh64_intdigest(w) % n for w in words], np.int64)
            order = np.argsort(at, kind="stable")
            cuts = np.flatnonzero(np.diff(at[order], prepend=-1, append=n)).tolist() if len(words) else [0]
            rows = [(block % n, block, 0, np.array([-(1 << 63) if i is None else i for i in ids], "<i8").tobytes(), np.array([i is None for i in ids]).tobytes(), b"", *own)]
            for x, y in zip(cuts[:-1], cuts[1:]):
                some = order[x:y]
                rows.append((int(at[some[0]]), block, 1, some.astype("<u4").tobytes(), *pack([words[i] for i in some.tolist()]), *payload(some)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), SCHEMA.types)], schema=SCHEMA)

    def worked(key, t):
        rows = t.to_pylist()
        own = [r for r in rows if r["kind"] == 0]
        sent = [r for r in rows if r["kind"] == 1]
        for r, (a, b, c) in zip(sent, work(sent)):
            r.update(sizes=None, texts=None, a=a, b=b, c=c)
        return pa.Table.from_pylist(own + sent, schema=SCHEMA)

    def joined(key, t):
        rows = t.to_pylist()
        own = next(r for r in rows if r["kind"] == 0)
        ids = np.frombuffer(own["keys"], "<i8").tolist()
        none = np.frombuffer(own["sizes"], bool).tolist()
        return join([None if x else i for i, x in zip(ids, none)], own, [r for r in rows if r["kind"] == 1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(told, DDL)
    return rows.groupBy("bucket").applyInArrow(worked, DDL).groupBy("block").applyInArrow(joined, out)
