"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard stands on the ring at many points. A key goes to the next point clockwise; keys that would overflow a full
shard continue clockwise to the next point with room. Capacities sum to the number of rows and differ by one at most,
so counts do too, and only overflowing keys leave the place that a plain ring gives them.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from proselens.llm.common import free_name, others, table

#: The ring's resolution: counts of this many arcs come to the driver, whatever the number of rows.
ARCS = 1 << 16


def points(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(arc, shard) of every virtual node, clockwise."""
    out = {}
    for s in range(shards):
        for v in range(nodes):
            at = int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") % ARCS
            out[at] = min(s, out.get(at, s))
    return sorted(out.items())


def place(counts: dict[int, int], shards: int, nodes: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, from rank, to rank, shard, first slot): which keys of an arc, by rank, go where."""
    ring = points(shards, nodes)
    arcs = [a for a, _ in ring]
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, out, over = [0] * shards, [], []

    def take(arc: int, rank: int, n: int, shard: int) -> int:
        n = min(n, room[shard] - used[shard])
        if n:
            out.append((arc, rank, rank + n, shard, used[shard]))
            used[shard] += n
        return n

    for arc in sorted(counts):
        at = bisect.bisect_left(arcs, arc) % len(ring)
        n = take(arc, 0, counts[arc], ring[at][1])
        if n < counts[arc]:
            over.append((arc, n, at))
    for arc, rank, at in over:
        for step in range(1, len(ring) + 1):
            rank += take(arc, rank, counts[arc] - rank, ring[(at + step) % len(ring)][1])
            if rank == counts[arc]:
                break
        for shard in range(shards):  # a shard whose points all coincide with others' has none of its own
            rank += take(arc, rank, counts[arc] - rank, shard)
    return out


def shard(docs: DataFrame, shards: int = 16, nodes: int = 128, key: str = "doc_id", order: list[str] = []) -> DataFrame:
    """docs with shard (int) and slot (long, gapless from 0 in each shard).

    Rows with equal keys share an arc and are told apart by `order`; a null key is a key like any other. Columns of
    docs called shard or slot, in any case of letters, are replaced; all others stay.
    """
    own = others(docs, "shard", "slot")
    at, arc, rank, low, high, first, new_shard = (free_name(x, docs) for x in ("__at", "__arc", "__rank", "__from", "__to", "__slot", "__shard"))
    rows = docs.withColumn(at, F.xxhash64(key))
    rows = rows.withColumn(arc, F.shiftrightunsigned(at, 48).cast("int"))
    counts = {r["arc"]: r["count"] for r in docs.select(F.shiftrightunsigned(F.xxhash64(key), 48).cast("int").alias("arc")).groupBy("arc").count().collect()}
    kind = T.StructType([T.StructField(arc, T.IntegerType()), T.StructField(low, T.LongType()), T.StructField(high, T.LongType()), T.StructField(new_shard, T.IntegerType()), T.StructField(first, T.LongType())])
    laid = docs.sparkSession.createDataFrame(place(counts, shards, nodes), kind)
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(arc).orderBy(at, key, *order)).cast("long") - 1)
    out = ranked.join(F.broadcast(laid), arc).where((F.col(rank) >= F.col(low)) & (F.col(rank) < F.col(high)))
    return out.select(*own, F.col(new_shard).alias("shard"), (F.col(first) + F.col(rank) - F.col(low)).alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 under the law rows: counts are one apart at most."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    out = shard(rows, order=["size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
