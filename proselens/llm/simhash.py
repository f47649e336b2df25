"""SimHash near-duplicates with bit-sliced comparison.

Different fingerprints are dealt into buckets by some of their bits. In a bucket the fingerprints stand as vertical bit
planes, 64 fingerprints a machine word; the distances of all lanes to the lane d places on come from one exclusive or
per plane, summed by carry-save adders section by section, and blocks of lanes are abandoned once all exceed the radius.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.llm.common import checkpoint, join_hot, table
from proselens.llm.components import components

#: Fingerprints in one comparison at most; a larger bucket is split into pairs of parts.
CELL = 8192
#: Shingle sets in one verification at most; a larger group is split into pairs of parts.
GROUP = 1024
#: Keys that are broadcast; sixteen bytes each.
FEW = 1 << 16
#: Stands for a null id: larger than all.
NO_ID = (1 << 63) - 1
SECTION = 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """One hash for each run of `shingle` words, in order of place; a shorter text is one run. No words: none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    last = ends[min(shingle, len(words)) - 1 :]
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a : b - 1], 42) for a, b in zip([0, *ends[:-1]], last)), np.uint64, len(last))


def _print(hashes: np.ndarray, bits: int, step: int = 1 << 15) -> bytes:
    ones, n = np.zeros(bits, np.int64), len(hashes)
    for at in range(0, n, step):
        part = hashes[at : at + step]
        wide = [part] + [_mix(part + np.uint64(0x9E3779B97F4A7C15 * j % (1 << 64))) for j in range(1, bits // 64)]
        for j, x in enumerate(wide):
            ones[64 * j : 64 * j + 64] += np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > n).tobytes()


def fingerprint(text: str | None, shingle: int, bits: int) -> bytes:
    """A bit is 1 if it is set in over half of the shingles' hashes. No words: zero."""
    return _print(shingle_hashes(text, shingle), bits)


def exact_tables(bits: int, radius: int) -> list[list[int]]:
    """radius + 2 parts: two fingerprints within the radius agree in two of them, so any two parts make a key."""
    parts = [p.tolist() for p in np.array_split(np.arange(bits), radius + 2)]
    return [a + b for a, b in itertools.combinations(parts, 2)]


def sampled_tables(bits: int, key_bits: int, tables: int) -> list[list[int]]:
    """Random sets of bits; a pair at distance d agrees in one with probability 1-(1-(1-d/bits)^key_bits)^tables."""
    r = np.random.default_rng(64)
    return [sorted(r.choice(bits, key_bits, replace=False).tolist()) for _ in range(tables)]


def tables_for(n: int, bits: int, similarity: float, found: float = 0.999) -> list[list[int]]:
    """Sampled tables for n fingerprints: keys long enough that unrelated fingerprints make buckets of about 32 however
    many there are, and as many tables as find a pair at the mean distance of `similarity` with probability `found`."""
    distance = math.acos(2 * similarity / (1 + similarity)) / math.pi  # of sets of one size, as a share of the bits
    key_bits = min(max(8, math.ceil(math.log2(max(n, 1) + 1)) - 5), bits // 2)
    return sampled_tables(bits, key_bits, math.ceil(math.log(1 - found) / math.log(1 - (1 - distance) ** key_bits)))


def _sum(planes: np.ndarray) -> list[np.ndarray]:
    """Carry-save sum of the planes: rows of the lanes' counts, lowest bit first."""
    out = []
    while len(planes):
        carries = []
        while len(planes) > 1:
            t = len(planes) // 3
            if t:
                a, b, c = planes[:t], planes[t : 2 * t], planes[2 * t : 3 * t]
                s = a ^ b
                carries.append((a & b) | (s & c))
                planes = np.concatenate([s ^ c, planes[3 * t :]])
            else:
                a, b = planes[:1], planes[1:2]
                carries.append(a & b)
                planes = a ^ b
        out.append(planes[0])
        planes = np.concatenate(carries) if carries else planes[:0]
    return out


def _over(total: list[np.ndarray], radius: int) -> np.ndarray:
    more, same = np.zeros_like(total[0]), np.full_like(total[0], np.uint64(2**64 - 1))
    for j in reversed(range(max(len(total), radius.bit_length()))):
        row = total[j] if j < len(total) else np.zeros_like(same)
        if radius >> j & 1:
            same &= row
        else:
            more |= same & row
            same &= ~row
    return more


def _plus(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    out, carry = [], np.zeros_like(b[0])
    for j in range(max(len(a), len(b))):
        x = a[j] if j < len(a) else np.zeros_like(carry)
        y = b[j] if j < len(b) else np.zeros_like(carry)
        s = x ^ y
        out.append(s ^ carry)
        carry = (x & y) | (s & carry)
    return [*out, carry]


def spanning_links(prints: np.ndarray, run_end: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Lanes of one run (run_end: one past its last lane) within the radius, as pairs that join what they join.

    A pair between lanes that are already joined is left out, and a run that is one group is not compared further.
    """
    n, bits = len(prints), prints.shape[1] * 8
    run_end = run_end.astype(np.int64).copy()
    lanes = np.arange(n)
    longest = int((run_end - lanes).max(initial=0))
    width = (n + 63) // 64 + longest // 64 + 2
    flat = np.zeros((bits, width * 64), np.uint8)
    flat[:, :n] = np.unpackbits(prints, axis=1).T
    planes = np.packbits(flat, axis=1, bitorder="little").view(np.uint64)
    del flat
    first_of = np.flatnonzero(np.concatenate([[True], run_end[1:] != run_end[:-1]])) if n else np.zeros(0, int)
    run = np.cumsum(np.concatenate([[0], (run_end[1:] != run_end[:-1]).astype(int)])) if n else np.zeros(0, int)
    groups = np.diff(np.append(first_of, n)).tolist()
    padded = np.zeros(width * 64, np.int64)
    padded[:n] = run_end
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links, d = [], 0
    while True:
        d += 1
        alive = np.flatnonzero(padded[:n] - lanes > d)
        if not len(alive):
            return links
        words = np.unique(alive >> 6)
        member = padded.reshape(-1, 64)[words] - (words[:, None] * 64 + np.arange(64)) > d
        open_ = np.packbits(member, axis=1, bitorder="little").view(np.uint64).ravel()
        off, shift = divmod(d, 64)
        over, total = np.zeros_like(open_), []
        for b in range(0, bits, SECTION):
            p = planes[b : b + SECTION]
            x = p[:, words + off] >> np.uint64(shift)
            if shift:
                x |= p[:, words + off + 1] << np.uint64(64 - shift)
            x ^= p[:, words]
            total = _plus(total, _sum(x)) if total else _sum(x)
            over = _over(total, radius)
            going = (open_ & ~over) != 0
            if not going.any():
                words = words[:0]
                break
            if not going.all():
                words, open_, over = words[going], open_[going], over[going]
                total = [t[going] for t in total]
        if not len(words):
            continue
        hit = np.unpackbits((open_ & ~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        w, k = np.nonzero(hit)
        for i in (words[w] * 64 + k).tolist():
            a, b = root(i), root(i + d)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((i, i + d))
                groups[run[i]] -= 1
                if groups[run[i]] == 1:
                    f = first_of[run[i]]
                    padded[f : run_end[i]] = 0


def _compare(batches: Iterator[pa.RecordBatch], radius: int, at_once: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    def work(keys, prints, nodes):
        change = np.concatenate([[True], keys[1:] != keys[:-1]])
        first = np.flatnonzero(change)
        length = np.diff(np.append(first, len(keys)))
        some = np.repeat(length > 1, length)
        ends = np.cumsum(length[length > 1])
        if not some.any():
            return None
        nodes = nodes[some]
        found = spanning_links(prints[some], np.repeat(ends, length[length > 1]), radius)
        if not found:
            return None
        a, b = np.array(found).T
        return pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], names=["a", "b"])

    keep: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        raw = batch.column(1)
        prints = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        new = (batch.column(0).to_numpy(), prints, batch.column(2).to_numpy())
        keep = new if keep is None else tuple(np.concatenate(x) for x in zip(keep, new))
        if len(keep[0]) >= at_once:
            cut = int(np.searchsorted(keep[0], keep[0][-1]))  # the last run may go on
            if cut:
                out = work(*(x[:cut] for x in keep))
                if out is not None:
                    yield out
                keep = tuple(x[cut:] for x in keep)
    if keep is not None and len(keep[0]):
        out = work(*keep)
        if out is not None:
            yield out


def fingerprints(docs: DataFrame, shingle: int, bits: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, print binary) of every row."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, shingle, bits) for t in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "print"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, print binary")


def similar_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of sets with a Jaccard similarity of at least `similarity`, as pairs that join what all of them join.

    Exact: such sets share a token among the first size - ceil(similarity * size) + 1 of each, rarest first.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    if len(sets) < 2 or not sizes.sum():
        return []
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    ranks = [np.sort(x) for x in np.split(rank[token], np.cumsum(sizes)[:-1])]
    group, left = np.arange(len(sets)), len(sets)
    places, links = defaultdict(list), []
    for i in np.argsort(sizes, kind="stable").tolist():
        x, n = ranks[i], len(ranks[i])
        prefix = x[: n - math.ceil(similarity * n - 1e-9) + 1].tolist()
        near = np.array(sorted({j for t in prefix for j in places.get(t, ())}), np.int64)
        near = near[(group[near] != group[i]) & (sizes[near] >= similarity * n - 1e-9)]
        for j in near.tolist():
            if group[j] != group[i]:
                both = len(np.intersect1d(x, ranks[j], assume_unique=True))
                if both / (n + sizes[j] - both) >= similarity:
                    group[group == group[j]] = group[i]
                    links.append((j, i))
                    left -= 1
        if left == 1:
            break
        for t in prefix:
            places[t].append(i)
    return links


def _verify(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    def work(group):
        nodes, sets = list(group), list(group.values())
        links = similar_links(sets, similarity)
        return pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in x], pa.int64()) for x in zip(*links)], names=["a", "b"]) if links else None

    key, group = None, {}
    for batch in batches:
        for k, node, content in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                out = work(group)
                if out is not None:
                    yield out
                key, group = k, {}
            group[node] = np.frombuffer(content, np.uint64)
    out = work(group)
    if out is not None:
        yield out


def _cells(rows: DataFrame, counts: DataFrame, key: str, most: int) -> DataFrame:
    """rows(key, node, ...) with each key of counts(key, count) of over `most` rows replaced by one key for each pair of
    parts that holds the node's. Such keys are broadcast while they are few, and joined beyond."""
    large = checkpoint(counts.where(F.col("count") > most).select(key, F.ceil(F.col("count") / most).alias("parts")))
    n = large.count()
    if not n:
        return rows.withColumnRenamed(key, "key")
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    cells = F.expr(f"transform(filter(sequence(0L, parts - 1), o -> o <> part), o -> xxhash64({key}, least(o, part), greatest(o, part)))")
    rows = rows.join(F.broadcast(large) if n <= FEW else large, key, "left").withColumn("part", part)
    return rows.select(F.explode(F.when(F.col("parts").isNull(), F.array(key)).otherwise(cells)).alias("key"), *[c for c in rows.columns if c not in (key, "parts", "part")])


def _links_in_radius(nodes: DataFrame, radius: int, tables: list[list[int]]) -> DataFrame:
    """(a, b): links of nodes(print, node) that join what the pairs within the radius with an equal key join."""
    picks = [np.array(t) for t in tables]

    def keys(batches):
        for b in batches:
            all_bits = np.unpackbits(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1), axis=1)
            for t, pick in enumerate(picks):
                raw = np.zeros((b.num_rows, 64 * -(-len(pick) // 64)), np.uint8)
                raw[:, : len(pick)] = all_bits[:, pick]
                key = np.full(b.num_rows, t * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
                for word in np.packbits(raw, axis=1).view(np.uint64).T:
                    key = _mix(key + word)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(0), b.column(1)], names=["key", "print", "node"])

    keyed = nodes.select("print", "node").mapInArrow(keys, "key long, print binary, node long")
    keyed = _cells(keyed, keyed.groupBy("key").count(), "key", CELL).select("key", "print", "node")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(lambda x: _compare(x, radius), "a long, b long")


def near_groups(docs: DataFrame, shingle: int = 3, bits: int = 64, radius: int = 3, tables: list[list[int]] | None = None, **names) -> DataFrame:
    """(doc_id, print, component_id) of every row: the smallest id reachable over fingerprints within the radius.

    Equal fingerprints are one node, so copies add no comparisons, and ids may repeat. Null texts have fingerprint zero;
    null ids take part but are never a component's id unless it has no other. Without tables the search is exact.
    """
    rows = checkpoint(fingerprints(docs, shingle, bits, **names))
    nodes = rows.groupBy("print").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    nodes = checkpoint(nodes.withColumn("node", F.monotonically_increasing_id()))
    roots = components(_links_in_radius(nodes, radius, tables or exact_tables(bits, radius)))
    linked = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = linked.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("m"))
    linked = checkpoint(join_hot(linked, ids, "root", "m", nodes.count()).select("print", "component_id", "n"))
    return join_hot(rows, linked, "print", "n", rows.count()).select("doc_id", "print", "component_id")


def similar_groups(docs: DataFrame, shingle: int, bits: int, radius: int, similarity: float, tables: list[list[int]] | None = None) -> DataFrame:
    """(doc_id, mark, component_id, first) of every row of docs(doc_id, text): the smallest id reachable over documents
    whose sets of shingles have a Jaccard similarity of at least `similarity`; mark is xxhash64 of the text, and first
    says that no row of the group has a smaller id, or an equal one with a smaller mark.

    Fingerprints within the radius only say which documents to look at: the groups that they make are joined anew by
    exact similarity, all pairs of a group included. Texts with equal sets are one node, told apart from others by the
    fingerprint and a hash of the set together (bits + 64 bits), so ids may repeat. A null id counts as larger than all;
    texts without words, null or not, are one group.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))

    def prints(batches):
        for b in batches:
            hashes = [shingle_hashes(t, shingle) for t in b.column(1).to_pylist()]
            code = [_print(h, bits) + xxhash.xxh64_digest(np.unique(h).tobytes()) for h in hashes]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(code, pa.binary())], names=["doc_id", "mark", "code"])

    rows = checkpoint(texts.mapInArrow(prints, "doc_id long, mark long, code binary"))
    place = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "mark")
    nodes = rows.groupBy("code").agg(F.min(place).alias("row"), F.count("*").alias("n"))
    nodes = checkpoint(nodes.withColumn("node", F.monotonically_increasing_id()))
    tables = tables or tables_for(nodes.count(), bits, similarity)
    roots = components(_links_in_radius(nodes.select(F.substring("code", 1, bits // 8).alias("print"), "node"), radius, tables))
    members = checkpoint(nodes.join(roots, "node").select("root", "node", "row.id", F.col("row.mark").alias("m")))

    def sets(batches):
        for b in batches:
            content = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(content, pa.binary())], names=["root", "node", "content"])

    found = texts.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).join(members.hint("shuffle_hash"), (F.col("doc_id") == F.col("id")) & (F.col("mark") == F.col("m")))
    found = found.select("root", "node", "text").mapInArrow(sets, "root long, node long, content binary")
    found = _cells(found, members.groupBy("root").count(), "root", GROUP).select("key", "node", "content")
    roots = components(found.repartition("key").sortWithinPartitions("key").mapInArrow(lambda x: _verify(x, similarity), "a long, b long"))
    linked = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = linked.groupBy("root").agg(F.min("row").alias("least"), F.count("*").alias("m"))
    linked = checkpoint(join_hot(linked, ids, "root", "m", nodes.count()).select("code", "least", "n"))
    out = join_hot(rows, linked, "code", "n", rows.count())
    return out.select("doc_id", "mark", F.nullif("least.id", F.lit(NO_ID)).alias("component_id"), (place == F.col("least")).alias("first"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest doc_id it reaches over links of at most 3 differing bits."""
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.hex("print")).alias("fingerprint"), "component_id")
