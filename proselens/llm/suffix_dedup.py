"""Substring deduplication over bytes by suffix arrays built with a difference cover.

windows.py drops text that provably has no second place and deals the rest to buckets. In a bucket the different
strings are set end to end and their suffixes sorted by the difference-cover algorithm modulo 3: sort the sampled
triples, recurse on their names, merge the remaining suffixes, then compare the 50-byte prefixes of neighbours.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.llm.common import table
from proselens.llm.windows import byte_units, remove_repeats


def _order(cols: list[np.ndarray], base: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable sorting order of the rows of cols (most significant first, all below base), and where a row in that order
    differs from the one before. As many columns as fit are packed into one number with the row's own below them, so
    that plain sorting, which is several times faster, does; further columns take further passes, least significant first."""
    n = len(cols[0])
    low, bits = max(n - 1, 1).bit_length(), max(base - 1, 1).bit_length()
    group, own, order = max(1, (63 - low) // bits), np.arange(n), None
    for at in range(len(cols), 0, -group):
        part = cols[max(0, at - group) : at]
        key = part[0] if order is None else part[0][order]
        for c in part[1:]:
            key = key << bits | (c if order is None else c[order])
        packed = key << low | own
        packed.sort()
        by = packed & ((1 << low) - 1)
        order = by if order is None else order[by]
    new = np.zeros(n, bool)
    if group >= len(cols):
        packed >>= low
        new[1:] = packed[1:] != packed[:-1]
    else:
        for c in cols:
            c = c[order]
            new[1:] |= c[1:] != c[:-1]
    return order, new


def suffix_array(s: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffixes of s (non-negative integers) in order; with a depth, in order of at least so many leading symbols."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    seen = np.zeros(int(s.max()) + 1, bool)
    seen[s] = True
    s = np.concatenate([np.cumsum(seen)[s], np.zeros(3, np.int64)])
    base = int(s.max()) + 2
    # With n = 1 mod 3 an empty triple ends the first class, so that the two halves of the recursion can't run together.
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    order, new = _order([s[sample], s[sample + 1], s[sample + 2]], base)
    level = np.cumsum(new) + 1
    if int(level[-1]) < len(order) and (depth is None or depth > 3):
        names = np.empty(len(order), np.int64)
        names[order] = level
        # A separator between the halves ends each suffix of the first class at the first class's end.
        inner = suffix_array(np.concatenate([names[: len(one)], [0], names[len(one) :]]), depth and -(-depth // 3))
        inner = inner[inner != len(one)]
        order = np.where(inner > len(one), inner - 1, inner)
        level = np.arange(1, len(order) + 1)
    # Where the depth ends the recursion, triples with equal names keep equal ranks.
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = level
    top = max(base, len(order) + 2)
    zero = np.arange(0, n, 3)
    zero = zero[_order([s[zero], rank[zero + 1]], top)[0]]
    sorted_ = sample[order]
    ones, twos = sorted_[(sorted_ % 3 == 1) & (sorted_ < n)], sorted_[sorted_ % 3 == 2]
    before = np.arange(len(zero))
    for other, cols in ((ones, 1), (twos, 2)):
        both = np.concatenate([other, zero])
        by = [s[both], rank[both + 1]] if cols == 1 else [s[both], s[both + 1], rank[both + 2]]
        merged, _ = _order(by, top)  # of equal keys the sampled come first
        count = np.empty(len(both), np.int64)
        count[merged] = np.cumsum(merged < len(other))
        # Below the depth ties stand in any order; the running maximum keeps places apart without leaving the tie.
        before = before + np.maximum.accumulate(count[len(other) :])
    out = np.empty(n, np.int64)
    free = np.ones(n, bool)
    free[before] = False
    out[before] = zero
    out[free] = sorted_[sorted_ < n]
    return out


def neighbours(payloads: list[bytes], docs: list[int], size: int) -> list[np.ndarray]:
    """Per string and window the smallest id that has the window, from the suffix array of all strings together."""
    data = b"".join(payloads)
    length = np.array([len(p) for p in payloads])
    ends = np.cumsum(length)
    of = np.repeat(np.arange(len(payloads)), length)
    raw = np.frombuffer(data + bytes(size), np.uint8)
    sa = suffix_array(raw[: len(data)], size)
    sa = sa[sa + size <= ends[of[sa]]]
    word = raw.astype(np.uint64)
    for s in (1, 2, 4):
        word = word[:-s] | (word[s:] << np.uint64(8 * s))
    same = np.ones(len(sa) - 1, bool)
    for o in [*range(0, size - 7, 8), *([size - 8] if size >= 8 and size % 8 else [])] if size >= 8 else []:
        w = word[sa + o]
        same &= w[1:] == w[:-1]
    for o in range(size if size < 8 else 0):
        w = raw[sa + o]
        same &= w[1:] == w[:-1]
    heads = np.flatnonzero(np.concatenate([[True], ~same]))
    low = np.minimum.reduceat(np.array(docs, np.int64)[of[sa]], heads)
    least = np.empty(len(data), np.int64)
    least[sa] = np.repeat(low, np.diff(np.append(heads, len(sa))))
    return [least[e - n : e - size + 1] for e, n in zip(ends.tolist(), length.tolist())]


def dedup(docs: DataFrame, size: int = 50, **where) -> DataFrame:
    """docs with n_units (bytes), n_removed, n_spans and kept; see remove_repeats for edge cases. size is 16 or more."""
    return remove_repeats(docs, byte_units, size, 16, neighbours, **where)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: bytes, bytes and runs removed, and the digest of what is kept. Null texts are empty."""
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
