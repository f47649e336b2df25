import hashlib
import random

import numpy as np
import pytest

from proselens.llm import substring_dedup, suffix_dedup, windows


def brute(docs, units, join, size):
    first = {}
    rows = [(i if i is not None else 1 << 62, units(t)) for i, t in docs]
    for i, u in rows:
        for a in range(len(u) - size + 1):
            w = tuple(u[a : a + size])
            first[w] = min(first.get(w, i), i)
    out = []
    for i, u in rows:
        gone = set()
        for a in range(len(u) - size + 1):
            if first[tuple(u[a : a + size])] < i:
                gone.update(range(a, a + size))
        runs = sum(1 for g in gone if g - 1 not in gone)
        out.append((i, len(u), len(gone), runs, hashlib.sha256(join([x for k, x in enumerate(u) if k not in gone])).hexdigest()))
    return sorted(out)


def words(t):
    return (t or "").encode().split()


def octets(t):
    return (t or "").encode()


def corpus(seed):
    r = random.Random(seed)
    passages = [" ".join(r.choice(["na", "ti", "on", "für", "é", "ing"]) + str(r.randrange(30)) for _ in range(r.randrange(20, 90))) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = [r.choice(passages) if r.random() < 0.6 else " ".join(str(r.randrange(99999)) for _ in range(r.randrange(0, 80))) for _ in range(r.randrange(0, 5))]
        docs.append((i * 7 % 61, r.choice([" ", "\n", "  \t"]).join(parts)))
    docs += [(100, None), (101, ""), (102, "a" * 3000), (103, "a" * 500 + "b"), (102, "a" * 3000), (None, passages[0]), (104, "x " * 400), (105, "x " * 60), (106, " \n\t ")]
    docs += [(200 + j, passages[1]) for j in range(30)]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_word_windows(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, "k", 1, 2, 3) for i, t in docs], "doc_id long, text string, n_units string, KEPT int, block int, __block int")
    out = substring_dedup.dedup(df, block_bytes=3000, hot=1 << 16 if seed == 1 else 2)
    assert out.columns == ["doc_id", "text", "block", "__block", "n_units", "n_removed", "n_spans", "kept"]
    got = sorted((r.doc_id if r.doc_id is not None else 1 << 62, r.n_units, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out.collect())
    assert got == brute(docs, words, b" ".join, 50)
    assert sum(g[2] for g in got) > 0


@pytest.mark.parametrize("hot", [1 << 16, 2])
def test_byte_windows(spark, hot, monkeypatch):
    """Hot minimisers are cut into single windows; slices of a bucket are small."""
    monkeypatch.setattr(windows, "SLICE", 500)
    docs = corpus(3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = suffix_dedup.dedup(df, block_bytes=3000, hot=hot)
    got = sorted((r.doc_id if r.doc_id is not None else 1 << 62, r.n_units, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out.collect())
    assert got == brute(docs, octets, bytes, 50)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    for f in (substring_dedup.dedup, suffix_dedup.dedup):
        assert f(df).collect() == []


def test_suffix_array():
    r = random.Random(0)
    for n in [*range(0, 40), 200, 301, 302]:
        for letters in (1, 2, 5, 250):
            s = np.array([r.randrange(letters) for _ in range(n)], np.int64)
            want = sorted(range(n), key=lambda i: s[i:].tolist())
            assert suffix_dedup.suffix_array(s).tolist() == want, (n, letters)


def test_suffix_array_to_a_depth():
    r = random.Random(1)
    for depth in (3, 7, 20):
        for _ in range(20):
            part = [r.randrange(3) for _ in range(40)]
            s = np.array((part * 9)[: r.randrange(5, 330)] + [r.randrange(3) for _ in range(30)], np.int64)
            got = [s[i : i + depth].tolist() for i in suffix_array_of(s, depth)]
            assert got == sorted(got)


def suffix_array_of(s, depth):
    out = suffix_dedup.suffix_array(s, depth).tolist()
    assert sorted(out) == list(range(len(s)))
    return out
