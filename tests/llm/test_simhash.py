import random

import numpy as np
import xxhash

from proselens.llm import simhash
from proselens.llm.components import components


def brute_print(text, n=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(ids, near):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in near:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_links_and_prints(spark):
    r = random.Random(5)
    base = [" ".join("w" + str(r.randrange(5000)) for _ in range(300)) for _ in range(12)]
    docs = []
    for i in range(120):
        w = r.choice(base).split()
        for _ in range(r.randrange(0, 3)):
            w[r.randrange(len(w))] = "X" + str(r.randrange(99))
        docs.append((i * 3 + 1, r.choice([" ", "\n "]).join(w)))
    docs += [(1000, None), (1001, ""), (1002, "one"), (1003, "One  two"), (1004, "é A Z"), (None, base[0]), (1000, None)]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, key int, print string")
    got = simhash.near_groups(df).collect()
    prints = {(i, t): brute_print(t) for i, t in docs}
    by_print = {}
    for i, t in docs:
        by_print.setdefault(prints[i, t], []).append(i)
    values = sorted(by_print)
    near = [(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if bin(a ^ b).count("1") <= 3]
    comp = groups(values, near)
    least = {}
    for v in values:
        ids = [i for i in by_print[v] if i is not None]
        if ids:
            least[comp[v]] = min(least.get(comp[v], 1 << 62), min(ids))
    want = sorted((i if i is not None else -1, prints[i, t], least[comp[prints[i, t]]]) for i, t in docs)
    assert sorted((x.doc_id if x.doc_id is not None else -1, int.from_bytes(x["print"], "big"), x.component_id) for x in got) == want
    assert near
    assert simhash.near_groups(df.limit(0)).collect() == []


def test_bit_slices_match_popcount():
    r = np.random.default_rng(1)
    for bits, radius in ((64, 3), (64, 14), (256, 40)):
        for _ in range(3):
            centre = r.integers(0, 256, (1, bits // 8), dtype=np.uint8)
            prints = np.repeat(centre, 150, 0)
            for i in range(150):
                for b in r.choice(bits, r.integers(0, radius), replace=False):
                    prints[i, b >> 3] ^= 1 << (b & 7)
            prints = np.concatenate([prints, r.integers(0, 256, (70, bits // 8), dtype=np.uint8)])
            ends = np.concatenate([np.full(40, 40), np.full(90, 130), np.full(90, 220)])
            links = simhash.spanning_links(prints, ends, radius)
            near = [(a, b) for a in range(220) for b in range(a + 1, ends[a]) if np.unpackbits(prints[a] ^ prints[b]).sum() <= radius]
            assert set(links) <= set(near)
            assert groups(range(220), links) == groups(range(220), near)


def test_large_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 7)
    df = spark.createDataFrame([(i, f"a b c d{i}") for i in range(40)], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in simhash.near_groups(df, radius=30, tables=[[0]]).collect()}
    p = {i: simhash.fingerprint(f"a b c d{i}", 3, 64) for i in range(40)}
    near = [(a, b) for a in p for b in range(a + 1, 40) if p[a][0] >> 7 == p[b][0] >> 7 and bin(int.from_bytes(p[a], "big") ^ int.from_bytes(p[b], "big")).count("1") <= 30]
    assert got == groups(range(40), near)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(500, 560)] + [(900, j) for j in range(901, 960)] + [(7, 7)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert got == {k: v for k, v in groups(sorted({x for e in edges for x in e}), [e for e in edges if e[0] != e[1]]).items() if k in nodes}


def test_similar_links(spark, monkeypatch):
    r = np.random.default_rng(3)
    sets = []
    for i in range(12):
        base = np.arange(1000 * i, 1000 * i + 40)
        for _ in range(12):
            sets.append(np.unique(np.concatenate([r.choice(base, r.integers(28, 41), replace=False), r.integers(10**6, 10**7, r.integers(0, 4))])).astype(np.uint64))
    near = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if (k := len(np.intersect1d(sets[a], sets[b]))) / (len(sets[a]) + len(sets[b]) - k) >= 0.8]
    links = simhash.similar_links(sets, 0.8)
    assert {(min(x), max(x)) for x in links} <= set(near)
    assert groups(range(len(sets)), links) == groups(range(len(sets)), near)
    assert simhash.similar_links([], 0.8) == [] and simhash.similar_links([sets[0], sets[0][:0]], 0.8) == []
    monkeypatch.setattr(simhash, "GROUP", 5)
    texts = [" ".join(str(x) for x in s) for s in sets]
    docs = spark.createDataFrame([*enumerate(texts), (900, texts[0]), (None, texts[0]), (901, None), (902, "")], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in simhash.similar_groups(docs, 1, 64, 64, 0.8, [[0], [1]]).collect()}
    want = groups(range(len(sets)), near)
    assert got == {**want, 900: want[0], None: want[0], 901: 901, 902: 901}
