import gzip
import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from proselens.llm import decontamination, quality, sharding, url_reputation, warc


def repeated_words(ws, n=8):
    seen = {}
    for i in range(len(ws) - n + 1):
        seen.setdefault(tuple(ws[i : i + n]), []).append(i)
    return len({i + j for v in seen.values() if len(v) > 1 for i in v for j in range(n)})


def test_quality_base(spark):
    r = random.Random(3)
    texts = [None, "", " \n", "one", "x " * 40 + ".", "Home | News | Contact | About | More\n" + "A fine line of prose stands here, with a stop. " * 3]
    texts += [" ".join(r.choice(["aa", "b.", "c", "d\n", "#x"]) for _ in range(r.randrange(1, 60))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    for x in quality.judge(df).collect():
        t = texts[x.doc_id] or ""
        ws = t.encode().split()
        lines = [s for s in t.split("\n") if s.encode().split()]
        n, rep = len(ws), repeated_words(ws)
        assert (x.n_words, x.n_repeat_words, x.n_dup_lines, x.n_symbols) == (n, rep, len(lines) - len(set(lines)), len(re.findall(r"[#*$%&|<>]", t)))
        assert x.word_chars == sum(len(w.decode()) for w in ws)
        assert x.base_failed == (n < 20 or 100 * rep > 30 * n)
        assert not (x.base_failed and x.kept)
    assert quality.judge(df.limit(0)).where("kept").collect() == []
    odd = df.selectExpr("*", "1 as __w", "2 as __h", "3 as __P", "4 as KEPT")
    assert quality.judge(odd).columns[:5] == ["doc_id", "text", "__w", "__h", "__P"] and quality.judge(odd).select("n_words").count() == len(texts)
    lines = ["Impressum und Datenschutzerklärung", "Todos los derechos reservados", "TOUS DROITS RÉSERVÉS", "All rights reserved", "Ein ganz normaler Satz steht hier."]
    kept = quality.judge(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).first().cleaned
    assert kept == lines[-1]
    assert "Home |" not in quality.judge(df).where("doc_id = 5").first().cleaned


def test_ring(spark):
    df = spark.createDataFrame([(i if i % 97 else None, i % 5) for i in range(5000)], "doc_id long, slot int")
    rows = sharding.shard(df, 16).collect()
    by = {}
    for x in rows:
        by.setdefault(x.shard, []).append(x.slot)
    assert len(rows) == 5000 and len(by) == 16
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    ids = spark.range(20000).withColumnRenamed("id", "doc_id")
    a = {x.doc_id: x.shard for x in sharding.shard(ids, 16).collect()}
    b = {x.doc_id: x.shard for x in sharding.shard(ids, 17).collect()}
    assert sum(a[k] != b[k] for k in a) < 0.1 * len(a)
    odd = ids.limit(50).selectExpr("*", "1 as __arc", "2 as __SLOT", "3 as Shard", "4 as rank")
    assert sharding.shard(odd).columns == ["doc_id", "__arc", "__SLOT", "rank", "shard", "slot"] and sharding.shard(odd).where("__arc = 1 and __SLOT = 2").count() == 50
    assert sharding.shard(df.limit(0)).collect() == []
    assert sorted(x.slot for x in sharding.shard(ids.limit(3)).collect()) == [0, 0, 0]


@pytest.mark.parametrize("shards,nodes,n", [(16, 128, 3000), (5, 3, 200), (7, 1, 41), (16, 128, 9)])
def test_ring_key_by_key(spark, shards, nodes, n):
    """Each key goes to the next point clockwise; what a full shard can't take goes on, in order of place."""
    ids = spark.range(n).withColumnRenamed("id", "doc_id")
    place = {x.doc_id: x.h % (1 << 64) for x in ids.selectExpr("doc_id", "xxhash64(doc_id) as h").collect()}
    signed = {k: v - (1 << 64) if v >> 63 else v for k, v in place.items()}
    ring = {}
    for s in range(shards):
        for v in range(nodes):
            at = int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") % (1 << 16)
            ring[at] = min(s, ring.get(at, s))
    points = sorted(ring)
    room = [n // shards + (s < n % shards) for s in range(shards)]
    order = sorted(place, key=lambda k: (place[k] >> 48, signed[k], k))
    home = {k: next((i for i, p in enumerate(points) if p >= place[k] >> 48), 0) for k in order}
    where, over = {}, []
    for k in order:
        s = ring[points[home[k]]]
        if room[s]:
            room[s] -= 1
            where[k] = s
        else:
            over.append(k)
    for k in over:
        for step in range(1, len(points) + 1):
            s = ring[points[(home[k] + step) % len(points)]]
            if room[s]:
                room[s] -= 1
                where[k] = s
                break
    got = {x.doc_id: x.shard for x in sharding.shard(ids, shards, nodes).collect()}
    assert {k: got[k] for k in where} == where and set(got) == set(place)


def edits(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        last, row = row, [i + 1]
        for j, d in enumerate(t):
            row.append(min(last[j] + (c != d), last[j + 1] + 1, row[j] + 1))
    return min(row)


def test_myers_and_pigeonhole(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randrange(1, 6)))
    for _ in range(200):
        p, t = "".join(r.choice("ab c") for _ in range(r.randrange(1, 30))), "".join(r.choice("ab c") for _ in range(r.randrange(0, 60)))
        d = edits(p, t)
        got = decontamination.distance(p, t, 4)
        assert (got and got[0]) == (d if d <= 4 else None) or (d > 4 and got is None)
    items = [(i, " ".join(word() for _ in range(12))) for i in range(12)]
    docs = []
    for i in range(80):
        x = list(r.choice(items)[1])
        for _ in range(r.randrange(0, 8)):
            k = r.randrange(len(x))
            x[k : k + 1] = r.choice([[], ["z"], [x[k], "q"]])
        docs.append((i, " ".join([word() for _ in range(10)] + ["".join(x).upper()] + [word() for _ in range(10)])))
    docs += [(100, None), (101, ""), (None, items[0][1])]
    df = spark.createDataFrame([(i, t, "h") for i, t in docs], "doc_id long, text string, hits string")
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (None, "a b")], "item_id long, text string")
    for chars in (1 << 20, 60):
        got = {x.doc_id: {h.item_id: h.distance for h in x.hits} for x in decontamination.mark(df, bench, rate=0.1, block_chars=chars).collect()}
        for i, t in docs:
            t = decontamination.plain(t)
            assert got[i] == {k: d for k, p in items if (d := edits(p, t)) <= int(len(p) * 0.1)}
    assert decontamination.mark(df, bench.limit(0)).count() == len(docs)


def test_url_rules(spark):
    urls = ["http://A.Example.com/en/x?y", "https://www.example.com/en/1", "ftp://example.com", "http://b.net/es/", None, "no scheme", "x://y://z/p", "http://B.net/ES/#q", "http://com/", "//a", "http://notexample.com/en/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(500 + i, "http://bad.org/x") for i in range(40)] + [(600 + i, "http://good.org/x") for i in range(40)], "page_id long, url string")
    labels = spark.createDataFrame([(500 + i, 1) for i in range(40)] + [(600 + i, 0) for i in range(40)] + [(1, None), (None, 1)], "page_id long, bad int")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_reputation.judge(pages, labels).collect()}
    assert got[0] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[2][:3] == ("example.com", "", None) and got[3][2:] == ("net/es/", "block")
    assert got[4][:3] == got[5][:3] == got[9][:3] == ("", "", None)
    assert got[6][:2] == ("y:", "//z/p") and got[7][2] is None and got[8][2:] == ("com/", "allow")
    assert got[10][2:] == ("com/", "allow") and got[500][3] == "block" and got[600][3] == "allow"
    assert url_reputation.judge(pages.limit(0), labels).collect() == []
    assert len(url_reputation.judge(pages, labels.limit(0)).collect()) == len(got)


def test_domains_and_bound(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.com:8080": ("y.com", "com"), "me@y.com": ("y.com", "com"), "10.0.0.1:80": ("10.0.0.1", "ip"), "localhost": ("localhost", "localhost"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    domain, suffix = url_reputation.domain_and_suffix(F.col("host"))
    assert {r[0]: (r[1], r[2]) for r in df.select("host", domain, suffix).collect()} == hosts
    r = np.random.default_rng(5)
    for a, b in ((0.5, 1.5), (1, 9), (4.2, 2.1), (30, 4), (40.1, 0.01), (300, 900)):
        got = spark.range(1).select(url_reputation.lower_bound(F.lit(float(a)), F.lit(float(b)), 1.645)).first()[0]
        assert abs(got - np.quantile(r.beta(a + 1, b + 1, 400_000), 0.05)) < 0.03
        assert 0 <= got <= 1


def test_warc_round_trip(spark, tmp_path):
    big, trap = "é" * 80, "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n" * 9
    pages = [(3, "http://a/ b\r\nX: y", big), (1, None, big), (9, "u", trap), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", big), (1, None, big), (8, "u", trap)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "a"))
    got = warc.read(spark, str(tmp_path / "a")).collect()
    assert not [x for x in got if x.gap]
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        first = min(j for j, _, g in pages if j is not None and g == h) if i is not None else None
        later = i is not None and len(b) >= 100 and i > first
        want.append((f"<urn:page:{'null' if i is None else i}>", len(b), hashlib.sha256(b).hexdigest(), "revisit" if later else "response", f"<urn:page:{first}>" if later else None))
    assert sorted(map(repr, [(x.record_id, x.payload_bytes, x.digest, x.record_type, x.refers_to) for x in got])) == sorted(map(repr, want))


def record(i):
    body = f"payload {i} ".encode() * 20
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def numbers(out):
    return [x.fields["warc-record-id"][10:-1] for x in out if isinstance(x, warc.Record)]


def lost(out):
    return [x[:2] for x in out if isinstance(x, tuple)]


@pytest.mark.parametrize("packed", [False, True])
def test_salvage(packed):
    parts = [gzip.compress(record(i)) if packed else record(i) for i in range(5)]
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0x55
    data = parts[0] + parts[1] + bytes(broken) + parts[3] + parts[4][:-30]
    out = list(warc.salvage(data))
    a = len(parts[0]) + len(parts[1])
    assert numbers(out) == ["0", "1", "3"]
    assert lost(out) == [(a, a + len(broken)), (a + len(broken) + len(parts[3]), len(data))]
    assert list(warc.salvage(b"")) == []


def test_members_of_several_records():
    """A member may hold any number of records; a damaged one gives what stands before the damage."""
    many = b"".join(map(record, range(6)))
    whole = gzip.compress(many)
    out = list(warc.salvage(whole + b"\0\0" + gzip.compress(record(9))))
    assert numbers(out) == ["0", "1", "2", "3", "4", "5", "9"] and lost(out) == []
    noisy = b"".join(record(i) + random.Random(i).randbytes(3000).hex().encode() * (i == 3) for i in range(6))
    out = list(warc.salvage(gzip.compress(noisy) + gzip.compress(record(7))))
    assert numbers(out) == ["0", "1", "2", "3", "4", "5", "7"] and lost(out) == [(0, len(gzip.compress(noisy)))]
    big = b"".join(record(i)[:-4] + b"\r\n\r\n" for i in range(300))
    cut = gzip.compress(big, 0)[: len(big) // 2]  # stored as it is: all but some 60 bytes of it are the records'
    out = list(warc.salvage(cut))
    ends = [0]
    for i in range(300):
        ends.append(ends[-1] + len(record(i)))
    there = sum(e <= len(cut) - 100 for e in ends[1:])
    assert numbers(out)[:there] == [str(i) for i in range(there)] and there <= len(numbers(out)) <= there + 1 and lost(out) == [(0, len(cut))]


def test_salvage_is_linear():
    data = b"".join(gzip.compress(record(i), 0) for i in range(40_000))
    began = time.process_time()
    out = list(warc.salvage(data))
    assert len(data) > 16 << 20 and len(out) == 40_000 and time.process_time() - began < 10


def test_store_reports_what_is_lost(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, "u", f"page {i} " * 40) for i in range(30)], "page_id long, url string, html string")
    assert warc.store(spark, df, str(tmp_path / "a")).count() == 30
    assert spark.read.parquet(str(tmp_path / "a" / "gaps")).count() == 0
    assert warc.store(spark, df.limit(0), str(tmp_path / "c")).count() == 0
    whole = warc.write

    def damaged(pages, path):
        whole(pages, path)
        for f in sorted((tmp_path / "b" / "archives").glob("part-*"))[:1]:
            raw = bytearray(f.read_bytes())
            raw[40] ^= 0x55
            f.write_bytes(bytes(raw))
        for f in (tmp_path / "b" / "archives").glob(".*.crc"):
            f.unlink()

    monkeypatch.setattr(warc, "write", damaged)
    with pytest.raises(RuntimeError, match="29 records read"):
        warc.store(spark, df, str(tmp_path / "b"))
    assert [x.begin for x in spark.read.parquet(str(tmp_path / "b" / "gaps")).collect()] == [0]
