import os
import pathlib
import random
import shutil
import subprocess
import sys

import corpus_pipeline


def test_stages(spark, tmp_path):
    r = random.Random(6)
    prose = lambda n: ". ".join(" ".join("w" + str(r.randrange(9999)) for _ in range(9)) for _ in range(n)) + "."
    a, passage, bench, b = prose(30), prose(8), prose(4), prose(30)
    near = a.split()
    near[40] = "other"
    docs = [(1, a, "s"), (2, a, "s"), (3, " ".join(near), "s"), (4, passage + "\n" + prose(20), "s"), (5, prose(20) + "\n" + passage, "s"), (6, prose(10) + " " + bench + " " + prose(10), "s"), (7, b, "s"), (8, "too short", "s"), (9, None, "s"), (10, "", None)]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, df = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, f) in enumerate(corpus_pipeline.STAGES[:-1]):
        f(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/s{k}")
        new = spark.read.parquet(f"{tmp_path}/s{k}")
        assert new.columns == df.columns
        df = new
        seen[name] = {x.doc_id: x.text for x in df.collect()}
    assert set(seen["quality rules"]) == {1, 2, 3, 4, 5, 6, 7}
    assert set(seen["SimHash near-dedup"]) == {1, 4, 5, 6, 7}
    assert passage in seen["substring dedup"][4] and passage.split()[10] not in seen["substring dedup"][5].split() and seen["substring dedup"][1] == a
    assert set(seen["benchmark decontamination"]) == {1, 4, 5, 7}
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, 4, 5, 7}


def jaccard(a, b, n=5):
    a, b = ({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_near_duplicates_are_similar(spark):
    """Only documents that reach a smaller id over similarities of 0.8 or more go; lower ones stay, however near their bits."""
    r = random.Random(11)
    docs = []
    for _ in range(60):
        words = ["w" + str(r.randrange(9999)) for _ in range(300)]
        docs.append(" ".join(words))
        for edits in (3, 10):  # similarity about 0.9 and 0.72
            new = list(words)
            for at in r.sample(range(300), edits):
                new[at] = "x" + str(r.randrange(9999))
            docs.append(" ".join(new))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long")
    stays = {x.doc_id for x in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    alike = {i for i in range(len(docs)) if any(jaccard(docs[i], docs[j]) >= 0.8 for j in range(i - i % 3, i))}
    assert sum(0.65 < jaccard(docs[i], docs[i - 2]) < 0.8 for i in range(2, len(docs), 3)) > 30
    assert alike and set(range(len(docs))) - stays == alike


def test_near_duplicates_are_found(spark):
    """Pairs of similarity 0.8 or a little more differ in over 46 bits now and then."""
    r = random.Random(12)
    docs = []
    while len(docs) < 400:
        words = ["w" + str(r.randrange(9999)) for _ in range(200)]
        new = list(words)
        for at in r.sample(range(200), 4):
            new[at] = "x" + str(r.randrange(9999))
        a, b = " ".join(words), " ".join(new)
        if 0.8 <= jaccard(a, b) < 0.83:
            docs += [a, b]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long")
    stays = {x.doc_id for x in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert stays >= set(range(0, len(docs), 2)) and len(docs) - len(stays) >= 198  # of 200; keys are sampled


def test_repeated_ids_lose_nothing(spark):
    """Rows that share an id are judged by their own texts, and of equal rows one stays, against brute force."""
    r = random.Random(13)
    prose = lambda: " ".join("w" + str(r.randrange(9999)) for _ in range(120))
    base = [prose() for _ in range(12)]
    rows = [(5, base[0]), (5, base[1]), (3, base[0] + " end"), (7, base[2]), (7, base[2]), (None, base[3]), (9, base[3] + " more"), (None, base[4]), (None, base[4]), (11, base[5]), (11, base[5] + " more"), (4, base[6]), (4, base[6])]
    rows += [(r.randrange(20, 30), r.choice(base[6:]) + r.choice(["", " x", " y"])) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "s", len(t), k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, Mark string, n_chars long, id int")
    out = corpus_pipeline.near_duplicates(spark, df, "")
    assert out.columns == df.columns
    last = 1 << 62
    groups = []
    for i, t in rows:
        near = [g for g in groups if any(jaccard(t, u) >= 0.8 for _, u in g)]
        groups = [g for g in groups if g not in near] + [[(last if i is None else i, t)] + [x for g in near for x in g]]
    want = []
    for g in groups:
        least = min(i for i, _ in g)
        want.append((least, {t for i, t in g if i == least}))
    got = sorted((last if x.doc_id is None else x.doc_id, x.text) for x in out.collect())
    assert len(got) == len(want)
    for i, t in got:
        assert any(i == least and t in texts for least, texts in want)


def test_share_of_pairs_found(spark):
    """At similarities of about 0.80, 0.85 and 0.90 nine pairs in ten at least are found."""
    r = random.Random(14)
    for edits, least in ((4, 0.8), (3, 0.84), (2, 0.89)):
        docs = []
        while len(docs) < 200:
            words = ["w" + str(r.randrange(9999)) for _ in range(200)]
            new = list(words)
            for at in r.sample(range(200), edits):
                new[at] = "x" + str(r.randrange(9999))
            a, b = " ".join(words), " ".join(new)
            if least <= jaccard(a, b) < least + 0.05:
                docs += [a, b]
        df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(docs)], "doc_id long, text string, source string")
        stays = {x.doc_id for x in corpus_pipeline.near_duplicates(spark, df, "").collect()}
        assert stays >= set(range(0, len(docs), 2)) and len(docs) - len(stays) >= 90


def test_entry_without_the_pipeline_or_the_operators(tmp_path):
    """Without the folder of the operators the entry imports; without the pipeline alone it fails."""
    root = pathlib.Path(corpus_pipeline.__file__).parent
    for name in ("proselens", "__spark_entry__.py", "corpus_pipeline.py"):
        (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    every = int(run().stdout)
    (tmp_path / "corpus_pipeline.py").unlink()
    got = run()
    assert got.returncode and "corpus_pipeline" in got.stderr
    shutil.rmtree(tmp_path / "proselens" / "llm")
    assert int(run().stdout) == every - 11
