import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from proselens.functions import fixed_values as V
from proselens.functions import text as T
from proselens.operators import consistency, emotion, lexicon, stats, style, validation


def texts(seed, letters, n=40, longest=900):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randrange(longest))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")


def test_linear_templates_find_what_templates_find(spark):
    parts = ["首先", "第二", "最后", "总之", "：", "不仅", "而且", "虽然", "但是", "却", "因为", "所以", "此外", "也", "一二三四", "五", "\n", "\r", "，"]
    rows = texts(3, parts, 300, 40)
    for x in style.structures(frame(spark, rows)).collect():
        assert x.structure_patterns == ",".join(n for n, p in V.STRUCTURES.items() if re.search(p, rows[x.doc_id]))


def test_report_is_one_pass(spark):
    """Against brute force, odd texts included: no row of a text or of a word is shuffled or joined."""
    letters = ["天", "地", "玄", "黄玄", "。", "！", "…", " ", "\u3000", "\x85", "\x1c", "\n\n", "𠀀", "a", "首先", "不是", "而是"]
    many = "".join(chr(0x4E00 + k) for k in range(7000))
    rows = [*texts(5, letters, 40, 300), "", None, "。", "天", " 。 ", many + many[:50] * 3 + many]
    lex = spark.createDataFrame([("天地",), ("玄玄",), ("玄玄",), ("",)], "word string")
    out = style.report(frame(spark, rows), lex)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        han = re.findall(T.HAN, t or "")
        counts = [han.count(c) for c in dict.fromkeys(han)] if len(han) < 7000 else [2 + 3 * (k < 50) for k in range(7000)]
        once = counts.count(1)
        grams = {}
        for n in (3, 4, 5):
            for k in range(len(han) - n + 1):
                g = "".join(han[k : k + n])
                grams[g] = grams.get(g, 0) + 1
        often = sum(c >= 3 for c in grams.values())
        hits = sum((t or "").count(w) for w in ("天地", "玄玄"))
        assert (got[i].words, got[i].ttr, got[i].hapax_ratio) == (len(han), len(counts) / max(len(han), 1), once / max(len(han), 1))
        assert (got[i].blacklist_total_hits, got[i].blacklist_density) == (hits, hits * 100 / max(len(han), 1))
        assert (got[i].repeated_phrase_count, got[i].phrase_repetition_score) == (min(50, often), min(20, often) * 5)
        if t is None:
            assert got[i].sentence_count is None and got[i].structure_pattern_count == 0
            continue
        s = [len(x) for x in (x.strip(T.WHITE) for x in re.split("[。！？…]+", t)) if len(x) > 1]
        near = 0.0
        for x, y in zip(s, s[1:]):
            near += min(x, y) / max(x, y)
        assert (got[i].sentence_count, got[i].avg_sentence_len, got[i].repetition_score) == (len(s), sum(s) / max(len(s), 1), near / (len(s) - 1) if len(s) > 1 else 0.0)
        assert got[i].structure_patterns == ",".join(n for n, p in V.STRUCTURES.items() if re.search(p, t))


ODD = ["天", "黄玄", "。", "！", "…", " ", "\u3000", "\x85", "\x1c", "\n\n", "\n \t\n", "\r", "𠀀", "a", "「", "」", "“", "”", '"', "红", "仿佛", "好像", "走跑", "的", "了", "好", "悲", "，", "---", "\n***\n"]


def test_pacing_against_brute_force(spark):
    rows = [*texts(6, ODD, 60, 300), "", None, "天" * 6, "“天" * 9]
    got = {r.doc_id: r for r in stats.pacing(frame(spark, rows)).collect()}
    han = lambda x: len(re.findall(T.HAN, x))
    for i, t in enumerate(rows):
        if t is None:
            assert got[i][1:] == (None,) * 9
            continue
        h, d = han(t), han("".join(re.findall("「([^」]*)」", t) + re.findall("“([^”]*)”", t)))
        p = [x for x in (x.strip(T.WHITE) for x in re.split(r"\n[ \t\n\x0b\f\r]*\n", t)) if len(x) > 5]
        shown = sum(len(re.findall(x, t)) for x in V.DESCRIPTION)
        assert (got[i].dialogue_ratio, got[i].narration_ratio, got[i].description_hints) == (d / max(h, 1), (h - d) / max(h, 1), shown)
        assert (got[i].paragraphs, got[i].avg_paragraph_len, got[i].paragraph_density) == (len(p), sum(map(han, p)) / max(len(p), 1), len(p) * 1000 / max(h, 1))
        assert (got[i].show_vs_tell, got[i].action_density) == (d / max(h, 1), len(re.findall(f"[{V.ACTION}]", t)) * 1000 / max(h, 1))


@pytest.mark.parametrize("opener", ["“", "「"])
def test_unclosed_speech_is_read_once(spark, opener):
    """Patterns read such a text once for each opener: a minute and more."""
    import time

    long = frame(spark, [(opener + "天") * 250000]).withColumn("book", F.lit("b"))
    at = time.time()
    assert [r.dialogue_ratio for r in stats.pacing(long).collect()] == [0.0]
    assert [r.dialogue_cv for r in style.templates(long).collect()] == [0.0]
    assert time.time() - at < 20


def test_linguistic_against_brute_force(spark):
    rows = [*texts(7, ODD, 60, 300), "", None, " 。 ", "天"]
    out = style.linguistic(frame(spark, rows))
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(rows):
        if t is None:
            assert (got[i].avg_sentence_len, got[i].punct_density, got[i].stopword_ratio) == (None, None, None)
            continue
        s = [len(re.findall(T.HAN, x)) for x in re.split("[。！？…]+", t) if x.strip(T.WHITE)]
        r, h = re.findall(T.HAN + "+", t), max(len(re.findall(T.HAN, t)), 1)
        a, q, n = sum(s), sum(x * x for x in s), len(s)
        good, bad = (sum(t.count(w) for w in ws) for ws in (V.GLAD, V.SAD))
        assert (got[i].avg_sentence_len, got[i].sentence_len_cv) == (a / max(n, 1), (q * n - a * a) ** 0.5 / a if a else 0.0)
        assert (got[i].ttr, got[i].sentiment) == (len(set(r)) / max(len(r), 1), (good - bad) / max(good + bad, 1))
        assert (got[i].punct_density, got[i].stopword_ratio) == (len(re.findall(f"[{V.MARKS}]", t)) * 100 / h, len(re.findall(f"[{V.STOP}]", t)) / h)


def test_templates_against_brute_force(spark):
    """Null texts and books of one chapter included; a text is read by one pass."""
    rows = [("abc"[i % 3], t) for i, t in enumerate([*texts(8, ODD, 60, 300), *["天" * 9] * 6, None, ""])] + [("d", "天"), ("e", None), ("e", None)]
    out = style.templates(spark.createDataFrame(rows, "book string, text string"))
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r.book: r for r in out.collect()}
    assert set(got) == set("abcde") and got["d"][1:] == got["e"][1:4] + (0,) == (0, 0.0, 0.0, 0)
    for b in "abc":
        ts = [t for x, t in rows if x == b and t is not None]
        o = ["".join(re.findall(T.HAN, t))[:8] for t in ts]
        d = [len(re.findall('[「"][^」"]+[」"]', t)) / max(max(len(re.findall(T.HAN, t)), 1) / 100, 1.0) for t in ts]
        n = [len(t) for t in ts if t]
        cv = lambda x: (sum((v - sum(x) / len(x)) ** 2 for v in x) / len(x)) ** 0.5 / (sum(x) / len(x))
        assert got[b].repeated_openings == sum(o.count(x) > 1 and len(x) == 8 for x in set(o))
        assert abs(got[b].length_cv - cv(n)) < 6e-4 and abs(got[b].dialogue_cv - cv(d)) < 6e-4


def curve(text):
    """Brute force: every window by counting every word."""
    text = re.sub(r"^---.*?---\n", "", text, flags=re.DOTALL)
    return text, [sum(text[a : a + 500].count(w) * round(10 * x) for w, (_, x) in V.EMOTIONS.items()) * 0.7 / 50 + 0.15 for a in range(0, len(text) - 499, 250)]


def test_emotion_against_brute_force(spark):
    words = [*V.EMOTIONS, *"天地玄黄宇宙洪荒日月盈昃", "不安心中"]
    rows = ["---\nx\n---\n" + t if i % 3 == 0 else t for i, t in enumerate(texts(4, words, 30, 1500))] + ["", None, "天" * 99, "平静" * 700]
    got = {}
    for x in emotion.curve(frame(spark, rows)).orderBy("doc_id", "i").collect():
        got.setdefault(x.doc_id, []).append(x.intensity)
    report = {x.doc_id: x for x in emotion.report(frame(spark, rows)).collect()}
    for i, t in enumerate(rows):
        body, want = curve(t or "")
        assert got.get(i, []) == pytest.approx(want)
        r = report[i]
        if len(body) < 100:
            assert r.error == "Text too short" and r.arc is None
            continue
        mean = sum(want) / len(want) if want else 0
        spread = (sum((v - mean) ** 2 for v in want) / len(want)) ** 0.5 * (max(0.3, len(body) / 2000) if len(body) < 2000 else 1) if len(want) > 1 else 0
        assert r.avg_intensity == pytest.approx(mean) and r.intensity_variance == pytest.approx(spread, abs=1e-9)
        assert r.peak_count == sum(v >= max(mean * 1.5 if mean > 0 else 0.5, 0.2) for v in want)
        assert (r.arc == "unknown") == (len(want) < 4) and 0 <= r.confidence <= 1
    assert report[len(rows) - 1].arc == "flat" and report[len(rows) - 1].confidence == 0.5
    top = [(x.word, x.n) for x in emotion.keywords(frame(spark, rows)).where("doc_id = 1").orderBy("rank").collect()]
    body, _ = curve(rows[1])
    count = {w: sum(body[a : a + 500].count(w) for a in range(0, len(body) - 499, 250)) for w in V.EMOTIONS}
    assert top == sorted(((w, n) for w, n in count.items() if n), key=lambda x: (-x[1], x[0]))[:15]


def test_arc_shape(spark):
    """Windows that rise as the first template does."""
    shape = V.ARCS["rags_to_riches"]
    text = "".join("狂喜" * round(50 * x) + "天" * (250 - 2 * round(50 * x)) for x in [shape[0], *shape])
    got = emotion.arcs(frame(spark, [text])).first()
    assert got.arc == "rags_to_riches" and got.confidence > 0.9


def test_rhythm(spark):
    rows = ["天" * 60 + "狂喜" * 20 + "地" * 50, "短"]
    d = frame(spark, rows)
    c = [x.intensity for x in emotion.rhythm(d).orderBy("i").collect()]
    size = len(rows[0]) // 40
    want = [min(rows[0][i * size : (i + 1) * size if i < 39 else None].count("狂喜") / (len(rows[0][i * size : (i + 1) * size if i < 39 else None]) / 100), 3.0) for i in range(40)]
    assert c == pytest.approx(want)
    r = emotion.rhythm_report(d).first()
    assert r.avg_intensity == pytest.approx(sum(want) / 40) and r.peak_count == sum(v >= 1.5 * sum(want) / 40 and v > 0.2 for v in want)


def test_hd_d(spark):
    rows = ["", "天地。", " ".join("天地玄黄"[i % 4] * (1 + i % 3) for i in range(300))]
    got = {x.doc_id: x for x in stats.lexical_diversity(frame(spark, rows)).collect()}
    assert got[0].hd_d == 0 and got[1].hd_d == pytest.approx(0.9) and 0 < got[2].hd_d < 0.9 * 12 / 35 + 1e-9
    assert {x.doc_id: x.hd_d for x in stats.hd_d(frame(spark, rows)).collect()} == {k: v.hd_d for k, v in got.items()}


def test_lexicon_counts_as_count_does(spark):
    words = ["天", "天天", "天地", "地天地", "x", "xy", "yx", ""]
    lex = spark.createDataFrame([(w, "c", "ban") for w in words] + [("天", "d", "warn")], "word string, category string, severity string")
    rows = texts(5, "天地xy", 40, 60) + ["", None]
    got = {(x.doc_id, x.word): x.n for x in lexicon.hits(frame(spark, rows), lex).collect()}
    assert got == {(i, w): (t or "").count(w) for i, t in enumerate(rows) for w in words if w and (t or "").count(w)}
    assert lexicon.contains(frame(spark, ["天"]), lex).count() == 2 and lexicon.listing(lex, category="d").count() == 1 and lexicon.listing(lex, severity="ban").count() == 8
    slices = list(lexicon._slices(lex, 3))
    assert len(slices) > 1 and sorted(w for some in slices for w in some) == sorted(w for w in words if w)
    assert lexicon.hits(frame(spark, rows), lex.limit(0)).count() == 0


def test_lint_tables(spark):
    rules = spark.createDataFrame([("redundancy", "天天", "ban", "删", None), ("cliche", "地", "warn", None, None), ("weasel", "x", "info", None, None), ("adverb_abuse", "玄", "warn", None, 100.0), ("dialogue_tags", "黄", "ban", None, None)], "check string, pattern string, severity string, suggestion string, max_per_1k double")
    d = frame(spark, [" 天天地\nx\n天天天", "玄玄天地黄", ""])
    got = {(r.doc_id, r.check, r.line, r.context, r["count"]) for r in lexicon.lint(d, rules).collect()}
    assert got == {(0, "redundancy", 1, "天天地", None), (0, "cliche", 1, "天天地", None), (0, "redundancy", 3, "天天天", None), (1, "cliche", 1, "玄玄天地黄", None), (1, "adverb_abuse", -1, "", 2)}
    assert lexicon.lint(d, rules, severity="info").where("check = 'weasel'").count() == 1
    assert {r.check for r in lexicon.lint(d, rules, ["cliche", "nothing"]).collect()} == {"cliche"} and lexicon.lint(d, rules, ["nothing"]).count() == 0
    s = {r.doc_id: (r.total, r.ban, r.warn, r.info) for r in lexicon.summary(d, lexicon.lint(d, rules)).collect()}
    assert s == {0: (3, 2, 1, 0), 1: (2, 0, 2, 0), 2: (0, 0, 0, 0)}
    quick = spark.createDataFrame([(0, "filler", "info")], "doc_id long, type string, severity string")
    issues, summary = lexicon.lint_short(d, lexicon.lint(d, rules), quick)
    assert issues.count() == 6 and {r.doc_id: r.total for r in summary.collect()} == {0: 1, 1: 0, 2: 0}


def test_overused_compares_the_rounded_rate(spark):
    """401 in 200,000 is 2.005, which rounds to 2.0 in binary; 402 is over."""
    for n, want in ((401, 0), (402, 1)):
        text = "就" * n + "天" * (200_000 - n)
        assert style.overused(frame(spark, [text])).count() == want
    said = style.overused_report(frame(spark, ["就都" * 3 + "天", "天"])).orderBy("doc_id").collect()
    assert said[0].overused_count == 2 and "就、都" in said[0].suggestions[0] and said[1].suggestions == []


def test_linguistic_and_templates(spark):
    x = style.linguistic(frame(spark, ["天好。地玄黄的！", ""])).orderBy("doc_id").collect()
    assert x[0].avg_sentence_len == 3 and x[0].sentiment == 1 and x[0].punct_density == pytest.approx(200 / 6) and x[0].stopword_ratio == pytest.approx(1 / 6)
    assert x[1].avg_sentence_len == 0 and x[1].ttr == 0
    chapters = spark.createDataFrame([("a", 1, "天地玄黄宇宙洪荒一"), ("a", 2, "天地玄黄宇宙洪荒二"), ("b", 1, "天")], "book string, chapter_no int, text string")
    got = {r.book: (r.repeated_openings, r.length_cv, r.dialogue_cv, r.template_score) for r in style.templates(chapters).collect()}
    assert got == {"a": (1, 0.0, 0.0, 15 + 30 + 24), "b": (0, 0.0, 0.0, 0)}
    assert [tuple(r) for r in style.openings(chapters).collect()] == [("a", 0, "天地玄黄宇宙洪荒", 2)]


def test_coverage_counts_points_without_keywords(spark):
    d = spark.createDataFrame([(1, "少年离开家乡", "- 少年离开\n- 1 2 3\n* 雨夜"), (2, "x", " \n"), (3, "x", "nothing"), (4, None, None)], "doc_id long, text string, outline string")
    got = {r.doc_id: (r.total_points, r.covered_count, r.missed_count, r.error) for r in consistency.coverage(d).collect()}
    assert got == {1: (3, 1, 1, None), 2: (0, 0, 0, "Empty outline"), 3: (0, 0, 0, "No outline points found"), 4: (0, 0, 0, "Empty outline")}
    chapters = spark.createDataFrame([("正文/第3章_a.md", "少年"), ("正文/第4章.md", "x"), ("正文/前言.md", "x")], "path string, text string")
    outlines = spark.createDataFrame([("大纲/b第3章.md", "- 无"), ("大纲/a第3章第5章.md", "- 少年")], "path string, text string")
    got = consistency.matched_outlines(chapters, outlines).collect()
    assert [(r.doc_id, r.outline_path) for r in got] == [("正文/第3章_a.md", "大纲/a第3章第5章.md")]
    assert consistency.check_coverage(chapters, outlines).first().covered_count == 1


def test_homophones(spark):
    pairs = spark.createDataFrame([("王宁", "汪宁"), ("王宁", "王宁"), ("王宁", "李")], "a string, b string")
    readings = spark.createDataFrame([("王宁", "wáng níng"), ("汪宁", "wáng níng")], "name string, reading string")
    assert {(r.b, r.same) for r in consistency.homophones(pairs, readings).collect()} == {("汪宁", True), ("王宁", False), ("李", False)}
    assert not any(r.same for r in consistency.homophones(pairs).collect())


def test_hints(spark):
    text = "他没想到这一切会来。如果你知道的话。" + "".join(f"后来他终于第{i}次回来。" for i in range(3))
    got = [r.hint for r in consistency.hints(frame(spark, [text, "天"])).collect()]
    assert got and len(got) <= 10 and all(len(x) > 5 for x in got)


def test_judgements(spark):
    import json

    log = [("r1", "b", 1, "pacing", {"action_density": 20.0, "narration_ratio": 0.8}), ("r1", "b", 1, "stats", {"chinese_chars": 1500, "readability": {"flesch_zh": 30.0}}), ("r1", "b", 1, "style_lint", {"summary": {"total": 1}}), ("r1", "b", 0, "cross_chapter", {"template_score": 31}), ("r1", "b", 2, "stats", {"chinese_chars": 2500}), ("r1", "b", 2, "style_lint", {"summary": {"total": 1}}), ("r2", "b", 2, "pacing", {"action_density": 14.9}), ("r1", "b", 2, "pacing", {"action_density": 99}), ("r1", "c", 3, "pacing", {"error": "File not found"})]
    rows = spark.createDataFrame([(*x[:4], json.dumps(x[4])) for x in log], "run_id string, book string, doc_id long, module string, metrics string")
    chapters = spark.createDataFrame([(1, "b", 1), (2, "b", 2), (3, "c", 1), (4, "c", 2)], "doc_id long, book string, chapter_no int")
    j = validation.judgements(rows, chapters)
    bad = {(r.doc_id, r.dimension) for r in j.where("bad").collect()}
    assert bad == {(1, "pacing"), (1, "redundancy"), (1, "template_score"), (2, "pacing"), (2, "template_score")}
    assert {r.value for r in j.where("doc_id = 1 and dimension = 'pacing'").collect()} == {"20.0|narration=80.0%"}
    assert j.where("doc_id = 4").count() == 0
    reviews = spark.createDataFrame([("b", 1, "节奏太慢"), ("b", 2, "节奏快，很流畅"), ("c", 3, "看不懂"), ("b", 4, "x")], "book string, id long, text string")
    compared, counts, gaps = validation.validate(reviews, chapters, rows)
    got = {(r.id, r.doc_id, r.dimension): (r.verdict, r.confidence) for r in compared.collect()}
    assert got == {(1, 1, "pacing"): ("matched", 0.9), (1, 2, "pacing"): ("matched", 0.9), (2, 1, "pacing"): ("false_positive", 0.7), (2, 2, "pacing"): ("false_positive", 0.7), (2, 1, "readability"): ("matched", 0.9), (2, 2, "readability"): ("matched", 0.9), (3, 3, "readability"): ("false_negative", 0.85)}
    tally = {}
    for r in compared.collect():
        tally[r.book, r.dimension, r.verdict] = tally.get((r.book, r.dimension, r.verdict), 0) + 1
    assert {(r.book, r.dimension, r.verdict): r.n for r in counts.collect()} == tally
    assert {r.n for r in gaps.collect()} == {1} and gaps.count() == 3


def test_comparisons_meet_in_blocks(spark, monkeypatch):
    """A row for each pair whatever the blocks' sizes, and two generators that Spark does not compile into one."""
    monkeypatch.setattr(validation, "BLOCKS", (2, 3))
    said = [(b, i, x, s) for b in ("b", "c", None) for i, x, s in [(1, "pacing", "negative"), (2, "pacing", "positive"), (2, "pacing", "positive"), (3, "pacing", "positive"), (None, "pacing", "negative"), (4, "other", None)]]
    judged = [(b, d, d, x, "m", d % 3 == 0, "n", None if d % 2 else "v", "lt", "5") for b in ("b", "c") for d in range(11) for x in ("pacing", "other")]
    a = spark.createDataFrame(said, "book string, id long, dimension string, sentiment string")
    b = spark.createDataFrame(judged, "book string, doc_id long, chapter_no long, dimension string, module string, bad boolean, name string, value string, op string, threshold string")
    verdict = lambda s, bad: "false_negative" if s == "negative" and not bad else "false_positive" if s == "positive" and bad else "matched"
    gap = lambda v, y: "" if v == "matched" else f"[{y[3]}] n={y[7]} vs threshold lt 5 (ch {y[2]})"
    want = [(x[0], x[1], y[1], x[2], "m", v, v == "matched", {"matched": 0.9, "false_negative": 0.85, "false_positive": 0.7}[v], gap(v, y)) for x in said for y in judged if (x[0], x[2]) == (y[0], y[3]) for v in [verdict(x[3], y[5])]]
    out = validation.comparisons(a, b)
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, want))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("Coalesce") < plan.index("Generate inline") < plan.index("REPARTITION_BY_NUM")


def test_modules(spark):
    d = frame(spark, ["天地玄黄。" * 40, None])
    lex = spark.createDataFrame([("天", "c", "ban")], "word string, category string, severity string")
    rules = spark.createDataFrame([("cliche", "天", "ban", None, None)], "check string, pattern string, severity string, suggestion string, max_per_1k double")
    for name in [*validation.MODULES, "nothing"]:
        got = {r.doc_id: r.metrics for r in validation.run_module(name, d, words=lex, rules=rules).collect()}
        assert len(got) == 2 and "error" in got[1] and ("error" in got[0]) == (name == "nothing")
    chapters = d.selectExpr("doc_id + 1 as doc_id", "'b' as book", "doc_id as chapter_no", "text")
    log = validation.analyze(chapters.where("text is not null"), lex, rules, "r").collect()
    assert {(r.doc_id, r.module) for r in log} == {(1, m) for m in validation.MODULES} | {(0, "style_lint_book")}


def test_batches_are_read_in_slices():
    b = pa.RecordBatch.from_pydict({"doc_id": list(range(700)), "text": ["宁" * 100] * 699 + [None]})
    got = [(len(list(texts)), part.num_rows) for part, texts in T.slices([b])]
    assert got == [(256, 256), (256, 256), (188, 188)]
    long = pa.RecordBatch.from_pydict({"doc_id": list(range(9)), "text": ["宁" * (1 << 20)] * 9})  # 3 MB each
    assert [part.num_rows for part, _ in T.slices([long])] == [2, 2, 2, 2, 1]


def test_lint_of_short_texts_meets_rules_once(spark):
    d = spark.createDataFrame([(1, "宁" * 30), (2, "宁" * 3000), (3, None)], "doc_id long, text string")
    issues = spark.createDataFrame([(1, "cliche", "ban"), (2, "cliche", "ban"), (2, "weasel", "warn")], "doc_id long, check string, severity string")
    quick = spark.createDataFrame([(1, "filler", "info"), (2, "filler", "info")], "doc_id long, type string, severity string")
    got = {r.doc_id: (sorted(x.check for x in r.issues), sorted(x.check for x in r.counted)) for r in lexicon.lint_chapters(d, issues, quick).collect()}
    assert got == {1: (["cliche", "filler"], ["filler"]), 2: (["cliche", "weasel"], ["cliche", "weasel"]), 3: ([], [])}
    merged, summary = lexicon.lint_short(d, issues, quick)
    assert merged.count() == 4 and {tuple(r) for r in summary.collect()} == {(1, 1, 0, 0, 1), (2, 2, 1, 1, 0), (3, 0, 0, 0, 0)}
