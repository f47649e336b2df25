"""Queries of coverage, analyses and reviews against them, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from proselens.functions import fixed_values as V
from proselens.operators import consistency, reviews, validation
from proselens.plans import measures as M
from proselens.plans.base import CHAP, CUT, DIV, HAN, PHR, SHAPE, STRUCT, WIDE, H, N
from proselens.sources.tables import CHINESE, LATIN, chapters, documents, table

#: Rare characters of the translated tables as words of reviews.
OPINIONS = [("天", "爽快"), ("次", "节奏"), ("王", "不"), ("”", "老套"), ("后", "混乱")]


def swapped(c):
    for a, b in OPINIONS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def items(spark, d):
    """Items of the benchmark as outlines: sentences are bullets, numbered lines and headers in turn of their end marks;
    a last point has no Han character."""
    t = F.translate(F.lower("text"), LATIN, CHINESE)
    lines = F.replace(F.replace(t, F.lit("。"), F.lit("\n2. ")), F.lit("，"), F.lit("\n## "))
    return table(spark, d, "benchmark").select("item_id", F.concat(F.lit("- "), lines, F.lit("\n- 1 2 3")).alias("outline"))


def pairs(spark, d):
    return documents(spark, d).withColumn("item_id", F.col("doc_id") % 37).join(items(spark, d), "item_id").select("doc_id", "text", "outline")


def files(spark, d):
    """Chapters and outlines as files: a chapter's number is its id modulo fifty, outlines have their items' ids, twice."""
    c = documents(spark, d).select(F.concat(F.lit("正文/第"), F.col("doc_id") % 50, F.lit("章_"), "doc_id", F.lit(".md")).alias("path"), "text")
    o = items(spark, d)
    name = lambda folder: F.concat(F.lit(folder + "/章纲_第"), "item_id", F.lit("章.md"))
    return c, o.select(name("大纲").alias("path"), F.col("outline").alias("text")).unionByName(o.select(name("大纲二").alias("path"), F.lit("- 无").alias("text")))


def book_chapters(spark, d):
    """Chapters with ids from one, since 0 stands for the book."""
    return chapters(spark, d).withColumn("doc_id", F.col("doc_id") + 1)


def log(spark, d):
    return validation.analyze(book_chapters(spark, d), M.words(spark), M.rules(spark), "r1")


FIGURES = {"stats": "chinese_chars", "pacing": "scene_changes", "slop": "total_hits", "ai_score": "total_score", "emotion": "peak_count", "style_lint": "summary.total", "cross_chapter": "template_score", "style_lint_book": "total_issues"}


def analyses(spark, d):
    a = log(spark, d)
    value = F.coalesce(*[F.when(F.col("module") == m, validation.metric(F.col("metrics"), p)) for m, p in FIGURES.items()])
    return a.select("book", "doc_id", "module", value.cast("long").alias("value"))


def judgements(spark, d):
    return validation.judgements(log(spark, d), book_chapters(spark, d).select("doc_id", "book", "chapter_no"))


def said(spark, d):
    """Every document is a review of its book, too, with some words swapped for words of reviews."""
    r = documents(spark, d).select(F.struct("book", F.col("doc_id").alias("id")).alias("id"), swapped(F.col("text")).alias("text"))
    return reviews.dimensions(r).select("id.book", "id.id", "dimension", "sentiment")


QUERIES = {
    "cn04_homophones": lambda s, d: consistency.homophones(table(s, d, "nation").select(F.col("n_name").alias("a"), F.col("n_name").alias("b")).crossJoin(table(s, d, "region").select(F.col("r_name").alias("r"))).select("a", F.col("r").alias("b")), table(s, d, "nation").select(F.col("n_name").alias("name"), F.substring("n_name", 1, 1).alias("reading")).unionByName(table(s, d, "region").select(F.col("r_name").alias("name"), F.substring("r_name", 1, 1).alias("reading")))),
    "cn05_coverage": lambda s, d: consistency.coverage(pairs(s, d)).drop("missing_points", "error"),
    "cn06_check_coverage": lambda s, d: consistency.check_coverage(*files(s, d)).select(F.col("doc_id").alias("path"), "total_points", "covered_count", "missed_count"),
    "vl03_judgements": lambda s, d: judgements(s, d).select("book", "doc_id", "chapter_no", "dimension", "module", "bad"),
    "vl06_counts": lambda s, d: validation.counted(said(s, d), judgements(s, d)),
    "vl06_comparisons": lambda s, d: validation.comparisons(said(s, d), judgements(s, d)).select("book", "id", "doc_id", "dimension", "verdict", "matched", "confidence"),
    "vl06_gaps": lambda s, d: validation.gap_counts(said(s, d), judgements(s, d)).groupBy("module", "gap_type").agg(F.sum("n").alias("n")),
    "vl07_analyses": analyses,
    "vl08_unknown_module": lambda s, d: validation.run_module("nothing", documents(s, d)),
}


def _swapped(c):
    for a, b in OPINIONS:
        c = f"replace({c}, '{a}', '{b}')"
    return c


def _dims():
    word = lambda w, s: f"WHEN strpos(u, '{w}') > 0 THEN CASE WHEN regexp_matches(substr(u, greatest(strpos(u, '{w}') - 5, 1), least(strpos(u, '{w}') - 1, 5)), '{'|'.join(V.REVIEW_NEGATIONS)}') THEN '{'positive' if s == 'negative' else 'negative'}' ELSE '{s}' END"
    ordered = sorted(V.REVIEW_WORDS, key=lambda r: -len(r[0]))
    each = [f"SELECT book, doc_id AS id, '{x}' AS dimension, CASE {' '.join(word(w, s) for w, y, s in ordered if y == x)} END AS sentiment FROM sw" for x in dict.fromkeys(y for _, y, _ in ordered)]
    return f"sw AS (SELECT book, doc_id, {_swapped('t')} AS u FROM h), said AS (SELECT * FROM ({' UNION ALL '.join(each)}) WHERE sentiment IS NOT NULL)"


ITEMS = f"it AS (SELECT item_id, '- ' || replace(replace(translate(lower(text), '{LATIN}', '{CHINESE}'), '。', chr(10) || '2. '), '，', chr(10) || '## ') || chr(10) || '- 1 2 3' AS outline FROM benchmark)"
POINTS = r"list_transform(string_split(outline, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))"
COVER = lambda src: rf"ln AS (SELECT *, list_filter(list_transform({POINTS}, lambda x: CASE WHEN regexp_matches(x, '^[-*]\s') THEN regexp_replace(x, '^[-*]\s+', '') WHEN regexp_matches(x, '^\d+[.、）)]') THEN regexp_replace(x, '^\d+[.、）)]\s*', '') WHEN starts_with(x, '##') THEN regexp_replace(x, '^#+\s*', '') END), lambda x: x IS NOT NULL) AS p FROM {src}), ks AS (SELECT *, list_filter(list_transform(p, lambda y: regexp_extract_all(y, '{HAN}{{2,4}}')), lambda k: len(k) > 0) AS k FROM ln), cv AS (SELECT *, len(p) AS total_points, len(list_filter(k, lambda z: len(list_filter(z, lambda w: contains(t, w))) * 2 >= len(z))) AS covered_count FROM ks)"
SPOKEN = "array_to_string(regexp_extract_all(t, '「([^」]*)」', 1), '') || array_to_string(regexp_extract_all(t, '“([^”]*)”', 1), '')"
RULES_ONLY = M.RULE.removeprefix(M.PAIRS + ", ")
EVERYTHING = (
    f"{H}, {CHAP}, {M.BODY}, {M.WIN}, {M.CURVE}, {M.AVG}, {M.STATS}, {DIV}, {SHAPE}, {STRUCT}, {M.PAIRS}, {M.HITS}, {M.LBL}, {PHR}, {RULES_ONLY}, {M.ISSUES}, {M.QUICK}, {M.TEMPLATES}, "
    f"tt AS (SELECT book, CASE WHEN chapters > 1 THEN least(100, repeated_openings * 15 + {M.LOW('length_cv', 100)} + {M.LOW('dialogue_cv', 80)}) END AS template FROM tv), "
    f"sa AS (SELECT dv.doc_id, 4 * {CUT('(0.6::DOUBLE - ttr) * 250::DOUBLE')} + 3 * {CUT('(0.7::DOUBLE - sentence_len_cv) * 250::DOUBLE')} + 3 * least(100, len(f) * 20) + 4 * least(100, trunc(blacklist_density * 15::DOUBLE)::INT) + 3 * {CUT('(repetition_score - 0.3::DOUBLE) * 250::DOUBLE')} + 3 * least(100, phrase_repetition_score) AS total FROM dv JOIN sh USING (doc_id) JOIN st USING (doc_id) JOIN lb USING (doc_id) JOIN ph USING (doc_id)), "
    "si AS (SELECT doc_id FROM iss WHERE severity <> 'info' AND doc_id NOT IN (FROM few) UNION ALL SELECT doc_id FROM qf), sn AS (SELECT doc_id, count(*) AS total FROM si GROUP BY doc_id), "
    f"sp AS (SELECT doc_id, h, (h - d) / greatest(h, 1)::DOUBLE AS narration, a * 1000 / greatest(h, 1)::DOUBLE AS action FROM (SELECT doc_id, {N(HAN)} AS h, {N(HAN, '(' + SPOKEN + ')')} AS d, {N('[' + V.ACTION + ']')} AS a FROM h)), "
    f"sf AS (SELECT doc_id, {M.FLESCH} AS flesch, {N(WIDE)} AS chars FROM h), "
    "fig AS (SELECT c.book, c.doc_id, c.chapter_no, round(action, 1) AS action, round(narration, 3) AS narration, round(flesch, 1) AS flesch, chars, CASE WHEN es.len >= 100 THEN round(intensity_variance, 4) END AS variance, CASE WHEN es.len >= 100 THEN peak_count END AS peaks, coalesce(sn.total, 0) AS issues, round_even(sa.total / 20::DOUBLE, 0)::INT AS risk, template FROM c JOIN sp USING (doc_id) JOIN sf USING (doc_id) JOIN es USING (doc_id) JOIN sa USING (doc_id) LEFT JOIN sn USING (doc_id) JOIN tt ON c.book = tt.book)"
)
BAD = {"pacing": "action < 15 OR narration > 0.75::DOUBLE", "readability": "flesch < 30", "emotion_arc": "variance < 0.08::DOUBLE", "redundancy": "issues > CASE WHEN chars < 2000 THEN 0 ELSE 1 END", "ai_score": "risk > 20", "template_score": "template > 30"}
JUDGED = "ju AS (" + " UNION ALL ".join(f"SELECT book, doc_id + 1 AS doc_id, chapter_no, '{x}' AS dimension, '{m}' AS module, coalesce({BAD.get(x, 'false')}, false) AS bad FROM fig" for x, m in V.DIMENSION_MODULE.items()) + ")"
VERDICT = "CASE WHEN sentiment = 'negative' AND NOT bad THEN 'false_negative' WHEN sentiment = 'positive' AND bad THEN 'false_positive' ELSE 'matched' END"
COMPARED = f"{JUDGED}, {_dims()}, co AS (SELECT book, id, ju.doc_id, dimension, module, {VERDICT} AS verdict FROM said JOIN ju USING (book, dimension))"

SQL = {
    "cn04_homophones": "SELECT n_name AS a, r_name AS b, n_name <> r_name AND left(n_name, 1) = left(r_name, 1) AS same FROM nation, region",
    "cn05_coverage": f"WITH {H}, {ITEMS}, pr AS (SELECT doc_id, t, outline FROM h JOIN it ON doc_id % 37 = item_id), {COVER('pr')} SELECT doc_id, total_points::INT AS total_points, covered_count::INT AS covered_count, (len(k) - covered_count)::INT AS missed_count, covered_count::DOUBLE / greatest(total_points, 1) AS coverage_score FROM cv",
    "cn06_check_coverage": f"WITH {H}, {ITEMS}, pr AS (SELECT '正文/第' || (doc_id % 50) || '章_' || doc_id || '.md' AS path, t, outline FROM h JOIN it ON doc_id % 50 = item_id), {COVER('pr')} SELECT path, total_points::INT AS total_points, covered_count::INT AS covered_count, (len(k) - covered_count)::INT AS missed_count FROM cv",
    "vl03_judgements": f"WITH {EVERYTHING}, {JUDGED} SELECT * FROM ju",
    "vl06_counts": f"WITH {EVERYTHING}, {COMPARED} SELECT book, dimension, verdict, count(*) AS n FROM co GROUP BY ALL",
    "vl06_comparisons": f"WITH {EVERYTHING}, {COMPARED} SELECT book, id, doc_id, dimension, verdict, verdict = 'matched' AS matched, CASE verdict WHEN 'matched' THEN 0.9 WHEN 'false_negative' THEN 0.85 ELSE 0.7 END::DOUBLE AS confidence FROM co",
    "vl06_gaps": f"WITH {EVERYTHING}, {COMPARED} SELECT module, verdict AS gap_type, count(*) AS n FROM co WHERE verdict <> 'matched' GROUP BY ALL",
    "vl07_analyses": f"WITH {EVERYTHING}, w AS (SELECT doc_id, {' + '.join(f'contains(t, {chr(39)}{x}{chr(39)})::INT' for x in [*V.WEASEL, *V.HEDGE])} + {' + '.join(N(p) for _, p in V.WEASEL_PATTERNS)} AS hits, len(regexp_extract_all(t, '(?m)^[-*]{{3,}}\\s*$')) AS scenes FROM h), bi AS (SELECT h.book, count(*) AS n FROM (SELECT doc_id FROM iss WHERE severity <> 'info' UNION ALL SELECT doc_id FROM qf) JOIN h USING (doc_id) GROUP BY h.book), "
    "al AS (SELECT fig.*, hits, scenes FROM fig JOIN w USING (doc_id)) "
    + " UNION ALL ".join(f"SELECT book, doc_id + 1 AS doc_id, '{m}' AS module, {x}::BIGINT AS value FROM al" for m, x in {"stats": "chars", "pacing": "scenes", "slop": "hits", "ai_score": "risk", "emotion": "peaks", "style_lint": "issues"}.items())
    + " UNION ALL SELECT book, 0, 'cross_chapter', template::BIGINT FROM tt WHERE template IS NOT NULL UNION ALL SELECT book, 0, 'style_lint_book', n FROM bi",
    "vl08_unknown_module": "SELECT doc_id, '{\"error\":\"Unknown module: nothing\"}' AS metrics FROM documents",
}
