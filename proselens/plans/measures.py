"""Queries of the emotion curves, the wider statistics, the style reports and the lexicon tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from proselens.functions import fixed_values as V
from proselens.operators import emotion, lexicon, stats, style
from proselens.plans.base import CHAP, COUNT, CUT, DENSE, DIV, HAN, N, PHR, SENT, SHAPE, STRIP, STRUCT, WIDE, H
from proselens.sources.tables import chapters, dealt, documents

#: Characters whose pairs are the lexicon of the queries, 420 words: a word list made by rule, as large as a real one.
ALPHABET = "宁思平乎红安沉后她和他静危似天机首不险走次"
KINDS = ["connector", "filler", "cliche", "emotion", "action", "narration", "dialogue"]
CHECKS = ["redundancy", "cliche", "weasel", "adverb_abuse", "dialogue_tags"]


def words(spark):
    """The pairs, in order: the category goes by the order modulo seven, the severity modulo three."""
    w = spark.range(1).select(F.posexplode(lexicon.words_of(ALPHABET)).alias("k", "word"))
    pick = lambda c, xs: F.element_at(F.array(*map(F.lit, xs)), c % len(xs) + 1)
    return w.select("word", pick(F.col("k"), KINDS).alias("category"), pick(F.col("k"), ["ban", "warn", "limit"]).alias("severity"))


def rules(spark):
    """Every eighth pair is a rule; the check goes by the order modulo five, and density rules allow two in a thousand."""
    w = spark.range(1).select(F.posexplode(lexicon.words_of(ALPHABET)).alias("k", "pattern")).where("k % 8 = 0").withColumn("k", (F.col("k") / 8).cast("int"))
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), F.col("k") % len(xs) + 1)
    check = pick(CHECKS)
    return w.select(check.alias("check"), "pattern", pick(["ban", "warn", "info"]).alias("severity"), F.lit(None).cast("string").alias("suggestion"), F.when(check.isin(*lexicon.DENSE), F.lit(2.0)).alias("max_per_1k"))


def quick(spark, d):
    return style.quick_scan(documents(spark, d))


def lint_book(spark, d):
    books = documents(spark, d).select("doc_id", "book")
    return lexicon.lint(documents(spark, d), rules(spark)).join(books, "doc_id").groupBy("book").agg(F.count("*").alias("total"), F.count_if(F.col("severity") == "ban").alias("ban"), F.count_if(F.col("severity") == "warn").alias("warn"), F.count_distinct("check").alias("unique_checks"))


QUERIES = {
    "em01_windows": lambda s, d: emotion.curve(documents(s, d)),
    "em03_curve_stats": lambda s, d: emotion.summary(documents(s, d)).drop("peaks"),
    "em04_keywords": lambda s, d: emotion.keywords(documents(s, d)),
    "em05_arcs": lambda s, d: emotion.arcs(documents(s, d)),
    "em06_report": lambda s, d: emotion.report(documents(s, d)).drop("peaks"),
    "st09_hd_d": lambda s, d: stats.hd_d(documents(s, d)),
    "st11_lexical_diversity": lambda s, d: stats.lexical_diversity(documents(s, d)),
    "st12_book_chapters": lambda s, d: stats.book_chapters(chapters(s, d)),
    "st13_readout_book": lambda s, d: stats.readout_book(chapters(s, d)).withColumn("mean", F.round("mean", 6)),
    "st13_series": lambda s, d: stats.readability_series(chapters(s, d)),
    "st22_rhythm": lambda s, d: emotion.rhythm(documents(s, d)),
    "st22_rhythm_report": lambda s, d: emotion.rhythm_report(documents(s, d)).drop("peaks"),
    "st22_rhythm_keywords": lambda s, d: emotion.rhythm_keywords(documents(s, d)),
    "sl07_report": lambda s, d: style.report(dealt(s, d), words(s)),
    "sl09_score_ai_risk": lambda s, d: style.risk(dealt(s, d), words(s)),
    "sl15_phrases": lambda s, d: style.phrases(dealt(s, d)),
    "sl08_lexicon": lambda s, d: lexicon.density(dealt(s, d), words(s)),
    "sl08_lexicon_top": lambda s, d: lexicon.top(documents(s, d), words(s)),
    "sl10_linguistic": lambda s, d: style.linguistic(dealt(s, d)),
    "sl13_overused": lambda s, d: style.overused(documents(s, d)),
    "sl13_suggestions": lambda s, d: style.overused_report(documents(s, d)).withColumn("suggestions", F.array_join("suggestions", " ")),
    "sl16_contains": lambda s, d: lexicon.contains(documents(s, d), words(s)),
    "sl17_by_severity": lambda s, d: lexicon.listing(words(s), severity="limit"),
    "sl17_by_category": lambda s, d: lexicon.listing(words(s), category="cliche"),
    "sl18_templates": lambda s, d: style.templates(dealt(s, d)),
    "sl18_openings": lambda s, d: style.openings(dealt(s, d)),
    "ln01_rules": lambda s, d: lexicon.lint(documents(s, d), rules(s)).drop("suggestion"),
    "ln04_checks": lambda s, d: lexicon.lint(documents(s, d), rules(s), ["weasel", "dialogue_tags", "unknown"], "info").select("doc_id", "check", "pattern", "line"),
    "ln05_summary": lambda s, d: lexicon.summary(documents(s, d), lexicon.lint(documents(s, d), rules(s))),
    "ln08_lint_book": lint_book,
    "ln07_issues": lambda s, d: lexicon.lint_short(documents(s, d), lexicon.lint(documents(s, d), rules(s)), quick(s, d))[0],
    "ln07_summary": lambda s, d: lexicon.lint_short(documents(s, d), lexicon.lint(documents(s, d), rules(s)), quick(s, d))[1],
}

BODY = r"b AS (SELECT doc_id, regexp_replace(t, '^---(.|\n)*?---\n', '') AS t FROM h)"
WEIGHT = lambda ws: " + ".join(f"{round(x * 10)} * {COUNT(w, 'w')}" for w, (_, x) in ws.items())
ONE = "x * 0.7::DOUBLE / 50::DOUBLE + 0.15::DOUBLE"
WIN = f"wi AS (SELECT doc_id, (a // 250)::INT AS i, t[a + 1:a + 500] AS w FROM (SELECT doc_id, t, unnest(generate_series(0, length(t) - 500, 250)) AS a FROM b WHERE length(t) >= 500)), wt AS (SELECT doc_id, i, ({WEIGHT(V.EMOTIONS)})::BIGINT AS x FROM wi)"
CURVE = "cu AS (SELECT b.doc_id, length(t) AS len, (SELECT list(x ORDER BY i) FROM wt WHERE wt.doc_id = b.doc_id) AS x FROM b)".replace("(SELECT list(x ORDER BY i) FROM wt WHERE wt.doc_id = b.doc_id)", "coalesce(g.x, [])").replace("FROM b)", "FROM b LEFT JOIN (SELECT doc_id, list(x ORDER BY i) AS x FROM wt GROUP BY doc_id) g USING (doc_id))")
AVG = f"av AS (SELECT *, len(x) AS n, coalesce(list_sum(x), 0) AS a, coalesce(list_sum(list_transform(x, lambda v: v * v)), 0) AS q FROM cu), me AS (SELECT *, CASE WHEN n > 0 THEN {ONE.replace('x', '(a::DOUBLE / greatest(n, 1))', 1)} ELSE 0 END AS m FROM av)"
STATS = f"es AS (SELECT doc_id, len, x, n::INT AS windows, m AS avg_intensity, CASE WHEN n > 1 THEN sqrt((q * n - a * a)::DOUBLE) / n * 0.7::DOUBLE / 50::DOUBLE * CASE WHEN len < 2000 THEN greatest(0.3::DOUBLE, len::DOUBLE / 2000) ELSE 1 END ELSE 0 END AS intensity_variance, len(list_filter(x, lambda v: {ONE.replace('x', 'v', 1)} >= greatest(CASE WHEN m > 0 THEN m * 1.5::DOUBLE ELSE 0.5 END, 0.2::DOUBLE)))::INT AS peak_count FROM me)"
MSE = lambda v: "(" + " + ".join(f"(s[{k + 1}] - {y}::DOUBLE) * (s[{k + 1}] - {y}::DOUBLE)" for k, y in enumerate(v)) + ") / 8"
ARC = (
    f"ar AS (SELECT *, list_min(x) AS lo, list_max(x) AS hi FROM es), as_ AS (SELECT *, CASE WHEN windows >= 4 AND ({ONE.replace('x', 'hi', 1)}) - ({ONE.replace('x', 'lo', 1)}) >= 0.01::DOUBLE THEN list_transform(range(8), lambda j: (x[(j * (windows - 1)) // 7 + 1] - lo)::DOUBLE / (hi - lo)) END AS s FROM ar), "
    f"ab AS (SELECT *, CASE WHEN s IS NOT NULL THEN list_min([{', '.join(f'{{e: {MSE(v)}, o: {k}, name: {chr(39)}{name}{chr(39)}}}' for k, (name, v) in enumerate(V.ARCS.items()))}]) END AS best FROM as_), "
    "ac AS (SELECT *, CASE WHEN windows < 4 THEN 'unknown' WHEN s IS NULL THEN 'flat' ELSE best.name END AS arc, CASE WHEN windows < 4 THEN 0 WHEN s IS NULL THEN 0.5 ELSE greatest(0::DOUBLE, 1 - best.e) END::DOUBLE AS confidence FROM ab)"
)
BOTH = {**V.EMOTIONS, **V.RHYTHM_EXTRA}
SEG = f"sg AS (SELECT doc_id, i::INT AS i, substr(t, i * z + 1, CASE WHEN i < 39 THEN z ELSE length(t) END) AS w FROM (SELECT doc_id, t, greatest(length(t) // 40, 1) AS z, unnest(range(40)) AS i FROM b WHERE length(t) >= 100)), sc AS (SELECT doc_id, i, w, CASE WHEN length(w) > 0 THEN least(({WEIGHT(BOTH)}) * 10 / length(w)::DOUBLE, 3::DOUBLE) ELSE 0 END AS intensity FROM sg)"
LISTED = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
TOP = lambda src, ws: f"kw AS (SELECT doc_id, e, sum(((length(w) - length(replace(w, e, ''))) // length(e))) AS n FROM {src}, (SELECT unnest({LISTED(ws)}) AS e) GROUP BY doc_id, e), kr AS (SELECT doc_id, e AS word, n::INT AS n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, e) - 1 AS rank FROM kw WHERE n > 0) SELECT doc_id, rank::INT AS rank, word, n FROM kr WHERE rank < 15"
DRAW = lambda c: f"('0x' || substr(md5(doc_id || '{c}' || j), 1, 6))::INT"
HDD = f"hr AS (SELECT doc_id, regexp_extract_all(t, '{HAN}+') AS r FROM h), hj AS (SELECT doc_id, r, unnest(range(1, least(42, greatest(len(r) // 10, 1)) + 1)) AS j FROM hr), hs AS (SELECT doc_id, r, j, least({DRAW('a')} % 16 + 35, len(r)) AS size, {DRAW('b')} AS k FROM hj), hh AS (SELECT doc_id, j, list_slice(r, k % greatest(len(r) - size + 1, 1) + 1, k % greatest(len(r) - size + 1, 1) + size) AS s FROM hs), hx AS (SELECT doc_id, list(len(list_distinct(s))::DOUBLE / greatest(len(s), 1) ORDER BY j) AS x FROM hh GROUP BY doc_id), hd AS (SELECT hr.doc_id, CASE WHEN len(r) = 0 THEN 0 ELSE list_reduce(list_prepend(0::DOUBLE, x), lambda a, y: a + y) / len(x) * 0.9::DOUBLE END AS hd_d FROM hr LEFT JOIN hx USING (doc_id))"
MATTR = f"mr AS (SELECT doc_id, regexp_extract_all(t, '{HAN}+') AS r FROM h), mx AS (SELECT doc_id, r, len(r) AS n, list_transform(generate_series(0, greatest(len(r) - 50, 0), greatest(1, greatest(len(r) - 50, 1) // 30)), lambda i: len(list_distinct(list_slice(r, i + 1, i + 50)))) AS d FROM mr), ma AS (SELECT doc_id, CASE WHEN n < 50 THEN 0 ELSE list_sum(d)::DOUBLE / (len(d) * 50) END AS mattr FROM mx)"
FLESCH = f"206.835::DOUBLE - 1.015::DOUBLE * ({N(WIDE)} / greatest(len({SENT(2)}), 1)::DOUBLE) - 8.46::DOUBLE"
PAIRS = f"ch AS (SELECT string_split('{ALPHABET}', '') AS c), pr AS (SELECT (row_number() OVER (ORDER BY i, j) - 1)::INT AS k, c[i] || c[j] AS word FROM ch, range(1, {len(ALPHABET)} + 1) x(i), range(1, {len(ALPHABET)} + 1) y(j) WHERE i <> j), lex AS (SELECT word, {LISTED(KINDS)}[k % 7 + 1] AS category, ['ban', 'warn', 'limit'][k % 3 + 1] AS severity FROM pr)"
HITS = "lh AS (SELECT doc_id, word, category, severity, (length(t) - length(replace(t, word, ''))) // 2 AS n FROM h, lex WHERE contains(t, word))"
HAN_OF = f"hn AS MATERIALIZED (SELECT doc_id, t, {DENSE} AS han FROM h)"
LBL = f"{HAN_OF}, lg AS (SELECT doc_id, sum(n) AS n FROM lh GROUP BY doc_id), lb AS (SELECT doc_id, coalesce(n, 0)::INT AS blacklist_total_hits, coalesce(n, 0) * 100 / han AS blacklist_density FROM hn LEFT JOIN lg USING (doc_id))"
OVER = f"{HAN_OF}, ov AS (SELECT doc_id, k, word, (length(t) - length(replace(t, word, ''))) // length(word) AS count, ((length(t) - length(replace(t, word, ''))) // length(word)) * 1000 / han AS rate FROM hn, (SELECT unnest({LISTED(V.OVERUSED)}) AS word, unnest(range({len(V.OVERUSED)})) AS k)), ou AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY round(rate, 2) DESC, k) - 1)::INT AS rank, word, count::INT AS count, round(rate, 2) AS per_1k FROM ov WHERE rate > 2.005::DOUBLE)"
RULE = f"{PAIRS}, ru AS (SELECT {LISTED(CHECKS)}[(k // 8) % 5 + 1] AS chk, word, ['ban', 'warn', 'info'][(k // 8) % 3 + 1] AS severity FROM pr WHERE k % 8 = 0)"
ISSUES = (
    rf"ll AS (SELECT doc_id, x, i FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM h), unnest(ls) WITH ORDINALITY AS u(x, i)), il AS (SELECT doc_id, chk, word, severity, i::INT AS line, left({STRIP('x')}, 80) AS context, NULL::INT AS count, NULL::DOUBLE AS per_1k FROM ll JOIN ru ON contains(x, word) WHERE chk NOT IN ('adverb_abuse', 'dialogue_tags')), "
    f"de AS (SELECT doc_id, chk, word, severity, -1 AS line, '' AS context, (length(t) - length(replace(t, word, ''))) // 2 AS count, ((length(t) - length(replace(t, word, ''))) // 2) * 1000 / {DENSE} AS per_1k FROM h, ru WHERE chk IN ('adverb_abuse', 'dialogue_tags')), iss AS (SELECT * FROM il UNION ALL SELECT doc_id, chk, word, severity, line, context, count::INT, per_1k FROM de WHERE per_1k > 2.0)"
)
STARTS = f"list_transform(list_filter(list_transform(regexp_split_to_array({STRIP('t')}, '[。！？…]'), lambda x: {STRIP('x')}), lambda x: length(x) > 3), lambda x: left(x, 2))"
QUICK = f"qs AS (SELECT doc_id, {N(HAN + '{1,3}地')} / ({DENSE} / 100) AS a, {STARTS} AS s, {COUNT('！')} / ({DENSE} / 100) AS e, {COUNT('了')} / ({DENSE} / 100) AS l FROM h), qy AS (SELECT *, len(list_filter(range(1, len(s)), lambda i: s[i] = s[i + 1])) AS r FROM qs), qk AS (SELECT doc_id, 'adverb_abuse' AS type, 'warn' AS severity FROM qy WHERE a > 2 UNION ALL SELECT doc_id, 'repetition', 'warn' FROM qy WHERE r > 1 UNION ALL SELECT doc_id, 'exclamation', 'info' FROM qy WHERE e > 5 UNION ALL SELECT doc_id, 'filler', 'info' FROM qy WHERE l > 8), few AS (SELECT doc_id FROM h WHERE length(t) < 2000), qf AS (SELECT * FROM qk WHERE doc_id IN (FROM few))"
SEVERAL = "count(severity) AS total, count(*) FILTER (severity = 'ban') AS ban, count(*) FILTER (severity = 'warn') AS warn, count(*) FILTER (severity = 'info') AS info"
SPREAD = lambda c: f"(CASE WHEN count(*) > 1 AND avg({c}) > 0 THEN round(stddev_pop({c}) / avg({c}), 3) ELSE 0 END)"
TEMPLATES = (
    f"tc AS (SELECT book, left(array_to_string(regexp_extract_all(t, '{HAN}+'), ''), 8) AS o, length(t) AS n, len(regexp_extract_all(t, '[「\"][^」\"]+[」\"]')) / greatest({DENSE} / 100, 1::DOUBLE) AS d FROM h), to_ AS (SELECT book, o, count(*) AS c FROM tc GROUP BY ALL), tr AS (SELECT book, count(*) FILTER (c >= 2 AND length(o) = 8) AS repeated_openings FROM to_ GROUP BY book), "
    f"tg AS (SELECT book, count(*) AS chapters, count(*) FILTER (n > 0) AS k, sum(n) AS a, sum(n * n) AS q, {SPREAD('d')}::DOUBLE AS dialogue_cv FROM tc GROUP BY book), tv AS (SELECT book, chapters, CASE WHEN chapters > 1 THEN repeated_openings ELSE 0 END AS repeated_openings, CASE WHEN k > 1 AND a > 0 THEN round(sqrt((q * k - a * a)::DOUBLE) / a, 3) ELSE 0 END::DOUBLE AS length_cv, dialogue_cv FROM tr JOIN tg USING (book))"
)
LOW = lambda x, by: f"greatest(0, trunc((0.3::DOUBLE - least({x}, 0.3::DOUBLE)) * {by}::DOUBLE)::INT)"

SQL = {
    "em01_windows": f"WITH {H}, {BODY}, {WIN} SELECT doc_id, i, {ONE} AS intensity FROM wt",
    "em03_curve_stats": f"WITH {H}, {BODY}, {WIN}, {CURVE}, {AVG}, {STATS} SELECT doc_id, windows, avg_intensity, intensity_variance, peak_count FROM es",
    "em04_keywords": f"WITH {H}, {BODY}, {WIN}, {TOP('wi', V.EMOTIONS)}",
    "em05_arcs": f"WITH {H}, {BODY}, {WIN}, {CURVE}, {AVG}, {STATS}, {ARC} SELECT doc_id, arc, confidence FROM ac",
    "em06_report": f"WITH {H}, {BODY}, {WIN}, {CURVE}, {AVG}, {STATS}, {ARC} SELECT doc_id, CASE WHEN len < 100 THEN 'Text too short' END AS error, " + ", ".join(f"CASE WHEN len >= 100 THEN {c} END AS {c}" for c in ("windows", "avg_intensity", "intensity_variance", "peak_count", "arc", "confidence")) + " FROM ac",
    "st09_hd_d": f"WITH {H}, {HDD} SELECT doc_id, hd_d FROM hd",
    "st11_lexical_diversity": f"WITH {H}, {HDD}, {MATTR} SELECT doc_id, mattr, hd_d FROM hd JOIN ma USING (doc_id)",
    "st12_book_chapters": f"WITH {H}, {CHAP} SELECT book, chapter_no, {N(WIDE)} AS chinese_chars FROM c",
    "st13_readout_book": f"WITH {H}, {CHAP}, x AS (SELECT book, chapter_no, {FLESCH} AS f FROM c), y AS (SELECT book, count(*) AS chapters, round(avg(f), 6) AS mean, regr_slope(f, chapter_no::DOUBLE) AS s FROM x GROUP BY book) SELECT book, chapters, mean, CASE WHEN chapters >= 3 AND s > 0.3 THEN 'easier' WHEN chapters >= 3 AND s < -0.3 THEN 'harder' ELSE 'stable' END AS trend FROM y",
    "st13_series": f"WITH {H}, {CHAP} SELECT book, chapter_no, {FLESCH} AS flesch_zh FROM c",
    "st22_rhythm": f"WITH {H}, {BODY}, {SEG} SELECT doc_id, i, intensity FROM sc",
    "st22_rhythm_report": f"WITH {H}, {BODY}, {SEG}, x AS (SELECT doc_id, list(intensity ORDER BY i) AS c FROM sc GROUP BY doc_id), y AS (SELECT doc_id, c, list_reduce(list_prepend(0::DOUBLE, c), lambda a, v: a + v) / 40 AS m FROM x) SELECT doc_id, m AS avg_intensity, len(list_filter(c, lambda v: v >= CASE WHEN m > 0 THEN m * 1.5::DOUBLE ELSE 0.5 END AND v > 0.2::DOUBLE))::INT AS peak_count FROM y",
    "st22_rhythm_keywords": f"WITH {H}, {BODY}, {SEG}, {TOP('sg', BOTH)}",
    "sl07_report": f"WITH {H}, {DIV}, {SHAPE}, {STRUCT}, {PAIRS}, {HITS}, {LBL}, {PHR} SELECT dv.*, sh.* EXCLUDE (doc_id), len(f)::INT AS structure_pattern_count, array_to_string(f, ',') AS structure_patterns, lb.* EXCLUDE (doc_id), ph.* EXCLUDE (doc_id) FROM dv JOIN sh USING (doc_id) JOIN st USING (doc_id) JOIN lb USING (doc_id) JOIN ph USING (doc_id)",
    "sl09_score_ai_risk": f"WITH {H}, {DIV}, {SHAPE}, {STRUCT}, {PAIRS}, {HITS}, {LBL}, {PHR}, s AS (SELECT dv.doc_id, {CUT('(0.6::DOUBLE - ttr) * 250::DOUBLE')} AS ttr, {CUT('(0.7::DOUBLE - sentence_len_cv) * 250::DOUBLE')} AS sentence_variance, least(100, len(f) * 20)::INT AS structure, least(100, trunc(blacklist_density * 15::DOUBLE)::INT) AS blacklist, {CUT('(repetition_score - 0.3::DOUBLE) * 250::DOUBLE')} AS repetition, least(100, phrase_repetition_score)::INT AS phrase_rep FROM dv JOIN sh USING (doc_id) JOIN st USING (doc_id) JOIN lb USING (doc_id) JOIN ph USING (doc_id)), z AS (SELECT *, 4 * ttr + 3 * sentence_variance + 3 * structure + 4 * blacklist + 3 * repetition + 3 * phrase_rep AS total FROM s) SELECT * EXCLUDE (total), CASE WHEN total < 600 THEN 'low' WHEN total < 1200 THEN 'middle' ELSE 'high' END AS verdict, round_even(total / 20::DOUBLE, 0)::INT AS total_score FROM z",
    "sl15_phrases": f"WITH {H}, {PHR} SELECT * FROM ph",
    "ln08_lint_book": f"WITH {H}, {RULE}, {ISSUES} SELECT book, count(*) AS total, count(*) FILTER (severity = 'ban') AS ban, count(*) FILTER (severity = 'warn') AS warn, count(DISTINCT chk) AS unique_checks FROM iss JOIN h USING (doc_id) WHERE severity <> 'info' GROUP BY book",
    "sl08_lexicon": f"WITH {H}, {PAIRS}, {HITS}, {LBL} SELECT * FROM lb",
    "sl08_lexicon_top": f"WITH {H}, {PAIRS}, {HITS}, r AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) - 1)::INT AS rank, word, n::INT AS n FROM lh) SELECT * FROM r WHERE rank < 20",
    "sl10_linguistic": f"WITH {H}, x AS (SELECT doc_id, t, list_transform({SENT(0)}, lambda x: {N(HAN, 'x')}) AS s, regexp_extract_all(t, '{HAN}+') AS r FROM h), y AS (SELECT doc_id, t, r, len(s) AS n, coalesce(list_sum(s), 0) AS a, coalesce(list_sum(list_transform(s, lambda x: x * x)), 0) AS q, {' + '.join(COUNT(w) for w in V.GLAD)} AS g, {' + '.join(COUNT(w) for w in V.SAD)} AS b FROM x) SELECT doc_id, a::DOUBLE / greatest(n, 1) AS avg_sentence_len, CASE WHEN a > 0 THEN sqrt((q * n - a * a)::DOUBLE) / a ELSE 0 END AS sentence_len_cv, len(list_distinct(r))::DOUBLE / greatest(len(r), 1) AS ttr, (g - b)::DOUBLE / greatest(g + b, 1) AS sentiment, {N('[' + V.MARKS.replace(chr(39), chr(39) * 2) + ']')} * 100 / {DENSE} AS punct_density, {N('[' + V.STOP + ']')} / {DENSE} AS stopword_ratio FROM y",
    "sl13_overused": f"WITH {H}, {OVER} SELECT * FROM ou WHERE rank < 20",
    "sl13_suggestions": f"WITH {H}, {OVER}, g AS (SELECT doc_id, count(*) AS n, string_agg(word, '、' ORDER BY rank) FILTER (rank < 5) AS w FROM ou GROUP BY doc_id) SELECT h.doc_id, coalesce(n, 0)::INT AS overused_count, CASE WHEN n > 0 THEN '{V.OVERUSED_SAID[0][0]}' || w || '{V.OVERUSED_SAID[0][1]} {V.OVERUSED_SAID[1]}' ELSE '' END AS suggestions FROM h LEFT JOIN g USING (doc_id)",
    "sl16_contains": f"WITH {H}, {PAIRS}, {HITS} SELECT doc_id, word, category, severity FROM lh",
    "sl17_by_severity": f"WITH {PAIRS} SELECT * FROM lex WHERE severity = 'limit'",
    "sl17_by_category": f"WITH {PAIRS} SELECT * FROM lex WHERE category = 'cliche'",
    "sl18_templates": f"WITH {H}, {TEMPLATES} SELECT book, repeated_openings, length_cv, dialogue_cv, CASE WHEN chapters > 1 THEN least(100, repeated_openings * 15 + {LOW('length_cv', 100)} + {LOW('dialogue_cv', 80)}) ELSE 0 END::INT AS template_score FROM tv",
    "sl18_openings": f"WITH {H}, {TEMPLATES}, r AS (SELECT book, (row_number() OVER (PARTITION BY book ORDER BY c DESC, o) - 1)::INT AS rank, o AS opening, c AS n FROM to_ WHERE c >= 2 AND length(o) = 8) SELECT * FROM r WHERE rank < 5",
    "ln01_rules": f"WITH {H}, {RULE}, {ISSUES} SELECT doc_id, chk AS \"check\", word AS pattern, severity, line, context, count, per_1k FROM iss WHERE severity <> 'info'",
    "ln04_checks": f"WITH {H}, {RULE}, {ISSUES} SELECT doc_id, chk AS \"check\", word AS pattern, line FROM iss WHERE chk IN ('weasel', 'dialogue_tags')",
    "ln05_summary": f"WITH {H}, {RULE}, {ISSUES}, i AS (SELECT * FROM iss WHERE severity <> 'info') SELECT doc_id, {SEVERAL} FROM h LEFT JOIN i USING (doc_id) GROUP BY doc_id",
    "ln07_issues": f"WITH {H}, {RULE}, {ISSUES}, {QUICK} SELECT doc_id, chk AS \"check\", severity FROM iss WHERE severity <> 'info' UNION ALL SELECT * FROM qf",
    "ln07_summary": f"WITH {H}, {RULE}, {ISSUES}, {QUICK}, i AS (SELECT doc_id, severity FROM iss WHERE severity <> 'info' AND doc_id NOT IN (FROM few) UNION ALL SELECT doc_id, severity FROM qf) SELECT doc_id, {SEVERAL} FROM h LEFT JOIN i USING (doc_id) GROUP BY doc_id",
}
