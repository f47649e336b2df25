"""The operators' queries over the driver's tables, and the same results in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from proselens.functions import fixed_values as V
from proselens.operators import consistency, emotion, outline, reviews, stats, store, style
from proselens.plans import measures, pages, stores, validation
from proselens.plans.base import CHAP, COUNT, DENSE, DIV, HAN, N, PARA, SENT, SHAPE, STRIP, STRUCT, WIDE, H
from proselens.sources.tables import CHINESE, LATIN, chapters, dealt, documents, table

#: Operators that fit one call on documents.
ON_DOCUMENTS = {
    "st01_count_chapter": stats.count_chapter,
    "st08_mattr": lambda d: stats.mattr(d, 50),
    "st10_readability": stats.readability,
    "st14_pacing": stats.pacing,
    "sl02_diversity": style.diversity,
    "sl04_sentence_shape": style.sentence_shape,
    "sl05_structures": style.structures,
    "sl14_weasel": style.weasel,
    "sl15_phrases": style.phrases,
    "sl12_repetition": style.repetition,
    "ln06_quick_scan": style.quick_scan,
    "cn01_names": lambda d: consistency.names(d, ["王宁", "安平", "红沉"]),
    "cn01_surnames": consistency.surnames,
    "cn02_pronouns": lambda d: consistency.pronouns(d).drop("snippet"),
}
#: Rare characters of the translated tables as time markers and as words of reviews, so that those operators meet some.
MARKERS = [("天", "深夜"), ("王", "3天后"), ("”", "清晨"), ("次", "当天")]
OPINIONS = [("天", "爽快"), ("次", "节奏"), ("王", "不"), ("”", "老套"), ("后", "混乱")]


def pairs(spark, d):
    return store.shared(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("place"), F.col("l_suppkey").alias("id")))


def people(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.col("c_mktsegment"), (F.col("c_custkey") % 50).cast("string")).alias("name"))


def swap(c, words):
    for a, b in words:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def marked(spark, d, of=documents):
    return of(spark, d).withColumn("text", swap(F.col("text"), MARKERS))


def opinions(spark, d):
    return documents(spark, d).select(F.col("doc_id").alias("id"), swap(F.col("text"), OPINIONS).alias("text"))


def rules(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("rule_id"), F.translate(F.lower("text"), LATIN, CHINESE).alias("content"))


def outlines(spark, d):
    """An outline of every language: a goal, and each item of the benchmark as a checkpoint."""
    points = table(spark, d, "benchmark").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("- "), F.regexp_replace(F.translate(F.lower("text"), LATIN, CHINESE), r"\s+", " ")))), "\n").alias("p"))
    langs = table(spark, d, "documents").select("lang").distinct()
    return langs.crossJoin(points).select(F.col("lang").alias("outline_id"), F.concat(F.lit("---\nlevel: volume\n---\n# "), "lang", F.lit("\n\n## 叙事目标\n平静\n\n## 检查点\n"), "p").alias("text"))


def planned(spark, d):
    return documents(spark, d).join(table(spark, d, "documents").select("doc_id", F.col("lang").alias("outline_id")), "doc_id")


#: Rare characters as words that hint at something.
HINTED = [("天", "似乎"), ("王", "感到"), ("次", "如果"), ("”", "知道"), ("后", "后来")]


def hinted(spark, d):
    return documents(spark, d).withColumn("text", swap(F.col("text"), HINTED))


#: Those that read a text once, in Arrow batches.
ONE_PASS = {"st14_pacing", "sl02_diversity", "sl04_sentence_shape", "sl05_structures", "sl15_phrases"}
QUERIES = {k: (lambda spark, d, f=f, of=dealt if k in ONE_PASS else documents: f(of(spark, d))) for k, f in ON_DOCUMENTS.items()} | {
    "st12_count_book": lambda s, d: stats.count_book(chapters(s, d)),
    "bb03_duplicates": lambda s, d: store.duplicates(people(s, d)),
    "bb04_aliases": lambda s, d: store.aliases(table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.substring("s_name", -3, 3), F.lit("x")).alias("name"))),
    "bb05_graph": lambda s, d: store.graph(pairs(s, d)),
    "bb05_degrees": lambda s, d: store.degrees(pairs(s, d)),
    "cn07_time_marks": lambda s, d: consistency.time_marks(marked(s, d)),
    "cn08_time_issues": lambda s, d: consistency.time_issues(marked(s, d)),
    "cn09_between_chapters": lambda s, d: consistency.time_between_chapters(marked(s, d, chapters)),
    "bb08_hints": lambda s, d: consistency.hints(hinted(s, d)),
    "bb10_conflicts": lambda s, d: consistency.conflicts(documents(s, d), rules(s, d)),
    "vl01_dimensions": lambda s, d: reviews.dimensions(opinions(s, d)),
    "ht01_clean_pages": lambda s, d: reviews.clean_pages(table(s, d, "pages")),
    "ht09_clean_titles": lambda s, d: reviews.clean_titles(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("全文"), "p_name", F.lit("（完整版）")).alias("title"))),
    "ol01_outlines": lambda s, d: outline.parse(outlines(s, d)).select("outline_id", "title", "level", "goal", F.size("checkpoints").alias("points")),
    "ol03_compare": lambda s, d: outline.compare(planned(s, d), outline.checkpoints(outlines(s, d))).drop("extra"),
    "ol04_summarize": lambda s, d: outline.summarize(planned(s, d), outline.checkpoints(outlines(s, d))),
}

SPOKEN = "array_to_string(regexp_extract_all(t, '「([^」]*)」', 1), '') || array_to_string(regexp_extract_all(t, '“([^”]*)”', 1), '')"
ONCE = lambda ws: " + ".join(f"contains(t, '{w}')::INT" for w in ws)
PAT = lambda k: " + ".join(N(p) for c, p in V.WEASEL_PATTERNS if c == k)
ORDERS = "i AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem), pr AS (SELECT x.s AS a, y.s AS b FROM i x JOIN i y USING (o) WHERE x.s <> y.s), g AS (SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS weight, count(*) AS times FROM pr GROUP BY ALL)"

def _swapped(c, words):
    for a, b in words:
        c = f"replace({c}, '{a}', '{b}')"
    return c


def _dims():
    said = lambda w, s: f"WHEN strpos(t, '{w}') > 0 THEN CASE WHEN regexp_matches(substr(t, greatest(strpos(t, '{w}') - 5, 1), least(strpos(t, '{w}') - 1, 5)), '{'|'.join(V.REVIEW_NEGATIONS)}') THEN '{'positive' if s == 'negative' else 'negative'}' ELSE '{s}' END"
    ordered = sorted(V.REVIEW_WORDS, key=lambda r: -len(r[0]))
    each = [f"SELECT id, '{d}' AS dimension, CASE {' '.join(said(w, s) for w, x, s in ordered if x == d)} END AS sentiment FROM r" for d in dict.fromkeys(x for _, x, _ in ordered)]
    return f"r AS (SELECT doc_id AS id, {_swapped('t', OPINIONS)} AS t FROM h) SELECT * FROM ({' UNION ALL '.join(each)}) WHERE sentiment IS NOT NULL"


PLACES = " UNION ALL ".join(f"SELECT doc_id, {k} AS ord, '{g}' AS tag, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS h FROM mt WHERE regexp_matches(t, '{p}')" for k, (p, g) in enumerate(V.TIMES))
NUMBERED = ", ".join(str(k) for k, (p, _) in enumerate(V.TIMES) if "(" in p)
MARKS = f"mt AS (SELECT doc_id, {_swapped('t', MARKERS)} AS t FROM h), mp AS ({PLACES}), mi AS (SELECT doc_id, ord, tag, g, h, unnest(range(1, len(h) + 1)) AS i FROM mp), m AS (SELECT doc_id, ord, tag, (sum(length(g[i]) + length(h[i])) OVER (PARTITION BY doc_id, ord ORDER BY i) - length(h[i]))::INT AS position, CASE WHEN ord IN ({NUMBERED}) THEN regexp_extract(h[i], '[0-9]+')::BIGINT END AS value FROM mi)"
TAGS = "tg AS (SELECT doc_id, list(tag ORDER BY position, ord) AS tags FROM m GROUP BY doc_id), tc AS (SELECT c.book, c.chapter_no, c.doc_id, tags FROM c JOIN tg USING (doc_id))"
PER = f"({DENSE} / 100)"
STARTS = f"list_transform(list_filter(list_transform(regexp_split_to_array({STRIP('t')}, '[。！？…]'), lambda x: {STRIP('x')}), lambda x: length(x) > 3), lambda x: left(x, 2))"
CHUNKS = lambda c: f"unnest(list_distinct(regexp_extract_all({c}, '{HAN}{{2,5}}')))"

SQL = {
    "st01_count_chapter": f"WITH {H} SELECT doc_id, {N(WIDE)} AS chinese_chars, length(replace(replace(t, chr(10), ''), chr(13), '')) AS total_chars, len({PARA}) AS paragraphs, len(regexp_extract_all(t, '「[^」]*」|“[^”]*”|\"[^\"]+\"')) AS dialogue_lines, {N(WIDE)} AS words, CASE WHEN regexp_extract(t, '(?m)^#\\s+(.+)', 1) <> '' THEN regexp_extract(t, '(?m)^#\\s+(.+)', 1) ELSE 'ch' || doc_id END AS title FROM h",
    "st08_mattr": f"WITH {H}, r AS (SELECT doc_id, regexp_extract_all(t, '{HAN}+') AS r FROM h), x AS (SELECT doc_id, r, len(r) AS n, list_transform(generate_series(0, greatest(len(r) - 50, 0), greatest(1, greatest(len(r) - 50, 1) // 30)), lambda i: len(list_distinct(list_slice(r, i + 1, i + 50)))) AS d FROM r) SELECT doc_id, CASE WHEN n < 50 THEN 0 ELSE list_sum(d)::DOUBLE / (len(d) * 50) END AS mattr FROM x",
    "st10_readability": f"WITH {H}, x AS (SELECT doc_id, {N(WIDE)} AS w, {SENT(2)} AS s FROM h) SELECT doc_id, 206.835::DOUBLE - 1.015::DOUBLE * (w / greatest(len(s), 1)::DOUBLE) - 0.846::DOUBLE * 10::DOUBLE AS flesch_zh, w / greatest(len(s), 1)::DOUBLE AS avg_sentence_len, len(list_filter(s, lambda x: {N(HAN, 'x')} > 40)) / greatest(len(s), 1)::DOUBLE AS long_sentence_ratio FROM x",
    "st14_pacing": f"WITH {H}, x AS (SELECT doc_id, t, {N(HAN)} AS h, {N(HAN, '(' + SPOKEN + ')')} AS d, {PARA} AS p FROM h) SELECT doc_id, d / greatest(h, 1)::DOUBLE AS dialogue_ratio, (h - d) / greatest(h, 1)::DOUBLE AS narration_ratio, {' + '.join(N(p) for p in V.DESCRIPTION)} AS description_hints, len(p) AS paragraphs, coalesce(list_sum(list_transform(p, lambda x: {N(HAN, 'x')})), 0)::DOUBLE / greatest(len(p), 1) AS avg_paragraph_len, len(p) * 1000 / greatest(h, 1)::DOUBLE AS paragraph_density, len(regexp_extract_all(t, '(?m)^[-*]{{3,}}\\s*$')) AS scene_changes, d / greatest(h, 1)::DOUBLE AS show_vs_tell, {N('[' + V.ACTION + ']')} * 1000 / greatest(h, 1)::DOUBLE AS action_density FROM x",
    "sl02_diversity": f"WITH {H}, {DIV} SELECT * FROM dv",
    "sl04_sentence_shape": f"WITH {H}, {SHAPE} SELECT * FROM sh",
    "sl05_structures": f"WITH {H}, {STRUCT} SELECT doc_id, len(f) AS structure_pattern_count, array_to_string(f, ',') AS structure_patterns FROM st",
    "sl14_weasel": f"WITH {H}, x AS (SELECT doc_id, {ONCE(V.WEASEL)} + {PAT('weasel')} AS weasel, {ONCE(V.HEDGE)} + {PAT('hedge')} AS hedge, {PAT('cliche_structure')} AS cliche_structure FROM h) SELECT *, weasel + hedge + cliche_structure AS total_hits FROM x",
    "st12_count_book": f"WITH {H}, {CHAP}, x AS (SELECT book, chapter_no, {N(WIDE)} AS n, regexp_matches(right(t, 500), '完|终|…|END') AS e FROM c) SELECT book, count(*) AS chapters, sum(n)::BIGINT AS total_chars, (sum(n) // count(*))::BIGINT AS avg_chars, arg_max(e, chapter_no) AS completed FROM x GROUP BY book",
    "bb03_duplicates": "WITH p AS (SELECT c_custkey AS id, c_mktsegment || (c_custkey % 50)::VARCHAR AS name FROM customer), x AS (SELECT name, lag(id) OVER (PARTITION BY name ORDER BY id) AS prior, id FROM p) SELECT * FROM x WHERE prior IS NOT NULL",
    "bb04_aliases": "WITH p AS (SELECT s_suppkey AS id, right(s_name, 3) || 'x' AS name FROM supplier), n AS (SELECT min(id) AS id, name FROM p GROUP BY name), q AS (SELECT id, name, left(name, 1) AS f, list_distinct(string_split(name[2:], '')) AS r FROM n), x AS (SELECT a.id AS a, b.id AS b, 40 + least(len(list_intersect(a.r, b.r)) * 15, 30) + CASE WHEN abs(length(a.name) - length(b.name)) <= 1 THEN 10 ELSE 0 END AS score FROM q a JOIN q b ON a.f = b.f AND a.id < b.id UNION ALL SELECT q.id, p.id, 50 + least(len(q.r) * 15, 30) FROM p JOIN q USING (name) WHERE p.id <> q.id) SELECT a, b, score, CASE WHEN score >= 70 THEN 'merge' ELSE 'review' END AS action FROM x WHERE score >= 50",
    "bb05_graph": f"WITH {ORDERS} SELECT * FROM g",
    "bb05_degrees": f"WITH {ORDERS} SELECT node, sum(weight)::BIGINT AS degree FROM (SELECT a AS node, weight FROM g UNION ALL SELECT b, weight FROM g) GROUP BY node",
    "ln06_quick_scan": f"WITH {H}, x AS (SELECT doc_id, {N(HAN + '{1,3}地')} / {PER} AS a, {STARTS} AS s, {COUNT('！')} / {PER} AS e, {COUNT('了')} / {PER} AS l FROM h), y AS (SELECT *, len(list_filter(range(1, len(s)), lambda i: s[i] = s[i + 1]))::DOUBLE AS r FROM x) SELECT doc_id, 'adverb_abuse' AS type, 'warn' AS severity, a AS amount FROM y WHERE a > 2 UNION ALL SELECT doc_id, 'repetition', 'warn', r FROM y WHERE r > 1 UNION ALL SELECT doc_id, 'exclamation', 'info', e FROM y WHERE e > 5 UNION ALL SELECT doc_id, 'filler', 'info', l FROM y WHERE l > 8",
    "cn01_names": f"WITH {H}, x AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(t, '{HAN}([，。！？、：；\"」』）)\\s])', '\\1', 'g'), '[{V.SURNAMES}]{HAN}{{1,2}}')) AS name FROM h), y AS (SELECT doc_id, name, count(*) AS n, name IN ('王宁', '安平', '红沉') AS known FROM x GROUP BY doc_id, name) SELECT * FROM y WHERE known OR n >= 2",
    "cn01_surnames": f"WITH {H}, x AS (SELECT doc_id, left(unnest(regexp_extract_all(t, '(?s)[{V.SURNAMES}](?:[^一-鿿]|$)')), 1) AS surname FROM h) SELECT doc_id, surname, count(*) AS n FROM x GROUP BY ALL HAVING count(*) >= 3",
    "cn02_pronouns": f"WITH {H}, x AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '\\n\\s*\\n'), lambda x: {STRIP('x')}), lambda x: x <> '') AS ps FROM h), y AS (SELECT doc_id, unnest(range(len(ps))) AS i, ps FROM x), z AS (SELECT doc_id, i::INT AS paragraph, {N('[他她]', 'ps[i + 1]')}::INT AS pronouns, len(list_distinct(regexp_extract_all(ps[i + 1], '({HAN}{{2,3}})[，。！？、；：]', 1)))::INT AS named FROM y) SELECT * FROM z WHERE pronouns >= 5 AND named >= 2",
    "cn07_time_marks": f"WITH {H}, {MARKS} SELECT doc_id, position, ord, tag, value FROM m",
    "cn08_time_issues": f"WITH {H}, {MARKS}, x AS (SELECT doc_id, position, lag(tag) OVER (PARTITION BY doc_id ORDER BY position, ord) AS before, tag FROM m) SELECT * FROM x WHERE before IN ('days_later', 'months_later', 'years_later') AND tag = 'same_day'",
    "cn09_between_chapters": f"WITH {H}, {CHAP}, {MARKS}, {TAGS} SELECT b.book, b.chapter_no, b.doc_id FROM tc a JOIN tc b ON a.book = b.book AND a.chapter_no + 1 = b.chapter_no WHERE list_has_any(a.tags[-3:], ['days_later', 'months_later', 'years_later', 'time_skip_long']) AND list_has_any(b.tags[1:3], ['same_day', 'next_day', 'early_morning'])",
    "bb10_conflicts": f"WITH {H}, a AS (SELECT doc_id, {CHUNKS('t')} AS k FROM h WHERE regexp_matches(t, '{'|'.join(V.RULE_NEGATIONS)}')), b AS (SELECT item_id AS rule_id, {CHUNKS(f'translate(lower(text), {chr(39)}{LATIN}{chr(39)}, {chr(39)}{CHINESE}{chr(39)})')} AS k FROM benchmark) SELECT doc_id, rule_id, count(*) AS shared FROM a JOIN b USING (k) GROUP BY doc_id, rule_id HAVING count(*) > 3",
    "bb08_hints": f"WITH {H}, x AS (SELECT doc_id, {_swapped('t', HINTED)} AS t FROM h), y AS (SELECT doc_id, list_transform(list_filter(list_concat({', '.join(f'regexp_extract_all(t, {chr(39)}{p}{chr(39)})' for p in V.HINTS)}), lambda v: length(v) > 5), lambda v: {STRIP('v')}) AS l FROM x) SELECT doc_id, unnest(list_filter(l, lambda v, i: list_position(l, v) = i)[1:10]) AS hint FROM y",
    "vl01_dimensions": f"WITH {H}, {_dims()}",
    "ht09_clean_titles": "SELECT p_partkey AS id, trim(p_name) AS title FROM part",
}

for part in (stores, measures, validation, pages):
    QUERIES |= part.QUERIES
    SQL |= part.SQL
