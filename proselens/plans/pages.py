"""Queries of listings, chapter lists and reviews over pages made from the driver's relational tables, and their SQL,
which derives the same rows from the tables without any HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from proselens.functions import fixed_values as V
from proselens.operators import pages
from proselens.sources.tables import table

BASE = "https://site.example"
SITES = sorted(V.SITE_RULES)


def made(spark, d, name, key, value, order, head="", tail="", url=None):
    """Pages (page_id, url, html): the values of a table's rows by key, in order."""
    t = table(spark, d, name).select(key.alias("page_id"), value.alias("v"), *[F.expr(x).alias(f"o{k}") for k, x in enumerate(order)])
    os_ = [f"o{k}" for k in range(len(order))]
    g = t.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*os_, "v"))), lambda x: x["v"]), "\n").alias("h"))
    return g.select(F.col("page_id").cast("long").alias("page_id"), (url if url is not None else F.lit(BASE)).alias("url"), F.concat(F.lit(head), "h", F.lit(tail)).alias("html"))


def book(path, title, author):
    return F.concat(F.lit('<li><a href="'), path, F.lit('" class="t">'), title, F.lit("</a>\n <i>by</i> <span>"), author, F.lit("</span></li>"))


def shelves(spark, d):
    """A page for each nation: its suppliers, of whom two neighbours share a book."""
    return made(spark, d, "supplier", F.col("s_nationkey"), book(F.concat(F.lit("/look/"), (F.col("s_suppkey") / 2).cast("int"), F.lit("/")), F.col("s_name"), F.substring("s_name", -4, 4)), ["s_suppkey"], '<a href="/">首页</a><div class="x block">', "</div>")


def contents(spark, d):
    """A page for each order of a hundred: its lines as chapters by their part, at one of the sites."""
    site = F.element_at(F.array(*map(F.lit, SITES)), (F.col("page_id") % len(SITES) + 1).cast("int"))
    url = F.concat(F.element_at(F.array(*map(F.lit, ["https://www.", "http://m.", "https://", "HTTPS://WAP."])), (F.col("page_id") % 4 + 1).cast("int")), site, F.lit("/look/"), F.col("page_id"), F.lit("/"))
    value = F.concat(F.lit('<dd> <a href ="'), F.col("l_partkey"), F.lit('.html" > part '), F.col("l_suppkey"), F.lit(" </a></dd>"))
    p = made(spark, d, "lineitem", F.floor(F.col("l_orderkey") / 100), value, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], url=url)
    holders = " ".join(sorted({v for k, v, *_ in V.SITE_RULES.values() if k == "class"}))
    ids = sorted({v for k, v, *_ in V.SITE_RULES.values() if k == "id"})
    # Every site's container is around the list; a second one of the same kind comes after it and doesn't count.
    opened = f'<div class="{holders}">' + "".join(f'<div id="{i}">' for i in ids)
    after = "</div>" * (len(ids) + 1) + f'<div class="{holders}"><a href="0.html">zero</a></div>'
    return p.withColumn("html", F.concat(F.lit(opened + '<a href="x.html">下一页</a>'), "html", F.lit(after)))


def remarks(spark, d):
    """A page for each customer of fifty: orders as comments with stars, and as threads."""
    o = F.col("o_orderkey")
    stars = F.when(o % 5 != 0, F.concat(F.lit('<i class="allstar'), (o % 5) * 10, F.lit(' r"></i>'))).otherwise("")
    value = F.concat(stars, F.lit('<span class="short"> <b>'), "o_orderpriority", F.lit("</b> "), o, F.lit('</span><a href="#" class="j_th_tit" title="'), o, F.lit('">t</a><div class="threadlist_abs x"><i> '), "o_orderpriority", F.lit("</i></div>"))
    return made(spark, d, "orders", F.floor(F.col("o_custkey") / 50), value, ["o_orderkey"])


def rendered(spark, d):
    """A page for each brand: its parts as books, chapters and links of other kinds."""
    k = F.col("p_partkey")
    value = F.concat(F.lit('<a href="/tongren/'), k, F.when(k % 3 == 0, "/index.html").when(k % 3 == 1, F.concat(F.lit("/"), k % 100, F.lit(".html"))).otherwise("/"), F.lit('">'), "p_name", F.lit("</a>"))
    return made(spark, d, "part", F.right("p_brand", F.lit(1)).cast("int"), value, ["p_partkey"])


def scripts(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.concat(F.lit("var x = 1;\n"), F.regexp_replace("text", r"\s+", " "), F.lit("\n\n\n\nif (a) b()\nend")).alias("text"))


def wanted(spark, d):
    """Each nation wants the supplier whose name ends as its key; some by an author."""
    n = F.col("n_nationkey")
    return table(spark, d, "nation").select(n.cast("long").alias("page_id"), F.lpad(n.cast("string"), 1, "0").alias("want_title"), F.when(n % 2 == 0, F.concat(F.lit("x"), n % 10)).otherwise("").alias("want_author"))


def books_with(spark, d):
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("active").alias("status"))
    return pages.deprecated(b, table(spark, d, "orders").select(F.col("o_custkey").alias("book_id")))


QUERIES = {
    "ht02_site_rules": lambda s, d: pages.site_rules(contents(s, d)),
    "ht03_home_books": lambda s, d: pages.home_books(shelves(s, d), BASE),
    "ht03_category_books": lambda s, d: pages.category_books(shelves(s, d), BASE, 50),
    "ht03_other_home_books": lambda s, d: pages.other_home_books(shelves(s, d), 50),
    "ht03_ranking_books": lambda s, d: pages.ranking_books(shelves(s, d), BASE, 3, 50),
    "ht04_chapter_list": lambda s, d: pages.chapter_list(contents(s, d), BASE),
    "ht04_site_chapter_list": lambda s, d: pages.site_chapter_list(contents(s, d)),
    "ht05_search": lambda s, d: pages.search_match(pages.home_books(shelves(s, d), BASE, 1000), wanted(s, d)),
    "ht06_discover": lambda s, d: pages.discover([pages.home_books(shelves(s, d).where("page_id = 3"), BASE, 4), pages.category_books(shelves(s, d).where("page_id in (3, 4)"), BASE, 9).withColumn("i", F.col("page_id") * 100 + F.col("i"))], 12),
    "ht06_deprecated": books_with,
    "ht07_comments": lambda s, d: pages.comments(remarks(s, d)),
    "ht08_posts": lambda s, d: pages.posts(remarks(s, d)),
    "ht10_books": lambda s, d: pages.rendered_books(rendered(s, d), BASE),
    "ht10_chapters": lambda s, d: pages.rendered_chapters(rendered(s, d), BASE),
    "ht10_content": lambda s, d: pages.rendered_content(scripts(s, d)),
}

SHELF = f"s AS (SELECT s_nationkey::BIGINT AS page_id, s_suppkey, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INT AS i, s_name AS title, right(s_name, 4) AS author, '{BASE}/look/' || (s_suppkey // 2) || '/' AS url FROM supplier), f AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY i) AS k FROM s), b AS (SELECT page_id, i AS place, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS i, title, author, url FROM f WHERE k = 1)"
CONTENT = "l AS (SELECT l_orderkey // 100 AS page_id, l_partkey AS no, 'part ' || l_suppkey AS title, row_number() OVER (PARTITION BY l_orderkey // 100 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem), f AS (SELECT *, row_number() OVER (PARTITION BY page_id, no ORDER BY i) AS k FROM l)"
PICKED = "['" + "', '".join(SITES) + "']"
RULE_OF = lambda k: "CASE domain " + " ".join(f"WHEN '{d}' THEN '{r[k]}'" for d, r in V.SITE_RULES.items()) + " END"
REMARK = "o AS (SELECT o_custkey // 50 AS page_id, o_orderkey, o_orderpriority, (row_number() OVER (PARTITION BY o_custkey // 50 ORDER BY o_orderkey) - 1)::INT AS i FROM orders)"
RENDER = "p AS (SELECT right(p_brand, 1)::BIGINT AS page_id, p_partkey, p_name, row_number() OVER (PARTITION BY right(p_brand, 1) ORDER BY p_partkey) AS i FROM part)"

SQL = {
    "ht02_site_rules": f"WITH p AS (SELECT DISTINCT l_orderkey // 100 AS page_id, {PICKED}[(l_orderkey // 100) % {len(SITES)} + 1] AS domain FROM lineitem) SELECT page_id, domain, {RULE_OF(0)} AS list_kind, {RULE_OF(1)} AS list_value, {RULE_OF(2)} AS content_kind, {RULE_OF(3)} AS content_value, {RULE_OF(4)} AS base_type FROM p",
    "ht03_home_books": f"WITH {SHELF} SELECT page_id, i, title, author, url FROM b WHERE i < 10",
    "ht03_category_books": f"WITH {SHELF} SELECT page_id, i, title, author, url FROM b WHERE i < 50",
    "ht03_other_home_books": f"WITH {SHELF} SELECT page_id, i, title, author, url FROM b WHERE i < 50",
    "ht03_ranking_books": f"WITH {SHELF} SELECT page_id, i, title, author, url, (place + 41)::INT AS rank FROM b WHERE i < 50",
    "ht04_chapter_list": f"WITH {CONTENT}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY no) AS j FROM f WHERE k = 1) SELECT page_id, no AS chapter_no, title, '{BASE}/look/' || page_id || '/' || no || '.html' AS url FROM r WHERE j <= 50",
    "ht04_site_chapter_list": f"WITH {CONTENT}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS j, {PICKED}[page_id % {len(SITES)} + 1] AS site FROM f WHERE k = 1) SELECT page_id, j::INT AS chapter_no, title, ['https://www.', 'http://m.', 'https://', 'https://WAP.'][page_id % 4 + 1] || site || '/look/' || page_id || '/' || no || '.html' AS url FROM r",
    "ht05_search": f"WITH {SHELF}, w AS (SELECT n_nationkey::BIGINT AS page_id, lpad(n_nationkey::VARCHAR, 1, '0') AS t, CASE WHEN n_nationkey % 2 = 0 THEN 'x' || (n_nationkey % 10) ELSE '' END AS a FROM nation) SELECT page_id, arg_min(title, i) AS title, arg_min(author, i) AS author, arg_min(url, i) AS url FROM b JOIN w USING (page_id) WHERE contains(title, t) AND (a = '' OR contains(author, a) OR contains(a, author)) GROUP BY page_id",
    "ht06_discover": f"WITH {SHELF}, e AS (SELECT 0 AS source, i, title, author, url FROM b WHERE page_id = 3 AND i < 4 UNION ALL SELECT 1, page_id * 100 + i, title, author, url FROM b WHERE page_id IN (3, 4) AND i < 9), g AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY source, i) AS k FROM e) SELECT source, i, title, author, url FROM g WHERE k = 1 ORDER BY source, i LIMIT 12",
    "ht06_deprecated": "SELECT c_custkey AS id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'active' ELSE 'deprecated' END AS status FROM customer",
    "ht07_comments": f"WITH {REMARK}, r AS (SELECT page_id, (o_orderkey % 5)::INT AS rating, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS i FROM o WHERE o_orderkey % 5 <> 0) SELECT page_id, i, o_orderpriority || ' ' || o_orderkey AS content, rating, CASE WHEN rating <= 2 THEN 'negative' WHEN rating IS NOT NULL THEN 'positive' END AS sentiment FROM o LEFT JOIN r USING (page_id, i) WHERE i < 20",
    "ht08_posts": f"WITH {REMARK} SELECT page_id, i, o_orderkey || ' | ' || o_orderpriority AS content FROM o WHERE i < 20",
    "ht10_books": f"WITH {RENDER}, r AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS i, p_name AS title, '{BASE}/tongren/' || p_partkey || CASE WHEN p_partkey % 3 = 1 THEN '/' || (p_partkey % 100) || '.html' ELSE '/' END AS url FROM p WHERE p_partkey % 3 <> 0) SELECT * FROM r WHERE i < 15",
    "ht10_chapters": f"WITH {RENDER}, r AS (SELECT page_id, p_partkey % 100 AS chapter_no, p_name AS title, '{BASE}/tongren/' || p_partkey || '/' || (p_partkey % 100) || '.html' AS url, row_number() OVER (PARTITION BY page_id ORDER BY p_partkey % 100, i) AS k FROM p WHERE p_partkey % 3 = 1) SELECT page_id, chapter_no, title, url FROM r",
    "ht10_content": r"WITH t AS (SELECT doc_id AS page_id, chr(10) || regexp_replace(text, '\s+', ' ', 'g') || chr(10) || chr(10) || chr(10) || chr(10) || chr(10) || 'end' AS a FROM documents), u AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(a, 'document\.write.*', '', 'g'), 'function\s+\w+\([^)]*\).*', '', 'g'), 'if\s*\(.*?\).*', '', 'g'), 'var\s+\w+.*', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS a FROM t) SELECT page_id, CASE WHEN length(a) > 200 THEN regexp_replace(a, '^\s+|\s+$', '', 'g') END AS text FROM u",
}
