"""Queries of the story bible and the corpus store over the driver's relational tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from proselens.operators import store
from proselens.sources.tables import table


def people_log(spark, d):
    """Customers are registered, their orders set their status, one order in order of key after another; those in debt
    are deleted."""
    c = table(spark, d, "customer")
    none = F.lit(None).cast("string")
    born = c.select(F.col("c_custkey").alias("id"), F.lit(0).cast("long").alias("seq"), F.lit("insert").alias("kind"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("role"), F.lit("active").alias("status"))
    set_ = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") + 1).alias("seq"), F.lit("update").alias("kind"), none.alias("name"), none.alias("role"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("gone").alias("status"))
    dead = c.where("c_acctbal < 0").select(F.col("c_custkey").alias("id"), F.lit(1 << 60).alias("seq"), F.lit("delete").alias("kind"), none.alias("name"), none.alias("role"), none.alias("status"))
    return born.unionByName(set_).unionByName(dead)


def people(spark, d):
    return store.rows(people_log(spark, d))


def seen(spark, d):
    """Orders as appearances: the order's key says when, its day since the first in which chapter, from 0."""
    return table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.datediff("o_orderdate", F.lit("1992-01-01")).alias("chapter"))


def plant_log(spark, d):
    """Orders plant, their line that ships last resolves if it was returned."""
    none = F.lit(None).cast("string")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(0).alias("seq"), F.lit("insert").alias("kind"), F.datediff("o_orderdate", F.lit("1992-01-01")).alias("planted"), F.lit(None).cast("int").alias("resolved"), F.lit("pending").alias("status"))
    r = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("int").alias("seq"), F.lit("update").alias("kind"), none.cast("int").alias("planted"), F.datediff("l_shipdate", F.lit("1992-01-01")).alias("resolved"), F.lit("resolved").alias("status"))
    return o.unionByName(r)


def plants(spark, d):
    return store.rows(plant_log(spark, d))


def world(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("category"), F.col("p_type").alias("key"), (F.col("p_size") > 25).alias("is_hard_rule"))


def rule_log(spark, d):
    """Parts are rules; a supplier's line of a part moves the rule to the category of its flag, and small parts are dropped."""
    none = F.lit(None)
    p = world(spark, d).select("id", F.lit(0).cast("long").alias("seq"), F.lit("insert").alias("kind"), "category", "key", "is_hard_rule")
    u = table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.lit("update").alias("kind"), F.concat(F.lit("A"), F.col("l_linestatus")).alias("category"), none.cast("string").alias("key"), none.cast("boolean").alias("is_hard_rule"))
    x = table(spark, d, "part").where("p_size < 5").select(F.col("p_partkey").alias("id"), F.lit(1 << 60).alias("seq"), F.lit("delete").alias("kind"), none.cast("string").alias("category"), none.cast("string").alias("key"), none.cast("boolean").alias("is_hard_rule"))
    return p.unionByName(u).unionByName(x)


def mentions(spark, d):
    """Suppliers of an order share its place; the chapter is the order's key divided by a hundred."""
    return table(spark, d, "lineitem").select((F.floor(F.col("l_orderkey") / 100)).cast("int").alias("chapter"), F.col("l_orderkey").alias("place"), F.col("l_suppkey").alias("id"))


def suppliers(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") >= 0, "active").otherwise("gone").alias("status"))


def nodes(spark, d):
    return store.network(suppliers(spark, d), store.cooccurrences(mentions(spark, d)))[0]


def edges(spark, d):
    e = store.network(suppliers(spark, d), store.cooccurrences(mentions(spark, d)))[1]
    return e.select("a", "b", "weight", F.size("chapters").alias("chapters"), F.element_at("chapters", 1).alias("first"))


def books(spark, d):
    """Customers as books, analysed last at their latest order, if they have one."""
    last = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_analyzed_at"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.when(F.col("c_acctbal") >= 0, "active").otherwise("deprecated").alias("status"))
    return c.join(last, c["id"] == last["o_custkey"], "left").drop("o_custkey")


def add_chapters(spark, d):
    """Events add chapters by path: a user's type of event is a path; the first of equal new ones counts."""
    e = table(spark, d, "events")
    old = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("event_id").alias("id")).select("id", F.concat(F.lit("signup/"), "user_id").alias("file_path"))
    new = e.select(F.col("event_id").alias("id"), F.concat("event_type", F.lit("/"), "user_id").alias("file_path"))
    return store.insert_new(old, new, "file_path")


def gap_events(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("module"), F.concat(F.lit("type "), F.col("user_id") % 10).alias("gap_type"), F.get_json_object("props", "$.k").alias("description"), F.col("ts").alias("at"))


def prior_gaps(spark, d):
    """Gaps of the events before a day: those of even keys are closed."""
    g = store.gaps(gap_events(spark, d).where(F.col("at") < F.lit("2024-01-04").cast("timestamp")))
    return g.withColumn("status", F.when(F.col("description").cast("int") % 2 == 0, "closed").otherwise("open"))


def gaps(spark, d):
    return store.gaps(gap_events(spark, d).where(F.col("at") >= F.lit("2024-01-04").cast("timestamp")), prior_gaps(spark, d))


def fixes_log(spark, d):
    """Orders are fixes; lines verify them in order: the last one's flag decides."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(0).alias("seq"), F.lit("insert").alias("kind"), F.lit("open").alias("status"), F.lit(None).cast("string").alias("improvement_metric"))
    v = table(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("int").alias("seq"), F.lit("update").alias("kind"), F.when(F.col("l_returnflag") == "A", "passed").otherwise("failed").alias("status"), F.concat(F.lit('{"quantity":'), F.col("l_quantity").cast("int"), F.lit("}")).alias("improvement_metric"))
    return o.unionByName(v)


def reviews_of(spark, d):
    """Every conversation's user turns as pasted reviews."""
    c = table(spark, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("book_id"), "turn", "text")
    return store.manual_reviews(c.select(F.struct("book_id", "turn").alias("book_id"), "text")).select("book_id.book_id", "book_id.turn", "line", "content")


QUERIES = {
    "bb01_characters": people,
    "bb02_appearances": lambda s, d: store.appearances(people(s, d), seen(s, d)).select("id", "first_appear_ch", "last_appear_ch"),
    "bb05_nodes": nodes,
    "bb05_edges": edges,
    "bb06_foreshadows": plants,
    "bb06_unresolved": lambda s, d: store.unresolved(plants(s, d)).select("id", "planted"),
    "bb07_expiring": lambda s, d: store.expiring(plants(s, d), threshold=400),
    "bb07_expiring_by_people": lambda s, d: store.expiring(plants(s, d), store.appearances(people(s, d), seen(s, d)), threshold=100),
    "bb09_world_rules": lambda s, d: store.rows(rule_log(s, d)),
    "bb09_hard_rules": lambda s, d: store.rules(store.rows(rule_log(s, d)), hard=True).select("id", "category"),
    "db01_add_chapters": add_chapters,
    "db02_chapters": lambda s, d: store.of(table(s, d, "lineitem").select(F.col("l_suppkey").alias("book_id"), F.col("l_orderkey").alias("chapter_no"), "l_linenumber"), "chapter_no", book_id=7),
    "db03_active_books": lambda s, d: store.active(books(s, d)),
    "db06_gaps": lambda s, d: gaps(s, d).drop("id"),
    "db07_open_gaps": lambda s, d: store.open_gaps(gaps(s, d)).select("module", "gap_type", "description", "occurrence_count"),
    "db08_fixes": lambda s, d: store.rows(fixes_log(s, d)),
    "db10_manual_reviews": reviews_of,
}

PEOPLE = "u AS (SELECT o_custkey AS id, arg_max(CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'gone' END, o_orderkey) AS status FROM orders GROUP BY 1), people AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS role, coalesce(u.status, 'active') AS status FROM customer LEFT JOIN u ON id = c_custkey WHERE c_acctbal >= 0)"
SEEN = "seen AS (SELECT o_custkey AS id, o_orderkey AS seq, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::INT AS chapter FROM orders), app AS (SELECT id, coalesce(arg_min(chapter, seq) FILTER (chapter <> 0), 0)::INT AS first_appear_ch, greatest(max(chapter), 0)::INT AS last_appear_ch FROM seen GROUP BY id)"
PLANTS = "r AS (SELECT l_orderkey AS id, max({'k': l_linenumber, 'v': date_diff('day', DATE '1992-01-01', l_shipdate::DATE)}).v::INT AS resolved FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), plants AS (SELECT o_orderkey AS id, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::INT AS planted, r.resolved, CASE WHEN r.id IS NULL THEN 'pending' ELSE 'resolved' END AS status FROM orders LEFT JOIN r ON r.id = o_orderkey)"
RULES = "u AS (SELECT l_partkey AS id, max({'k': l_orderkey * 10 + l_linenumber, 'v': 'A' || l_linestatus}).v AS category FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), rules AS (SELECT p_partkey AS id, coalesce(u.category, p_brand) AS category, p_type AS key, p_size > 25 AS is_hard_rule FROM part LEFT JOIN u ON id = p_partkey WHERE p_size >= 5)"
PAIRS = "m AS (SELECT DISTINCT (l_orderkey // 100)::INT AS chapter, l_orderkey AS place, l_suppkey AS id FROM lineitem), co AS (SELECT x.id AS char_a, y.id AS char_b, chapter, count(*) AS n FROM m x JOIN m y USING (chapter, place) WHERE x.id < y.id GROUP BY ALL)"
GAPS = """e AS (SELECT event_type AS module, 'type ' || (user_id % 10) AS gap_type, props ->> '$.k' AS description, ts AS seen_at FROM events),
o AS (SELECT module, gap_type, description, count(*) AS n, min(seen_at) AS lo, max(seen_at) AS hi FROM e WHERE seen_at < TIMESTAMP '2024-01-04' GROUP BY ALL),
p AS (SELECT *, CASE WHEN description::INT % 2 = 0 THEN 'closed' ELSE 'open' END AS status FROM o),
w AS (SELECT module, gap_type, description, count(*) AS n, min(seen_at) AS lo, max(seen_at) AS hi FROM e WHERE seen_at >= TIMESTAMP '2024-01-04' GROUP BY ALL),
g AS (SELECT p.module, p.gap_type, p.description, p.lo AS first_seen, CASE WHEN p.status = 'open' AND w.hi > p.hi THEN w.hi ELSE p.hi END AS last_seen, p.n + CASE WHEN p.status = 'open' THEN coalesce(w.n, 0) ELSE 0 END AS occurrence_count, p.status FROM p LEFT JOIN w ON p.module = w.module AND p.gap_type = w.gap_type AND p.description IS NOT DISTINCT FROM w.description
  UNION ALL SELECT w.module, w.gap_type, w.description, w.lo, w.hi, w.n, 'open' FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.status = 'open' AND p.module = w.module AND p.gap_type = w.gap_type AND p.description = w.description))"""

SQL = {
    "bb01_characters": f"WITH {PEOPLE} SELECT * FROM people",
    "bb02_appearances": f"WITH {PEOPLE}, {SEEN} SELECT id, first_appear_ch, last_appear_ch FROM people LEFT JOIN app USING (id)",
    "bb05_nodes": f"WITH {PAIRS}, d AS (SELECT id, sum(n)::BIGINT AS d FROM (SELECT char_a AS id, n FROM co UNION ALL SELECT char_b, n FROM co) GROUP BY id) SELECT s_suppkey AS id, s_name AS name, coalesce(d, 0)::BIGINT AS degree FROM supplier LEFT JOIN d ON id = s_suppkey WHERE s_acctbal >= 0",
    "bb05_edges": f"WITH {PAIRS} SELECT char_a AS a, char_b AS b, sum(n)::BIGINT AS weight, count(*)::INT AS chapters, min(chapter) AS first FROM co GROUP BY ALL",
    "bb06_foreshadows": f"WITH {PLANTS} SELECT * FROM plants",
    "bb06_unresolved": f"WITH {PLANTS} SELECT id, planted FROM plants WHERE status = 'pending'",
    "bb07_expiring": f"WITH {PLANTS}, now AS (SELECT greatest(max(planted), 0) AS now FROM plants WHERE status = 'pending') SELECT id, planted, (now - planted)::INT AS age FROM plants, now WHERE status = 'pending' AND now - planted >= 400",
    "bb07_expiring_by_people": f"WITH {PLANTS}, {PEOPLE}, {SEEN}, now AS (SELECT coalesce(nullif((SELECT max(last_appear_ch) FROM people JOIN app USING (id)), 0), (SELECT greatest(max(planted), 0) FROM plants WHERE status = 'pending')) AS now) SELECT plants.id, planted, (now - planted)::INT AS age FROM plants, now WHERE status = 'pending' AND now - planted >= 100",
    "bb09_world_rules": f"WITH {RULES} SELECT * FROM rules",
    "bb09_hard_rules": f"WITH {RULES} SELECT id, category FROM rules WHERE is_hard_rule",
    "db01_add_chapters": "WITH o AS (SELECT min(event_id) AS id, 'signup/' || user_id AS file_path FROM events WHERE event_type = 'signup' GROUP BY user_id) SELECT id, file_path FROM o UNION ALL SELECT min(event_id), event_type || '/' || user_id AS f FROM events GROUP BY f HAVING f NOT IN (SELECT file_path FROM o)",
    "db02_chapters": "SELECT l_suppkey AS book_id, l_orderkey AS chapter_no, l_linenumber FROM lineitem WHERE l_suppkey = 7 ORDER BY chapter_no",
    "db03_active_books": "SELECT c_custkey AS id, c_name AS title, 'active' AS status, last_analyzed_at FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_analyzed_at FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_acctbal >= 0 ORDER BY last_analyzed_at ASC NULLS FIRST, id",
    "db06_gaps": f"WITH {GAPS} SELECT * FROM g",
    "db07_open_gaps": f"WITH {GAPS} SELECT module, gap_type, description, occurrence_count FROM g WHERE status = 'open' ORDER BY occurrence_count DESC",
    "db08_fixes": "WITH v AS (SELECT l_orderkey AS id, max({'k': l_linenumber, 'v': CASE WHEN l_returnflag = 'A' THEN 'passed' ELSE 'failed' END}).v AS status, max({'k': l_linenumber, 'v': '{\"quantity\":' || l_quantity::INT || '}'}).v AS improvement_metric FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) SELECT o_orderkey AS id, coalesce(v.status, 'open') AS status, improvement_metric FROM orders LEFT JOIN v ON v.id = o_orderkey",
    "db10_manual_reviews": r"WITH t AS (SELECT conv_id AS book_id, turn, string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)) AS ls FROM conversations WHERE role = 'user'), l AS (SELECT book_id, turn, (i - 1)::INT AS line, regexp_replace(ls[i], '^\s+|\s+$', '', 'g') AS content FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM t)) SELECT * FROM l WHERE content <> ''",
}
