"""URL filter: listed rules first, else empirical-Bayes host reputation.

Labelled pages count good and bad outcomes of hosts. A host's rate of bad pages is shrunk to its registered domain's,
that to its suffix's, and that to the corpus's, through beta-binomial priors whose strength each level estimates from
the spread between its groups. A page is blocked if the lower posterior bound of its host's rate, a quantile of the beta
posterior, exceeds a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.llm.common import checkpoint, join_hot, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): the host and its subdomains, paths that start so.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Suffixes of two labels below which domains are registered; all others have one label.
SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "co.kr", "co.in", "co.za", "com.br", "com.cn", "com.mx", "com.tr")
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, PARTS, 1), UPPER, LOWER), F.regexp_extract(u, PARTS, 2)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]], field: int) -> Column:
    """The longest rule that fits (field 1), or its verdict (field 0); null if none fits."""
    out = F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(verdict if field == 0 else h + p)).otherwise(out)
    return out


def _strength(groups: DataFrame, n: str, k: str) -> float:
    """The prior's strength by the method of moments (small spread: strong prior), in bounds; one number."""
    s = groups.where(F.col(n) > 0).agg(F.sum(n).alias("N"), F.sum(k).alias("K"), F.sum(F.col(n) * F.col(n)).alias("N2"), F.sum(F.col(k) * F.col(k) / F.col(n)).alias("Q"), F.count("*").alias("G"))
    p = F.col("K") / F.col("N")
    within = p * (1 - p)
    between = F.col("Q") - F.col("N") * p * p
    spread = within * (F.col("N") - F.col("N2") / F.col("N") - (F.col("G") - 1))
    rho = F.when((F.col("G") > 1) & (spread > 0), F.least(F.greatest((between - within * (F.col("G") - 1)) / spread, F.lit(0.001)), F.lit(0.9)))
    return s.select((1 / F.coalesce(rho, F.lit(0.1)) - 1).alias("m")).first()["m"]


def domain_and_suffix(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """The registered domain (a suffix and the label before it) and the suffix of a host, without user and port. An
    address of numbers is its own domain under the suffix ip; a host that is a suffix is its own domain."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    parts = F.split(name, r"\.")
    last = lambda k: F.when(F.size(parts) > k, F.array_join(F.slice(parts, -k, k), ".")).otherwise(name)
    long, ip = last(2).isin(*suffixes), name.rlike(r"^[0-9]+(\.[0-9]+){3}$|^\[")
    return F.when(ip, name).when(long, last(3)).otherwise(last(2)), F.when(ip, "ip").when(long, last(2)).otherwise(F.element_at(parts, -1))


def lower_bound(a: Column, b: Column, z: float) -> Column:
    """The quantile of Beta(a + 1, b + 1) that the normal deviate z leaves above, by the expansion of Abramowitz and
    Stegun (26.5.22), which the added ones keep in its range; within 0.03 of the quantile in the tests."""
    u, v = 2 * a + 1, 2 * b + 1
    h, lam = 2 / (1 / u + 1 / v), (z * z - 3) / 6
    w = z * F.sqrt(h + lam) / h - (1 / v - 1 / u) * (lam + 5 / 6 - 2 / (3 * h))
    return F.when(h + lam > 0, (a + 1) / (a + 1 + (b + 1) * F.exp(2 * w))).otherwise(0.0)


def reputation(pages: DataFrame, labels: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, pages, n, k, mean, bound) of every host of pages(page_id, host). labels(page_id, bad 0/1); nulls don't count.

    Each level is written once before the next reads it; only the three strengths and the corpus's two sums come to the driver.
    """
    seen = pages.groupBy("host").agg(F.count("*").alias("pages"))
    marked = pages.join(labels.where(F.col("bad").isNotNull()), "page_id").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("k"))
    hosts = seen.join(marked, "host", "left").fillna(0, ["n", "k"])
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = checkpoint(hosts.withColumns({"domain": domain, "suffix": suffix}))
    domains = checkpoint(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"), F.count("*").alias("dr")))
    suffixes = checkpoint(domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"), F.count("*").alias("sr")))
    mh, md, ms = F.lit(_strength(hosts, "n", "k")), F.lit(_strength(domains, "dn", "dk")), F.lit(_strength(suffixes, "sn", "sk"))
    whole = suffixes.agg(F.sum("sn").alias("n"), F.sum("sk").alias("k")).first()
    top = ((whole["k"] or 0) + 0.5) / ((whole["n"] or 0) + 1)
    suffixes = checkpoint(suffixes.select("suffix", ((ms * top + F.col("sk")) / (ms + F.col("sn"))).alias("sm"), "sr"))
    domains = checkpoint(join_hot(domains, suffixes, "suffix", "sr", domains.count()).select("domain", ((md * F.col("sm") + F.col("dk")) / (md + F.col("dn"))).alias("dm"), "dr"))
    out = join_hot(hosts, domains, "domain", "dr", hosts.count()).withColumn("mean", (mh * F.col("dm") + F.col("k")) / (mh + F.col("n")))
    bad, good = mh * F.col("dm") + F.col("k"), mh * (1 - F.col("dm")) + F.col("n") - F.col("k")
    return checkpoint(out.withColumn("bound", lower_bound(bad, good, z)).select("host", "pages", "n", "k", "mean", "bound"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, limit: float = 0.5, z: float = 1.645) -> DataFrame:
    """(page_id, host, path, rule, verdict, bound) of every row of pages(page_id, url).

    Urls that are null or have no :// have empty host and path, and share the reputation of the empty host. Page ids
    may be null or repeat; such rows are judged by their hosts.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    hosts = reputation(rows.select("page_id", "host"), labels, z).select("host", "bound", "pages")
    out = join_hot(rows, hosts, "host", "pages", rows.count())
    rule = rule_for(F.col("host"), F.col("path"), rules, 1)
    verdict = F.coalesce(rule_for(F.col("host"), F.col("path"), rules, 0), F.when(F.col("bound") > limit, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "bound")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict. A labelled page is bad if its quality is 0 or it is toxic; labels and pages share their ids."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), labels).drop("bound")


OP2_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) ELSE '' END AS path FROM pages),
lab AS (SELECT doc_id AS page_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END AS bad FROM labels),
m AS (SELECT host, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS k FROM p JOIN lab USING (page_id) GROUP BY host),
h AS (SELECT host, coalesce(n, 0) AS n, coalesce(k, 0) AS k, dm AS domain, sf AS suffix FROM (SELECT host, CASE WHEN ip THEN nm WHEN two IN (SUFFIX_LIST) THEN CASE WHEN len(ps) > 3 THEN array_to_string(ps[-3:], '.') ELSE nm END ELSE two END AS dm, CASE WHEN ip THEN 'ip' WHEN two IN (SUFFIX_LIST) THEN two ELSE ps[-1] END AS sf FROM (SELECT *, string_split(nm, '.') AS ps, CASE WHEN len(string_split(nm, '.')) > 2 THEN array_to_string(string_split(nm, '.')[-2:], '.') ELSE nm END AS two, regexp_matches(nm, '^[0-9]+(\.[0-9]+){3}$|^\[') AS ip FROM (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS nm FROM (SELECT DISTINCT host FROM p)))) LEFT JOIN m USING (host)),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY suffix),
lev AS (SELECT 'h' AS l, n, k FROM h WHERE n > 0 UNION ALL SELECT 'd', n, k FROM d WHERE n > 0 UNION ALL SELECT 's', n, k FROM s WHERE n > 0),
mom AS (SELECT l, sum(n) AS nn, sum(k) / sum(n) AS p, sum(n * n) AS n2, sum(k * k / n) AS q, count(*) AS g FROM lev GROUP BY l),
st AS (SELECT l, 1 / CASE WHEN g > 1 AND p * (1 - p) > 0 AND nn - n2 / nn - (g - 1) > 0 THEN least(greatest((q - nn * p * p - p * (1 - p) * (g - 1)) / (p * (1 - p) * (nn - n2 / nn - (g - 1))), 0.001::DOUBLE), 0.9::DOUBLE) ELSE 0.1::DOUBLE END - 1 AS m FROM mom),
one AS (SELECT coalesce((SELECT m FROM st WHERE l = 'h'), 9) AS mh, coalesce((SELECT m FROM st WHERE l = 'd'), 9) AS md, coalesce((SELECT m FROM st WHERE l = 's'), 9) AS ms, (coalesce(sum(k), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1) AS top FROM s),
sm AS (SELECT suffix, (ms * top + k) / (ms + n) AS sm FROM s, one),
dm AS (SELECT domain, (md * sm + k) / (md + n) AS dm FROM d JOIN sm USING (suffix), one),
hm AS (SELECT host, mh * dm + k AS a, mh * (1 - dm) + n - k AS b FROM h JOIN dm USING (domain), one),
hq AS (SELECT host, a, b, 2 / (1 / (2 * a + 1) + 1 / (2 * b + 1)) AS hh, (1.645::DOUBLE * 1.645::DOUBLE - 3) / 6 AS lam FROM hm),
hb AS (SELECT host, CASE WHEN hh + lam > 0 THEN (a + 1) / (a + 1 + (b + 1) * exp(2 * (1.645::DOUBLE * sqrt(hh + lam) / hh - (1 / (2 * b + 1) - 1 / (2 * a + 1)) * (lam + 5::DOUBLE / 6 - 2 / (3 * hh))))) ELSE 0 END AS bound FROM hq),
r(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
f AS (SELECT DISTINCT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict FROM (SELECT DISTINCT host, path FROM p) x JOIN r ON (x.host = rh OR ends_with(x.host, '.' || rh)) AND starts_with(x.path, rp) GROUP BY host, path)
SELECT page_id, p.host, p.path, f.rule, coalesce(f.verdict, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN hb USING (host) LEFT JOIN f ON p.host = f.host AND p.path = f.path
""".replace("SUFFIX_LIST", ", ".join(f"'{x}'" for x in SUFFIXES))
