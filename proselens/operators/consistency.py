"""Time markers, names, pronouns, coverage of points, conflicts with rules, and hints of what comes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselens.functions import fixed_values as V
from proselens.functions import text as T

JUMPS = ["days_later", "months_later", "years_later"]
LONG_JUMPS = [*JUMPS, "time_skip_long"]
EARLY = ["same_day", "next_day", "early_morning"]
MARK = "struct<position:int,ord:int,tag:string,value:bigint>"


def _marks(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """Array of marks in order of place and pattern. Splitting and extracting are both linear in the text; the lengths
    of the pieces between matches and of the matches add up to the positions. A pattern meets only texts that hold all
    of its characters that must stand there, which is a plain search."""

    def places(k: int, pattern: str, tag: str) -> Column:
        p = "(?U)" + pattern
        pairs = F.zip_with(F.split(text, p, -1), F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda g, h: F.struct(F.length(g).alias("g"), h.alias("h")))

        def step(acc, x):
            at = acc["at"] + x["g"]
            value = F.regexp_extract(x["h"], r"(?U)\d+", 0).try_cast("long") if "(" in pattern else F.lit(None).cast("long")
            mark = F.struct(at.alias("position"), F.lit(k).alias("ord"), F.lit(tag).alias("tag"), value.alias("value"))
            return F.when(x["h"].isNull(), acc).otherwise(F.struct((at + F.length(x["h"])).alias("at"), F.concat(acc["out"], F.array(mark)).alias("out")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{MARK}>").alias("out"))
        found = F.aggregate(pairs, start, step)["out"]
        there = text.rlike(p)
        for part in reversed(_literals(pattern)):
            there = F.when(text.contains(part), there).otherwise(False)
        return F.when(there, found).otherwise(F.array().cast(f"array<{MARK}>"))

    return F.sort_array(F.concat(*[places(k, p, tag) for k, (p, tag) in enumerate(patterns)]))


def _literals(pattern: str) -> list[str]:
    """Pieces of plain text that every match of a pattern holds; none if the pattern has more than groups of digits and
    optional characters beside them."""
    pieces = re.sub(r"\(\\d\+\)|\w\?", "\0", pattern).split("\0")
    return [x for x in pieces if x] if all(re.fullmatch(r"\w*", x) for x in pieces) else []


def time_marks(docs: DataFrame, patterns: list[tuple[str, str]] = V.TIMES) -> DataFrame:
    """CN-7: (doc_id, position, ord, tag, value): every match of every pattern, with its number if it has one."""
    return T.settled(docs.select("doc_id", "text")).select("doc_id", F.explode(_marks(F.col("text"), patterns)).alias("x")).select("doc_id", "x.*")


def time_issues(docs: DataFrame, patterns: list[tuple[str, str]] = V.TIMES) -> DataFrame:
    """CN-8: neighbouring marks of a text that jump ahead and then fall on the same day. No shuffle."""
    m = T.settled(T.settled(docs.select("doc_id", "text")).select("doc_id", _marks(F.col("text"), patterns).alias("m")))
    n = F.greatest(F.size("m") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("m", 1, n), F.slice("m", 2, n), lambda a, b: F.struct(b["position"].alias("position"), a["tag"].alias("before"), b["tag"].alias("tag")))
    return m.select("doc_id", F.explode(F.filter(pairs, lambda x: x["before"].isin(JUMPS) & (x["tag"] == "same_day"))).alias("x")).select("doc_id", "x.*")


def time_between_chapters(chapters: DataFrame, patterns: list[tuple[str, str]] = V.TIMES) -> DataFrame:
    """CN-9: chapters(doc_id, book, chapter_no, text) whose first three marks hold an early one while the last three of
    the chapter before hold a jump. Grouped by (book, number), so that a large book is not one task."""
    tags = F.transform(_marks(F.col("text"), patterns), lambda x: x["tag"])
    texts = T.settled(chapters.select("book", "chapter_no", "doc_id", "text"))
    m = T.settled(texts.select("book", "chapter_no", "doc_id", tags.alias("tags")))
    last = F.when(F.size("tags") >= 3, F.slice("tags", -3, 3)).otherwise(F.col("tags"))
    jump = F.arrays_overlap(last, F.array(*map(F.lit, LONG_JUMPS)))
    early = F.arrays_overlap(F.slice("tags", 1, 3), F.array(*map(F.lit, EARLY)))
    m = T.settled(m.select("book", "chapter_no", "doc_id", jump.alias("jump"), early.alias("early"))).where("jump or early")
    # A chapter that jumps also says so at the next number, so each text is read once and the two meet in one exchange.
    at = lambda no, doc, jumps: F.struct(F.col("book").alias("book"), no.alias("chapter_no"), doc.alias("doc_id"), F.lit(jumps).alias("jumps"))
    says = F.filter(F.array(F.when(F.col("early"), at(F.col("chapter_no"), F.col("doc_id"), False)), F.when(F.col("jump"), at((F.col("chapter_no") + 1).cast(m.schema["chapter_no"].dataType), F.lit(None).cast(m.schema["doc_id"].dataType), True))), lambda x: x.isNotNull())
    g = m.select(F.inline(says)).where("book is not null and chapter_no is not null").groupBy("book", "chapter_no").agg(F.bool_or("jumps").alias("jumps"), F.collect_list(F.when(~F.col("jumps"), F.struct("doc_id"))).alias("early"))
    return g.where("jumps").select("book", "chapter_no", F.inline("early"))


def names(docs: DataFrame, known: list[str]) -> DataFrame:
    """CN-1, CN-3: (doc_id, name, n, known): a surname and one or two Han characters; unknown ones from two on."""
    p = f"(?U)[{V.SURNAMES}]{T.HAN}{{1,2}}(?![{V.NOT_AFTER_NAME}])"
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("name"))
    n = found.groupBy("doc_id", "name").agg(F.count("*").alias("n")).withColumn("known", F.col("name").isin(known) if known else F.lit(False))
    return n.where("known or n >= 2")


def surnames(docs: DataFrame) -> DataFrame:
    """CN-1: surnames that stand alone three times or more in a text."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{V.SURNAMES}](?!{T.HAN})"), F.lit(0))).alias("surname"))
    return found.groupBy("doc_id", "surname").agg(F.count("*").alias("n")).where("n >= 3")


def pronouns(docs: DataFrame) -> DataFrame:
    """CN-2: paragraphs with five pronouns or more beside two different words before punctuation."""
    p = docs.select("doc_id", F.posexplode(T.paragraphs(F.col("text"), 0)).alias("paragraph", "p"))
    words = F.array_distinct(F.regexp_extract_all("p", F.lit(f"{T.HAN}{{2,3}}(?=[，。！？、；：])"), F.lit(0)))
    out = p.select("doc_id", "paragraph", T.matches(F.col("p"), "[他她]").alias("pronouns"), F.size(words).alias("named"), F.left("p", F.lit(100)).alias("snippet"))
    return out.where("pronouns >= 5 and named >= 2")


def conflicts(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """BB-10: texts(doc_id, text) with a negation that share over three different chunks with rules(rule_id, content).
    An equi-join on chunks, each once a text and once a rule."""
    chunk = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit(f"{T.HAN}{{2,5}}"), F.lit(0)))).alias("chunk")
    a = texts.where(F.col("text").rlike("|".join(V.RULE_NEGATIONS))).select("doc_id", chunk("text"))
    return a.join(rules.select("rule_id", chunk("content")), "chunk").groupBy("doc_id", "rule_id").agg(F.count("*").alias("shared")).where("shared > 3")


def _points(outline: Column) -> Column:
    """The lines of an outline that say a point: bullets, numbered lines and headers, without their marks."""
    lines = F.transform(F.split(F.coalesce(outline, F.lit("")), "\n"), T.strip)
    bullet, number = r"(?U)^[-*]\s", r"(?U)^\d+[.、）)]"
    point = lambda x: F.when(x.rlike(bullet), F.regexp_replace(x, r"(?U)^[-*]\s+", "")).when(x.rlike(number), F.regexp_replace(x, r"(?U)^\d+[.、）)]\s*", "")).when(x.startswith("##"), F.regexp_replace(x, r"(?U)^#+\s*", ""))
    return F.filter(F.transform(lines, point), lambda x: x.isNotNull())


def coverage(pairs: DataFrame) -> DataFrame:
    """CN-5: pairs(doc_id, text, outline) -> (doc_id, total_points, covered_count, missed_count, coverage_score,
    missing_points, error): a point is covered if half of its Han keywords occur in the text.

    Points without keywords are neither covered nor missed but count in the total. An empty outline, or one without
    points, has an error and a score of zero. One projection; the pair is each row's own.
    """
    keys = lambda p: F.regexp_extract_all(p, F.lit(f"{T.HAN}{{2,4}}"), F.lit(0))
    d = T.settled(pairs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("outline", F.lit("")).alias("outline"), _points(F.col("outline")).alias("p")))
    scored = F.transform("p", lambda p: F.struct(F.left(p, F.lit(80)).alias("point"), F.size(F.filter(keys(p), lambda k: F.col("text").contains(k))).alias("hits"), F.size(keys(p)).alias("n")))
    d = T.settled(d.select("doc_id", "outline", F.filter(scored, lambda x: x["n"] > 0).alias("s"), F.size("p").alias("total")))
    missed = F.filter("s", lambda x: x["hits"] * 2 < x["n"])
    covered = F.size("s") - F.size(missed)
    error = F.when(T.strip(F.col("outline")) == "", "Empty outline").when(F.col("total") == 0, "No outline points found")
    return d.select("doc_id", F.col("total").alias("total_points"), covered.alias("covered_count"), F.size(missed).alias("missed_count"), (covered / F.greatest("total", F.lit(1))).alias("coverage_score"), missed.alias("missing_points"), error.alias("error"))


def _numbers(path: Column) -> Column:
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.regexp_extract_all(stem, F.lit(r"第(\d+)章"), F.lit(1))


def matched_outlines(chapters: DataFrame, outlines: DataFrame) -> DataFrame:
    """CN-6: chapters(path, text) beside the outlines(path, text) of their number: (doc_id: the chapter's path,
    outline_path, text, outline). The number is the first 第N章 of the file's name; of several outlines that say it the
    first in order of path counts. An equi-join on the number, which a chapter without one or without outline leaves."""
    o = outlines.select(F.explode(F.array_distinct(_numbers(F.col("path")))).alias("n"), "path", "text").groupBy("n").agg(F.min(F.struct("path", "text")).alias("o"))
    c = chapters.select(F.get(_numbers(F.col("path")), F.lit(0)).alias("n"), F.col("path").alias("doc_id"), "text").where("n is not null")
    return c.join(o, "n").select("doc_id", F.col("o.path").alias("outline_path"), "text", F.col("o.text").alias("outline"))


def check_coverage(chapters: DataFrame, outlines: DataFrame) -> DataFrame:
    """CN-6: the coverage of every chapter by the outline of its number."""
    return coverage(matched_outlines(chapters, outlines))


def check(chapters: DataFrame, files: DataFrame, outlines: DataFrame, known: list[str]) -> dict[str, DataFrame]:
    """CN-10: names, timeline and coverage of a project: three plans, each run when it is read."""
    return {"names": names(chapters, known), "timeline": time_between_chapters(chapters), "coverage": check_coverage(files, outlines)}


def homophones(pairs: DataFrame, readings: DataFrame | None = None) -> DataFrame:
    """CN-4: (a, b, same) of pairs(a, b): whether two different names read alike under readings(name, reading); without
    a reading no two do."""
    if readings is None:
        return pairs.withColumn("same", F.lit(False))
    r = readings.select("name", "reading").distinct().groupBy("name").agg(F.min("reading").alias("reading"))
    j = pairs.join(r.select(F.col("name").alias("a"), F.col("reading").alias("ra")), "a", "left").join(r.select(F.col("name").alias("b"), F.col("reading").alias("rb")), "b", "left")
    return j.select("a", "b", F.coalesce((F.col("a") != F.col("b")) & (F.col("ra") == F.col("rb")), F.lit(False)).alias("same"))


def hints(docs: DataFrame) -> DataFrame:
    """BB-8: up to ten different passages over five characters that hint at something, in order of pattern and place."""
    found = F.filter(F.concat(*[F.regexp_extract_all("text", F.lit("(?d)" + p), F.lit(0)) for p in V.HINTS]), lambda x: F.length(x) > 5)
    return docs.select("doc_id", F.explode(F.slice(F.array_distinct(F.transform(found, T.strip)), 1, 10)).alias("hint"))
