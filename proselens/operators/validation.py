"""Analyses of chapters as a log of (run, book, chapter, module, metrics), and reviews against them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proselens.functions import fixed_values as V
from proselens.operators import emotion, lexicon, reviews, stats, style

#: A row of the log that speaks of a whole book has this chapter.
WHOLE = 0


def _stats(c: DataFrame, **_) -> DataFrame:
    n = stats.count_chapter(c).join(stats.readability(c), "doc_id").join(stats.lexical_diversity(c), "doc_id")
    read = F.struct(F.round("flesch_zh", 1).alias("flesch_zh"), F.round("avg_sentence_len", 1).alias("avg_sentence_len"), F.round("long_sentence_ratio", 3).alias("long_sentence_ratio"))
    wide = F.struct(F.round("mattr", 3).alias("mattr"), F.round("hd_d", 3).alias("hd_d"))
    return n.select("doc_id", "chinese_chars", "total_chars", "paragraphs", "dialogue_lines", "words", "title", read.alias("readability"), wide.alias("lexical_diversity"))


def _pacing(c: DataFrame, **_) -> DataFrame:
    p = stats.pacing(c)
    places = {"dialogue_ratio": 3, "narration_ratio": 3, "avg_paragraph_len": 1, "paragraph_density": 1, "show_vs_tell": 3, "action_density": 1}
    return p.select(*[F.round(x, places[x]).alias(x) if x in places else x for x in p.columns])


def _ai_score(c: DataFrame, words: DataFrame, **_) -> DataFrame:
    return style.risk(c, words).select("doc_id", "total_score", "verdict", F.struct(*V.RISK_WEIGHTS).alias("breakdown"))


def _emotion(c: DataFrame, **_) -> DataFrame:
    r = emotion.report(c).withColumns({"avg_intensity": F.round("avg_intensity", 3), "intensity_variance": F.round("intensity_variance", 4)})
    return r.drop("windows")


def _style_lint(c: DataFrame, rules: DataFrame, **_) -> DataFrame:
    d = lexicon.lint_chapters(c, lexicon.lint(c, rules), style.quick_scan(c))
    return d.select("doc_id", F.struct(*lexicon.totals()).alias("summary"), F.when(F.size("issues") > 0, F.sort_array("issues")).alias("issues"))


#: VL-8: what a module's name runs.
MODULES: dict[str, Callable[..., DataFrame]] = {"stats": _stats, "pacing": _pacing, "slop": lambda c, **_: style.weasel(c), "ai_score": _ai_score, "emotion": _emotion, "style_lint": _style_lint}


def run_module(name: str, chapters: DataFrame, **tables: DataFrame) -> DataFrame:
    """VL-8: (doc_id, metrics as JSON) of chapters(doc_id, text); tables has words and rules for the modules that want
    them. A chapter without text has an error, and so has every chapter under an unknown name."""
    error = lambda d, said: d.select("doc_id", F.to_json(F.struct(said.alias("error"))).alias("metrics"))
    if name not in MODULES:
        return error(chapters, F.lit(f"Unknown module: {name}"))
    there = chapters.where(F.col("text").isNotNull())
    m = MODULES[name](there, **tables)
    m = m.select("doc_id", F.to_json(F.struct(*[c for c in m.columns if c != "doc_id"])).alias("metrics"))
    return m.unionByName(error(chapters.where(F.col("text").isNull()), F.lit("File not found or missing")))


def analyze(chapters: DataFrame, words: DataFrame, rules: DataFrame, run_id: str) -> DataFrame:
    """VL-7: the log (run_id, book, doc_id, module, metrics) of chapters(doc_id, book, chapter_no, text): six modules a
    chapter, and a book's templates (two chapters or more) and lint roll-up (any issue) under chapter 0. Chapters' ids are
    unique and not 0. One plan a module over all books."""
    out = None
    for name in MODULES:
        part = run_module(name, chapters, words=words, rules=rules).join(chapters.select("doc_id", "book"), "doc_id").select("book", "doc_id", F.lit(name).alias("module"), "metrics")
        out = part if out is None else out.unionByName(part)
    t = style.templates(chapters).join(chapters.groupBy("book").count().where("count >= 2").drop("count"), "book", "left_semi")
    t = t.select("book", F.lit(WHOLE).cast("long").alias("doc_id"), F.lit("cross_chapter").alias("module"), F.to_json(F.struct("template_score", "repeated_openings", "length_cv", "dialogue_cv")).alias("metrics"))
    issues = lexicon.lint_short(chapters, lexicon.lint(chapters, rules), style.quick_scan(chapters))[0].join(chapters.select("doc_id", "book"), "doc_id")
    g = issues.groupBy("book").agg(F.count("*").alias("total_issues"), F.struct(*[F.count_if(F.col("severity") == s).alias(s) for s in ("ban", "warn", "info")]).alias("issues_by_severity"), F.count_distinct("check").alias("unique_checks"))
    g = g.select("book", F.lit(WHOLE).cast("long").alias("doc_id"), F.lit("style_lint_book").alias("module"), F.to_json(F.struct("total_issues", "issues_by_severity", "unique_checks")).alias("metrics"))
    return out.unionByName(t).unionByName(g).select(F.lit(run_id).alias("run_id"), "book", "doc_id", "module", "metrics")


def metric(json: Column, path: str) -> Column:
    """VL-4: the text of a value under a dotted path; null if any part of the path is missing."""
    return F.get_json_object(json, "$." + path)


def judged(json: Column, dimension: str, chars: Column) -> Column:
    """VL-3 to VL-5: struct(bad, name, value, op, threshold) of a dimension under a module's metrics. Without a threshold
    or a value nothing is bad. Pacing is bad by narration of over 0.75, too; redundancy by more than one issue, or any
    in texts under 2,000 characters."""
    said = lambda bad, name, value, op, threshold: F.struct(bad.alias("bad"), name.alias("name"), value.alias("value"), F.lit(op).cast("string").alias("op"), threshold.cast("string").alias("threshold"))
    if dimension not in V.THRESHOLDS:
        return said(F.lit(False), F.lit("unknown"), F.lit(None).cast("string"), None, F.lit(None))
    path, op, least = V.THRESHOLDS[dimension]
    value = metric(json, path)
    x, limit = value.try_cast("double"), F.lit(float(least))
    bad = F.coalesce({"lt": x < limit, "gt": x > limit, "lte": x <= limit, "gte": x >= limit}[op], F.lit(False))
    name, shown, threshold = F.lit(path), value, F.lit(str(least))
    if dimension == "pacing":
        told = metric(json, "narration_ratio").try_cast("double")
        slow = ~bad & F.coalesce(told > 0.75, F.lit(False))
        name, shown = F.when(slow, F.lit(path + "+narration_ratio")).otherwise(name), F.when(slow, F.concat(F.coalesce(value, F.lit("None")), F.lit("|narration="), F.format_string("%.1f%%", told * 100))).otherwise(value)
        bad = bad | slow
    if dimension == "redundancy":
        threshold = F.when(F.coalesce(chars, F.lit(0)) < 2000, 0).otherwise(1)
        bad = F.coalesce(x > threshold, F.lit(False))
    return said(bad, name, shown, op, threshold)


def judgements(log: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book, doc_id, chapter_no, dimension, module, bad, name, value, op, threshold) of each dimension of every chapter of
    chapters(doc_id, book, chapter_no) that has an analysis. A module that a chapter lacks is taken from the book's rows;
    of repeated rows of a module the last run's counts."""
    last = log.groupBy("book", "doc_id", "module").agg(F.max_by("metrics", "run_id").alias("metrics"))
    of = last.where(F.col("doc_id") != WHOLE).groupBy("book", "doc_id").agg(F.map_from_entries(F.collect_list(F.struct("module", "metrics"))).alias("own"))
    whole = last.where(F.col("doc_id") == WHOLE).groupBy("book").agg(F.map_from_entries(F.collect_list(F.struct("module", "metrics"))).alias("all"))
    j = chapters.select("doc_id", "book", "chapter_no").join(of, ["book", "doc_id"]).join(whole, "book", "left")
    chars = metric(F.col("own")["stats"], "chinese_chars").try_cast("long")
    each = [F.struct(F.lit(d).alias("dimension"), F.lit(m).alias("module"), judged(F.coalesce(F.try_element_at("own", F.lit(m)), F.try_element_at("all", F.lit(m))), d, chars).alias("j")) for d, m in V.DIMENSION_MODULE.items()]
    return j.select("book", "doc_id", "chapter_no", F.explode(F.array(*each)).alias("x")).select("book", "doc_id", "chapter_no", "x.dimension", "x.module", "x.j.*")


def _verdict(sentiment: Column, bad: Column) -> Column:
    return F.when((sentiment == "negative") & ~bad, "false_negative").when((sentiment == "positive") & bad, "false_positive").otherwise("matched")


#: Reviews and chapters of a block of comparisons. A pair of blocks is dealt out whole; Spark holds what one row of a
#: generator makes, so that a task holds some megabytes.
BLOCKS = (256, 1024)


def _blocks(rows: DataFrame, key: list[str], values: list[str], most: int) -> DataFrame:
    """(key..., block, v): rows with equal keys in arrays of `most` at most, in order of the first value."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(values[0]))
    return rows.select(*key, *values).withColumn("block", F.floor((n - 1) / most)).groupBy(*key, "block").agg(F.collect_list(F.struct(*values)).alias("v"))


def comparisons(said: DataFrame, judged_: DataFrame) -> DataFrame:
    """VL-6: a row for each review's dimension and chapter of its book: said(book, id, dimension, sentiment) against
    judgements, with verdict, whether it matched, confidence and what the gap is.

    There are as many rows as reviews times chapters of a book. So that no row is looked up or shuffled, blocks of
    reviews that say the same meet blocks of chapters that are alike bad: a pair has one verdict, is dealt to any task,
    and is unfolded there."""
    a = _blocks(said.where("book is not null and dimension is not null"), ["book", "dimension", "sentiment"], ["id"], BLOCKS[0])
    a = a.select("book", "dimension", "sentiment", F.col("block").alias("block_a"), F.col("v").alias("reviews"))
    b = _blocks(judged_.withColumn("gap", gap_of()), ["book", "dimension", "module", "bad"], ["doc_id", "gap"], BLOCKS[1])
    b = b.select("book", "dimension", "module", "bad", F.col("block").alias("block_b"), F.transform("v", lambda x: x["doc_id"]).alias("chapters"), F.transform("v", lambda x: x["gap"]).alias("gaps"))
    j = a.join(b, ["book", "dimension"]).withColumn("verdict", _verdict(F.col("sentiment"), F.col("bad")))
    sure = F.coalesce(*[F.when(F.col("verdict") == k, F.lit(v)) for k, v in V.CONFIDENCE.items()])
    j = j.select("book", "dimension", "module", "verdict", (F.col("verdict") == "matched").alias("matched"), sure.alias("confidence"), "sentiment", "bad", "block_a", "block_b", "reviews", "chapters", "gaps")
    parts = int(said.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    j = j.repartition(parts, "book", "dimension", "module", "sentiment", "bad", "block_a", "block_b")
    # The coalesce moves nothing. It keeps the generators apart: compiled into one, they would hold a whole pair's rows.
    j = j.select("*", F.inline("reviews")).drop("reviews").coalesce(parts).select("*", F.posexplode("chapters").alias("at", "doc_id"))
    return j.select("book", "id", "doc_id", "dimension", "module", "verdict", "matched", "confidence", F.when(F.col("matched"), "").otherwise(F.get("gaps", F.col("at"))).alias("gap_detail"))


def gap_of() -> Column:
    show = lambda c: F.coalesce(F.col(c), F.lit("None"))
    return F.concat(F.lit("["), "dimension", F.lit("] "), "name", F.lit("="), show("value"), F.lit(" vs threshold "), show("op"), F.lit(" "), show("threshold"), F.lit(" (ch "), F.col("chapter_no").cast("string"), F.lit(")"))


def counted(said: DataFrame, judged_: DataFrame) -> DataFrame:
    """VL-6 without making the comparisons: (book, dimension, verdict, n). Reviews are counted by what they say and
    chapters by whether they are bad; the counts multiply."""
    a = said.groupBy("book", "dimension", "sentiment").agg(F.count("*").alias("x"))
    b = judged_.groupBy("book", "dimension", "bad").agg(F.count("*").alias("y"))
    j = a.join(b, ["book", "dimension"]).withColumn("verdict", _verdict(F.col("sentiment"), F.col("bad")))
    return j.groupBy("book", "dimension", "verdict").agg(F.sum(F.col("x") * F.col("y")).alias("n"))


def gap_counts(said: DataFrame, judged_: DataFrame) -> DataFrame:
    """VL-6: (module, gap_type, description, n) of every mismatch, ready for the gaps' upsert; pre-aggregated likewise."""
    a = said.groupBy("book", "dimension", "sentiment").agg(F.count("*").alias("x"))
    j = a.join(judged_, ["book", "dimension"]).withColumn("verdict", _verdict(F.col("sentiment"), F.col("bad"))).where("verdict <> 'matched'")
    return j.groupBy("module", F.col("verdict").alias("gap_type"), gap_of().alias("description")).agg(F.sum("x").alias("n"))


def validate(reviews_: DataFrame, chapters: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """VL-6: (comparisons, counts, gap counts) of reviews(book, id, text) against the analyses of chapters."""
    said = reviews.dimensions(reviews_.select(F.struct("book", "id").alias("id"), "text")).select("id.book", "id.id", "dimension", "sentiment")
    j = judgements(log, chapters)
    return comparisons(said, j), counted(said, j), gap_counts(said, j)

