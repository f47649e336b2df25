"""Counts, readability, diversity and pacing of documents, and their roll-ups over books."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselens.functions import fixed_values as V
from proselens.functions import text as T


def count_chapter(docs: DataFrame) -> DataFrame:
    """ST-1..7: characters, paragraphs, dialogue lines, words and title of docs(doc_id, text)."""
    t = F.col("text")
    title = F.regexp_extract(t, r"(?m)^#\s+(.+)", 1)
    return docs.select(
        "doc_id", T.matches(t, T.WIDE).alias("chinese_chars"), F.length(F.translate(t, "\n\r", "")).alias("total_chars"),
        F.size(T.paragraphs(t)).alias("paragraphs"), T.matches(t, "「[^」]*」|“[^”]*”|\"[^\"]+\"").alias("dialogue_lines"), T.matches(t, T.WIDE).alias("words"),
        F.when(title != "", title).otherwise(F.concat(F.lit("ch"), "doc_id")).alias("title"),
    )


def _mattr(window: int) -> Column:
    step = F.greatest(F.lit(1), F.floor(F.greatest(F.col("n") - window, F.lit(1)) / 30)).cast("int")
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - window, F.lit(0)), step)
    sizes = F.transform(starts, lambda i: F.size(F.array_distinct(F.slice("r", i + 1, window))).cast("long"))
    return F.when(F.col("n") < window, F.lit(0.0)).otherwise(T.total(sizes) / (F.size(sizes) * window))


def mattr(docs: DataFrame, window: int = 50) -> DataFrame:
    """ST-8: mean share of distinct runs over windows; 0 below a window."""
    return docs.select("doc_id", T.runs(F.col("text")).alias("r")).withColumn("n", F.size("r")).select("doc_id", _mattr(window).alias("mattr"))


def _hd_d(r: DataFrame) -> Column:
    k = F.least(F.lit(42), F.greatest(F.floor(F.col("n") / 10), F.lit(1))).cast("int")
    draw = lambda j, c: F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(c), j.cast("string"))), 1, 6), 16, 10).cast("int")

    def share(j):
        size = F.least(F.pmod(draw(j, "a"), F.lit(16)) + 35, F.col("n"))
        at = F.pmod(draw(j, "b"), F.greatest(F.col("n") - size + 1, F.lit(1)))
        s = F.slice("r", at + 1, size)
        return F.size(F.array_distinct(s)) / F.greatest(F.size(s), F.lit(1))

    shares = F.transform(F.sequence(F.lit(1), k), share)
    return F.when(F.col("n") == 0, 0.0).otherwise(T.total_double(shares) / F.size(shares) * 0.9)


def hd_d(docs: DataFrame) -> DataFrame:
    """ST-9: mean diversity of contiguous samples of 35 to 50 runs, drawn by a hash of the document instead of chance."""
    r = docs.select("doc_id", T.runs(F.col("text")).alias("r")).withColumn("n", F.size("r"))
    return r.select("doc_id", _hd_d(r).alias("hd_d"))


def lexical_diversity(docs: DataFrame, window: int = 50) -> DataFrame:
    """ST-11: (doc_id, mattr, hd_d) from one list of a text's runs."""
    r = docs.select("doc_id", T.runs(F.col("text")).alias("r")).withColumn("n", F.size("r"))
    return r.select("doc_id", _mattr(window).alias("mattr"), _hd_d(r).alias("hd_d"))


def readability(docs: DataFrame, strokes: float = 10.0) -> DataFrame:
    """ST-10: 206.835 - 1.015 (han / sentences) - 0.846 strokes, mean sentence length, share of sentences over 40."""
    s = docs.select("doc_id", T.han(F.col("text")).alias("h"), T.matches(F.col("text"), T.WIDE).alias("w"), T.sentences(F.col("text"), 2).alias("s"))
    n = F.greatest(F.size("s"), F.lit(1))
    long_ = F.size(F.filter("s", lambda x: T.han(x) > 40))
    return s.select("doc_id", (206.835 - 1.015 * (F.col("w") / n) - 0.846 * strokes).alias("flesch_zh"), (F.col("w") / n).alias("avg_sentence_len"), (long_ / n).alias("long_sentence_ratio"))


def _spoken(t: str, opener: str, closer: str) -> str:
    """What stands between openers and the next closers. An opener that is never closed ends the search."""
    out, at = [], t.find(opener)
    while at >= 0 and (end := t.find(closer, at + 1)) >= 0:
        out.append(t[at + 1 : end])
        at = t.find(opener, end + 1)
    return "".join(out)


def _paces() -> Callable[[str | None], tuple]:
    described, acts, blank = [re.compile(p) for p in V.DESCRIPTION], re.compile(f"[{V.ACTION}]"), re.compile(r"\n[ \t\n\x0b\f\r]*\n")
    han = lambda x: int(np.count_nonzero(T.marked(T.codes(x), T.IS_HAN)))

    def measure(t):
        if t is None:
            return (None,) * 6
        p = [x for x in (x.strip(T.WHITE) for x in blank.split(t)) if len(x) > 5]
        spoken = _spoken(t, "「", "」") + _spoken(t, "“", "”")
        return han(t), han(spoken), sum(len(x.findall(t)) for x in described), len(acts.findall(t)), len(p), han("".join(p))

    return measure


def pacing(docs: DataFrame) -> DataFrame:
    """ST-14..21: dialogue, narration, description, paragraphs, scene changes and action. What is said, described and done is
    found in one pass of Arrow batches: a pattern for speech reads to the text's end at each opener that is not closed."""
    scenes = T.matches(F.col("text"), r"(?m)^[-*]{3,}\s*$")
    d = T.rows(docs.select("doc_id", "text", scenes.alias("scene_changes")), "h int, d int, x int, acts int, n int, lens long", _paces())
    n, one = F.col("n"), F.greatest(F.col("h"), F.lit(1))
    return d.select(
        "doc_id", (F.col("d") / one).alias("dialogue_ratio"), ((F.col("h") - F.col("d")) / one).alias("narration_ratio"), F.col("x").alias("description_hints"),
        n.alias("paragraphs"), (F.col("lens") / F.greatest(n, F.lit(1))).alias("avg_paragraph_len"), (n * 1000 / one).alias("paragraph_density"), "scene_changes",
        (F.col("d") / one).alias("show_vs_tell"), (F.col("acts") * 1000 / one).alias("action_density"),
    )


def count_book(chapters: DataFrame) -> DataFrame:
    """ST-12: chapters, characters, floored mean and whether the last chapter's end says so; chapters(book, chapter_no, text)."""
    c = chapters.select("book", "chapter_no", T.matches(F.col("text"), T.WIDE).alias("n"), F.right("text", F.lit(500)).rlike("完|终|…|END").alias("e"))
    return c.groupBy("book").agg(F.count("*").alias("chapters"), F.sum("n").alias("total_chars"), F.floor(F.sum("n") / F.count("*")).alias("avg_chars"), F.max_by("e", "chapter_no").alias("completed"))


def book_chapters(chapters: DataFrame) -> DataFrame:
    """ST-12: (book, chapter_no, chinese_chars), a book's list of chapters as rows, so that a long book is no single row."""
    return chapters.select("book", "chapter_no", T.matches(F.col("text"), T.WIDE).alias("chinese_chars"))


def readability_series(chapters: DataFrame) -> DataFrame:
    """ST-13: (book, chapter_no, flesch_zh), a book's series as rows."""
    return readability(chapters.withColumn("doc_id", F.struct("book", "chapter_no"))).select("doc_id.book", "doc_id.chapter_no", "flesch_zh")


def readout_book(chapters: DataFrame) -> DataFrame:
    """ST-13: mean and trend of readability over a book's chapters."""
    g = readability_series(chapters).groupBy("book").agg(F.count("*").alias("chapters"), F.avg("flesch_zh").alias("mean"), F.regr_slope("flesch_zh", F.col("chapter_no").cast("double")).alias("s"))
    return g.select("book", "chapters", "mean", F.when((F.col("chapters") >= 3) & (F.col("s") > 0.3), "easier").when((F.col("chapters") >= 3) & (F.col("s") < -0.3), "harder").otherwise("stable").alias("trend"))
