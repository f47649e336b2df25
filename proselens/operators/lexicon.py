"""Lexicons and rule sheets as tables: hits, listings and lint with all words matched in one pass over a text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselens.functions import text as T

#: Characters of words in one automaton. A longer lexicon is matched in several passes, so what is sent to the executors
#: has a bound however long it is.
MOST = 1 << 20
DENSE = ("adverb_abuse", "dialogue_tags")


def _slices(words: DataFrame, most: int = MOST) -> Iterator[list[str]]:
    some, n = [], 0
    for r in words.where("word <> ''").select("word").distinct().orderBy("word").toLocalIterator():
        some.append(r["word"])
        n += len(r["word"])
        if n >= most:
            yield some
            some, n = [], 0
    if some:
        yield some


def _automaton(words: list[str]):
    import ahocorasick

    auto = ahocorasick.Automaton()
    for k, w in enumerate(words):
        auto.add_word(w, (k, len(w)))
    auto.make_automaton()
    return auto


def _counts(auto, text: str) -> dict[int, int]:
    """Occurrences of each word that don't overlap others of the same word, counted from the left."""
    counts: dict[int, int] = {}
    last: dict[int, int] = {}
    for end, (k, n) in auto.iter(text):
        if end - n + 1 >= last.get(k, 0):
            counts[k] = counts.get(k, 0) + 1
            last[k] = end + 1
    return counts


def hits(docs: DataFrame, words: DataFrame) -> DataFrame:
    """SL-8, SL-16: (doc_id, word, n) of every distinct word of words(word) that occurs in a text of docs(doc_id, text).

    An automaton of the words meets every text once; null texts have no hits. Nothing is shuffled.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = None
    for some in _slices(words):

        def run(batches, some=some):
            auto = _automaton(some)
            for b, texts in T.slices(batches):
                at, which, n = [], [], []
                for i, t in enumerate(texts):
                    for k, c in _counts(auto, t or "").items():
                        at.append(i)
                        which.append(some[k])
                        n.append(c)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(which, pa.string()), pa.array(n, pa.int32())], names=["doc_id", "word", "n"])

        part = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, word string, n int")
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], f"doc_id {kind}, word string, n int") if out is None else out


def contains(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """SL-16: the lexicon's rows whose word stands in a text: (doc_id, word, category, severity); repeated rows both count."""
    return hits(docs, lexicon).drop("n").join(lexicon.select("word", "category", "severity"), "word").select("doc_id", "word", "category", "severity")


def listing(lexicon: DataFrame, severity: str | None = None, category: str | None = None) -> DataFrame:
    """SL-16, SL-17: rows of a severity, else of a category, else all; repeated words are listed each time."""
    if severity is not None:
        return lexicon.where(F.col("severity") == severity)
    return lexicon.where(F.col("category") == category) if category is not None else lexicon


def totalled(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """docs(doc_id, text) with a column hits: occurrences of all distinct words of a lexicon. Each slice of the lexicon meets
    every text once; nothing is shuffled."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", F.lit(0).cast("long").alias("hits"))
    for some in _slices(lexicon):

        def run(batches, some=some):
            auto = _automaton(some)
            for b, texts in T.slices(batches):
                n = [sum(_counts(auto, t or "").values()) + k for t, k in zip(texts, b.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "text", "hits"])

        docs = docs.mapInArrow(run, f"doc_id {kind}, text string, hits long")
    return docs


def density(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """SL-8: (doc_id, blacklist_total_hits, blacklist_density for a hundred Han characters) of every document."""
    k = F.col("hits").cast("int")
    return totalled(docs, lexicon).select("doc_id", k.alias("blacklist_total_hits"), (k * 100 / T.per(F.coalesce("text", F.lit("")))).alias("blacklist_density"))


def top(docs: DataFrame, lexicon: DataFrame, k: int = 20) -> DataFrame:
    """SL-8: (doc_id, rank, word, n): a document's k most frequent words, ties by word."""
    g = hits(docs, lexicon).groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))), 1, k).alias("x"))
    return g.select("doc_id", F.posexplode("x").alias("rank", "x")).select("doc_id", "rank", "x.word", (-F.col("x.n")).alias("n"))


def lint(docs: DataFrame, rules: DataFrame, checks: list[str] | None = None, severity: str = "warn") -> DataFrame:
    """LN-1 to LN-4: (doc_id, check, pattern, severity, suggestion, line, context, count, per_1k) of rules(check, pattern,
    severity, suggestion, max_per_1k).

    checks selects rules by their check, unknown ones giving none; rules below the severity don't count. A rule gives an
    issue a line that holds its pattern, with the stripped line's first eighty characters; one of a density check gives
    one issue, of line -1, if it occurs more often than max_per_1k (999 if null) in a thousand Han characters.
    """
    rank = F.create_map(*[F.lit(x) for kv in {"ban": 0, "warn": 1, "info": 2}.items() for x in kv])
    order = {"ban": 0, "warn": 1, "info": 2}.get(severity, 1)
    kept = rules.where(F.coalesce(rank[F.coalesce("severity", F.lit("warn"))], F.lit(1)) <= order)
    if checks is not None:
        kept = kept.where(F.col("check").isin(checks)) if checks else kept.limit(0)
    kept = kept.withColumnRenamed("pattern", "word")
    dense = F.col("check").isin(*DENSE)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    lines = lines.select(F.struct("doc_id", (F.col("line") + 1).alias("line"), F.left(T.strip(F.col("text")), F.lit(80)).alias("context")).alias("doc_id"), "text")
    at = hits(lines, kept.where(~dense)).join(kept.where(~dense), "word")
    at = at.select("doc_id.doc_id", "check", F.col("word").alias("pattern"), "severity", F.coalesce("suggestion", F.lit("")).alias("suggestion"), "doc_id.line", "doc_id.context", F.lit(None).cast("int").alias("count"), F.lit(None).cast("double").alias("per_1k"))
    whole = docs.select(F.struct("doc_id", T.per(F.col("text")).alias("h")).alias("doc_id"), "text")
    often = hits(whole, kept.where(dense)).join(kept.where(dense), "word").withColumn("per_1k", F.col("n") * 1000 / F.col("doc_id.h")).where(F.col("per_1k") > F.coalesce("max_per_1k", F.lit(999.0)))
    often = often.select("doc_id.doc_id", "check", F.col("word").alias("pattern"), "severity", F.lit("").alias("suggestion"), F.lit(-1).alias("line"), F.lit("").alias("context"), F.col("n").alias("count"), "per_1k")
    return at.unionByName(often)


def summary(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """LN-5: (doc_id, total, ban, warn, info) of every document."""
    g = issues.groupBy("doc_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("ban", "warn", "info")])
    return docs.select("doc_id").join(g, "doc_id", "left").fillna(0, ["total", "ban", "warn", "info"])


def lint_short(docs: DataFrame, issues: DataFrame, quick: DataFrame, short: int = 2000) -> tuple[DataFrame, DataFrame]:
    """LN-7: issues and summaries in which texts under `short` characters also have the quick scan's issues, and only
    those in their summary, so that the two differ there."""
    d = lint_chapters(docs, issues, quick, short)
    return d.select("doc_id", F.inline("issues")), d.select("doc_id", *totals())


def totals() -> list[Column]:
    """LN-5: total, ban, warn and info of an array `counted`."""
    of = lambda s: lambda i: i["severity"] == s
    return [F.size("counted").cast("long").alias("total"), *[F.size(F.filter("counted", of(s))).cast("long").alias(s) for s in ("ban", "warn", "info")]]


def lint_chapters(docs: DataFrame, issues: DataFrame, quick: DataFrame, short: int = 2000) -> DataFrame:
    """LN-7, see lint_short: (doc_id, issues, counted) of every document, its issues and those that its summary counts as
    arrays of (check, severity), so that the rules and the quick scan meet a text once for both."""
    found = issues.select("doc_id", "check", "severity", F.lit(False).alias("quick")).unionByName(quick.select("doc_id", F.col("type").alias("check"), "severity", F.lit(True).alias("quick")))
    g = found.groupBy("doc_id").agg(F.collect_list(F.struct("check", "severity", "quick")).alias("x"))
    none = F.array().cast("array<struct<check:string,severity:string,quick:boolean>>")
    d = docs.select("doc_id", F.coalesce(F.length("text") < short, F.lit(False)).alias("few")).join(g, "doc_id", "left").select("doc_id", "few", F.coalesce("x", none).alias("x"))
    bare = lambda a: F.transform(a, lambda i: F.struct(i["check"].alias("check"), i["severity"].alias("severity")))
    return T.settled(d.select("doc_id", bare(F.filter("x", lambda i: ~i["quick"] | F.col("few"))).alias("issues"), bare(F.filter("x", lambda i: i["quick"] == F.col("few"))).alias("counted")))


def words_of(alphabet: str) -> Column:
    """A word list made by rule: all pairs of different characters of an alphabet."""
    chars = F.split(F.lit(alphabet), "")
    return F.flatten(F.transform(chars, lambda a: F.transform(F.filter(chars, lambda b: b != a), lambda b: F.concat(a, b))))
