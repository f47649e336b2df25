"""Signs of formulaic writing: lexicon hits, templates, repetition, risk score and lint."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselens.functions import fixed_values as V
from proselens.functions import text as T
from proselens.operators import lexicon


DIVERSITY = "words long, types long, once long"
SPEECH = re.compile("[「\"][^」\"]+[」\"]")


def _diversity(a: np.ndarray) -> tuple[int, int, int]:
    """Han characters of a text's code points, different ones, and those that occur once."""
    n = np.bincount(a[T.marked(a, T.IS_HAN)] - 0x4E00, minlength=1)
    return int(n.sum()), int(np.count_nonzero(n)), int(np.count_nonzero(n == 1))


def _shares() -> list[Column]:
    return ["words", (F.col("types") / F.greatest("words", F.lit(1))).alias("ttr"), (F.col("once") / F.greatest("words", F.lit(1))).alias("hapax_ratio")]


def diversity(docs: DataFrame) -> DataFrame:
    """SL-2, SL-3: distinct share and share of characters that occur once (one token a Han character)."""
    return T.rows(docs.select("doc_id", "text"), DIVERSITY, lambda t: _diversity(T.codes(t or ""))).select("doc_id", *_shares())


SHAPE = "n int, a long, q long, near double"


def _shape(t: str | None, a: np.ndarray) -> tuple:
    """Of the lengths of a text's sentences: number, sum, sum of squares, and the sum of neighbours' likeness in order."""
    if t is None:
        return None, None, None, None
    n, first, last = T.spans(a)
    s = (last - first + 1)[last > first].astype(np.int64)
    x, y = s[:-1], s[1:]
    # cumsum adds one after another, as the SQL does; sum does not.
    near = float(np.cumsum(np.minimum(x, y) / np.maximum(x, y))[-1]) if len(x) else 0.0
    return len(s), int(s.sum()), int((s * s).sum()), near


def _shape_columns() -> list[Column]:
    n, a, q = F.col("n"), F.col("a"), F.col("q")
    cv = F.when((n < 2) | (a == 0), 0.0).otherwise(F.sqrt((q * n - a * a).cast("double")) / a)
    return [n.alias("sentence_count"), (a / F.greatest(n, F.lit(1))).alias("avg_sentence_len"), cv.alias("sentence_len_cv"), F.when(n < 2, 0.0).otherwise(F.col("near") / F.greatest(n - 1, F.lit(1))).alias("repetition_score")]


def sentence_shape(docs: DataFrame) -> DataFrame:
    """SL-4, SL-6: mean length, population variation, likeness of neighbouring lengths (unrounded)."""
    return T.rows(docs.select("doc_id", "text"), SHAPE, lambda t: _shape(t, T.codes(t or ""))).select("doc_id", *_shape_columns())


def linear(template: str) -> str:
    """A template of parts with lazy gaps between, as a pattern that reads each line once: from a line's start, the first
    place of each part that fits is the only one tried. That is as good as any, since a part's words don't nest and an
    earlier place leaves more room for the rest."""
    parts = re.split(r"(\.\{\d+,\}\?)", template)
    first = [f".*?{parts[0]}"] if parts[0] else []
    return "(?dm)^" + "".join(f"(?>{x})" for x in [*first, *(parts[i] + parts[i + 1] for i in range(1, len(parts), 2))])


STRUCTURE = "found array<string>"


def _structures() -> Callable[[str | None], tuple]:
    """Names of the templates in a text. Each part of a template is looked for by itself first, which is faster."""
    each = [(name, [re.compile(x) for x in reversed(re.split(r"\.\{\d+,\}\?", p)) if x], re.compile(linear(p).replace("(?dm)", "(?m)", 1))) for name, p in V.STRUCTURES.items()]
    return lambda t: ([n for n, parts, whole in each if all(p.search(t) for p in parts) and whole.search(t)] if t is not None else [],)


def _structure_columns() -> list[Column]:
    return [F.size("found").alias("structure_pattern_count"), F.array_join("found", ",").alias("structure_patterns")]


def structures(docs: DataFrame) -> DataFrame:
    """SL-5: names of the sentence templates in a text."""
    return T.rows(docs.select("doc_id", "text"), STRUCTURE, _structures()).select("doc_id", *_structure_columns())


def _overused(docs: DataFrame) -> DataFrame:
    """found: the words whose rounded rate exceeds two, the highest first, ties in order of the list."""
    t = F.col("text")
    each = F.transform(T.words(dict.fromkeys(V.OVERUSED, 0)), lambda w: F.struct(T.occurrences(t, w["word"]).alias("count"), w["k"].alias("k"), w["word"].alias("word")))
    each = F.transform(each, lambda x: F.struct((x["count"] * 1000 / F.col("h")).alias("rate"), x["k"].alias("k"), x["word"].alias("word"), x["count"].alias("count")))
    # A rate rounded to two places exceeds 2.0 if it exceeds the double 2.005, which lies below that decimal.
    over = F.transform(F.filter(each, lambda x: x["rate"] > 2.005), lambda x: F.struct((-F.round(x["rate"], 2)).alias("o"), x["k"].alias("k"), x["word"].alias("word"), x["count"].alias("count")))
    return T.settled(T.settled(docs.select("doc_id", "text", T.per(t).alias("h"))).select("doc_id", F.sort_array(over).alias("found")))


def overused(docs: DataFrame, most: int = 20) -> DataFrame:
    """SL-13: (doc_id, rank, word, count, per_1k): the first twenty words above two in a thousand Han characters, both
    rounded to two places."""
    x = F.posexplode(F.slice("found", 1, most)).alias("rank", "x")
    return _overused(docs).select("doc_id", x).select("doc_id", "rank", "x.word", "x.count", (-F.col("x.o")).alias("per_1k"))


def overused_report(docs: DataFrame) -> DataFrame:
    """SL-13: (doc_id, overused_count, suggestions): two sentences if any word is overused."""
    names = F.array_join(F.transform(F.slice("found", 1, 5), lambda x: x["word"]), "、")
    said = F.array(F.concat(F.lit(V.OVERUSED_SAID[0][0]), names, F.lit(V.OVERUSED_SAID[0][1])), F.lit(V.OVERUSED_SAID[1]))
    return _overused(docs).select("doc_id", F.size("found").alias("overused_count"), F.when(F.size("found") > 0, said).otherwise(F.array().cast("array<string>")).alias("suggestions"))


def weasel(docs: DataFrame) -> DataFrame:
    """SL-14: a literal counts once a document, a pattern once a place."""
    t = F.col("text")
    once = lambda ws: sum((t.contains(w).cast("int") for w in ws), F.lit(0))
    pat = lambda k: sum((T.matches(t, p) for c, p in V.WEASEL_PATTERNS if c == k), F.lit(0))
    w, h, c = once(V.WEASEL) + pat("weasel"), once(V.HEDGE) + pat("hedge"), pat("cliche_structure")
    return docs.select("doc_id", w.alias("weasel"), h.alias("hedge"), c.alias("cliche_structure"), (w + h + c).alias("total_hits"))


def _phrases(a: np.ndarray, least: int, longest: int, repeats: int) -> int:
    """How many different n-grams of the joined Han text occur often enough: a gram is a number, and equal ones are neighbours
    once sorted."""
    h = a[T.marked(a, T.IS_HAN)]
    if len(h) < least:
        return 0
    own, h = np.unique(h, return_inverse=True)
    h, base, size, k = h.astype(np.int64), len(own), len(own), 0
    x = h
    for n in range(1, longest + 1):
        if n > 1:
            if size > (1 << 62) // base:  # numbers are dealt anew before they would be too large
                own, x = np.unique(x, return_inverse=True)
                x, size = x.astype(np.int64), len(own)
            x, size = x[:-1] * base + h[n - 1 :], size * base
        if n >= least and len(x) >= repeats:
            s = np.sort(x)
            k += int(np.count_nonzero((s[repeats - 1 :] == s[: len(s) - repeats + 1]) & np.concatenate([[True], s[1:] != s[:-1]])[: len(s) - repeats + 1]))
    return k


PHRASES = "k long"


def _phrase_columns(top: int = 50) -> list[Column]:
    return [F.least(F.lit(top), "k").cast("int").alias("repeated_phrase_count"), (F.least(F.lit(20), "k") * 5).cast("int").alias("phrase_repetition_score")]


def phrases(docs: DataFrame, least: int = 3, longest: int = 5, repeats: int = 3, top: int = 50) -> DataFrame:
    """SL-15: repeated n-grams of the joined Han text, five points each up to 100. """
    return T.rows(docs.select("doc_id", "text"), PHRASES, lambda t: (_phrases(T.codes(t or ""), least, longest, repeats),)).select("doc_id", *_phrase_columns(top))


def report(docs: DataFrame, words: DataFrame) -> DataFrame:
    """SL-7: the measures of a text side by side: diversity, sentence shape, templates, lexicon, phrases. All are made of a
    text in one pass, so that nothing is shuffled or joined."""
    named = _structures()

    def measure(t):
        a = T.codes(t or "")
        return *_diversity(a), *_shape(t, a), *named(t), _phrases(a, 3, 5, 3)

    d = T.rows(lexicon.totalled(docs.select("doc_id", "text"), words), f"{DIVERSITY}, {SHAPE}, {STRUCTURE}, {PHRASES}", measure)
    hits = F.col("hits").cast("int")
    return d.select("doc_id", *_shares(), *_shape_columns(), *_structure_columns(), hits.alias("blacklist_total_hits"), (hits * 100 / F.greatest("words", F.lit(1))).alias("blacklist_density"), *_phrase_columns())


def risk(docs: DataFrame, words: DataFrame) -> DataFrame:
    """SL-9: the clamped sub-scores of a report, their weighted total and its band."""
    m = report(docs, words)
    cut: Column = lambda c: F.greatest(F.lit(0), F.least(F.lit(100), c.cast("int")))
    s = m.select(
        "doc_id", cut((0.6 - F.col("ttr")) * 250.0).alias("ttr"), cut((0.7 - F.col("sentence_len_cv")) * 250.0).alias("sentence_variance"), F.least(F.lit(100), F.col("structure_pattern_count") * 20).alias("structure"),
        F.least(F.lit(100), (F.col("blacklist_density") * 15.0).cast("int")).alias("blacklist"), cut((F.col("repetition_score") - 0.3) * 250.0).alias("repetition"), F.least(F.lit(100), F.col("phrase_repetition_score")).alias("phrase_rep"),
    )
    # Weights are twentieths, so that the total is exact.
    total = sum((F.col(k) * int(round(w * 20)) for k, w in V.RISK_WEIGHTS.items()), F.lit(0))
    return s.withColumn("verdict", F.when(total < 600, "low").when(total < 1200, "middle").otherwise("high")).withColumn("total_score", F.bround(total / 20.0, 0).cast("int"))


def _linguistic(t: str | None) -> tuple:
    if t is None:
        return (None,) * 10
    a = T.codes(t)
    s = T.spans(a)[0].astype(np.int64)
    good, bad = (sum(t.count(w) for w in ws) for ws in (V.GLAD, V.SAD))
    r = re.findall(f"{T.HAN}+", t)
    among = lambda chars: sum(t.count(c) for c in set(chars))
    return len(s), int(s.sum()), int((s * s).sum()), len(set(r)), len(r), good, bad, among(V.MARKS), among(V.STOP), int(np.count_nonzero(T.marked(a, T.IS_HAN)))


def linguistic(docs: DataFrame) -> DataFrame:
    """SL-10, and SL-11 without a language model: Han lengths of sentences, diversity of runs, sentiment, punctuation for
    a hundred Han characters, share of stop words. One pass over a text in Arrow batches."""
    d = T.rows(docs.select("doc_id", "text"), "n int, a long, q long, types int, runs int, good int, bad int, marks int, stop int, h int", _linguistic)
    n, a, q, h = F.col("n"), F.col("a"), F.col("q"), F.greatest(F.col("h"), F.lit(1))
    return d.select(
        "doc_id", (a / F.greatest(n, F.lit(1))).alias("avg_sentence_len"), F.when(a > 0, F.sqrt((q * n - a * a).cast("double")) / a).otherwise(0.0).alias("sentence_len_cv"),
        (F.col("types") / F.greatest("runs", F.lit(1))).alias("ttr"), ((F.col("good") - F.col("bad")) / F.greatest(F.col("good") + F.col("bad"), F.lit(1))).alias("sentiment"),
        (F.col("marks") * 100 / h).alias("punct_density"), (F.col("stop") / h).alias("stopword_ratio"),
    )


def _opening(t: str | None) -> tuple:
    """A text's first eight Han characters, length, lines of speech and Han characters."""
    if t is None:
        return (None,) * 4
    first = "".join(m.group() for m in islice(re.finditer(T.HAN, t), 8))
    return first, len(t), _lines(t), int(np.count_nonzero(T.marked(T.codes(t), T.IS_HAN)))


def _lines(t: str) -> int:
    """How often an opening mark, one character or more and a closing mark follow each other; as a pattern, each opener that
    is never closed would be read to the text's end."""
    n, at, last = 0, 0, max(t.rfind("」"), t.rfind('"'))
    while m := SPEECH.search(t, at, last + 1):
        n, at = n + 1, m.end()
    return n


def templates(chapters: DataFrame) -> DataFrame:
    """SL-18: (book, repeated_openings, length_cv, dialogue_cv, template_score) of each book: openings of eight Han
    characters that recur, the spread of chapter lengths and of lines of speech for a hundred Han characters (rounded to
    three places), and a score. A book of one chapter has zeros."""
    c = T.rows(chapters.select("book", "text"), "o string, n long, lines int, h int", _opening).withColumn("d", F.col("lines") / F.greatest(F.greatest("h", F.lit(1)) / 100, F.lit(1.0)))
    # One aggregate by opening, and one of its rows, so that texts are read once. The deviation is made of sums.
    some = F.col("n") > 0
    o = c.groupBy("book", "o").agg(
        F.count("*").alias("c"), F.count_if(some).alias("k"), F.sum("n").alias("a"), F.sum(F.col("n") * F.col("n")).alias("q"),
        F.count("d").alias("dn"), F.sum("d").alias("d"), F.sum(F.col("d") * F.col("d")).alias("dq"),
    )
    g = o.groupBy("book").agg(
        F.count_if((F.col("c") >= 2) & (F.length("o") == 8)).alias("repeated_openings"), F.sum("c").alias("chapters"), *[F.sum(x).alias(x) for x in ("k", "a", "q")],
        (F.sum("d") / F.sum("dn")).alias("dm"), F.sqrt(F.greatest(F.sum("dq") / F.sum("dn") - F.pow(F.sum("d") / F.sum("dn"), 2), F.lit(0.0))).alias("ds"),
    )
    length_cv = F.when((F.col("k") > 1) & (F.col("a") > 0), F.round(F.sqrt((F.col("q") * F.col("k") - F.col("a") * F.col("a")).cast("double")) / F.col("a"), 3)).otherwise(0.0)
    dialogue_cv = F.when((F.col("chapters") > 1) & (F.col("dm") > 0), F.round(F.col("ds") / F.col("dm"), 3)).otherwise(0.0)
    j = g.select("book", "chapters", F.when(F.col("chapters") > 1, F.col("repeated_openings")).otherwise(0).alias("repeated_openings"), length_cv.alias("length_cv"), dialogue_cv.alias("dialogue_cv"))
    low = lambda x, by: F.greatest(F.lit(0), ((0.3 - F.least(x, F.lit(0.3))) * by).cast("int"))
    score = F.least(F.lit(100), F.col("repeated_openings") * 15 + low(F.col("length_cv"), 100.0) + low(F.col("dialogue_cv"), 80.0))
    return j.select("book", "repeated_openings", "length_cv", "dialogue_cv", F.when(F.col("chapters") > 1, score).otherwise(0).cast("int").alias("template_score"))


def openings(chapters: DataFrame, most: int = 5) -> DataFrame:
    """SL-18: (book, rank, opening, n): a book's most frequent openings that recur; ties by opening."""
    o = T.rows(chapters.select("book", "text"), "o string, n long, lines int, h int", _opening).where(F.length("o") == 8).groupBy("book", "o").count().where("count >= 2")
    top = o.groupBy("book").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("n"), "o"))), 1, most).alias("x"))
    return top.select("book", F.posexplode("x").alias("rank", "x")).select("book", "rank", F.col("x.o").alias("opening"), (-F.col("x.n")).alias("n"))


def quick_scan(docs: DataFrame) -> DataFrame:
    """LN-6: (doc_id, type, severity, amount) of five simple signs. The fourth looks for a Han character before a literal
    backslash and 1, which is what the fixed pattern says, so doubled characters don't count."""
    t = F.col("text")
    s = F.transform(T.sentences(t, 3, "[。！？…]"), lambda x: F.left(x, F.lit(2)))
    n = F.greatest(F.size(s) - 1, F.lit(0))
    same = F.size(F.filter(F.zip_with(F.slice(s, 1, n), F.slice(s, 2, n), lambda a, b: a == b), lambda x: x))
    each = lambda k: k / (T.per(t) / 100)
    signs = [
        ("adverb_abuse", "warn", each(T.matches(t, T.HAN + "{1,3}地")), 2),
        ("repetition", "warn", same.cast("double"), 1),
        ("exclamation", "info", each(T.count_of(t, "！")), 5),
        ("doubled", "info", T.matches(t, T.HAN + r"\\1").cast("double"), 2),
        ("filler", "info", each(T.count_of(t, "了")), 8),
    ]
    found = F.array(*[F.struct(F.lit(k).alias("type"), F.lit(v).alias("severity"), x.alias("amount"), F.lit(float(limit)).alias("limit")) for k, v, x, limit in signs])
    return docs.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*").where("amount > limit").drop("limit")


def repetition(docs: DataFrame, max_han: int = 20000, max_types: int = 5000) -> DataFrame:
    """SL-12: (doc_id, kind, rank, phrase, n): starts of sentences and paragraphs and phrases that recur. Counting of
    phrases stops at a number of different ones in order of place, which only sequential code can tell."""

    def scan(text: str) -> list[tuple[str, str, int]]:
        sentences = [x for x in map(str.strip, re.split("[。！？…]+", text)) if len(x) > 3]
        openings = [re.split("[。！？…]", p)[0].strip() for p in map(str.strip, re.split(r"\n\s*\n", text)) if len(p) > 5]
        taken, runs = 0, []
        for run in re.findall(T.HAN + "+", text):
            if taken >= max_han:
                break
            taken += len(run)
            runs.append(run)
        phrases: Counter = Counter()
        for g in (r[i : i + n] for r in runs for n in range(3, min(6, len(r) + 1)) for i in range(len(r) - n + 1)):
            phrases[g] += 1
            if len(phrases) >= max_types:
                break
        kinds = [("sentence_2", Counter(x[:2] for x in sentences), 20, 3, 20), ("sentence_3", Counter(x[:3] for x in sentences), 20, 3, 20), ("paragraph", Counter(x[:4] for x in openings if len(x) >= 3), 15, 2, 15), ("phrase", phrases, 30, 3, 20)]
        return [(kind, rank, p, n) for kind, c, top, least, shown in kinds for rank, (p, n) in enumerate([x for x in c.most_common(top) if x[1] >= least][:shown])]

    def run(batches):
        for b in batches:
            rows = [(i, *x) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in scan(t or "")]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32()])], names=["doc_id", "kind", "rank", "phrase", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, kind string, rank int, phrase string, n int")
