"""Sliding-window emotion curves and their shapes."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselens.functions import fixed_values as V
from proselens.functions import text as T


#: Characters of a window, and from one to the next.
SIZE, STEP = 500, 250
FRONT = re.compile(r"\A---.*?---\n", re.DOTALL)


def _weighed(docs: DataFrame, words: dict[str, tuple[str, float]], parts: Callable[[int], Callable[[int, int], range]], number: Callable[[int], int]) -> DataFrame:
    """(doc_id, length, w, found) of docs(doc_id, text) without front matter: the weights of its parts in tenths, which
    are exact numbers, and how often each word counts.

    An automaton of the words meets each text once, in Arrow batches: a pass over the windows for each word, in the JVM,
    took some three times as long. number(length) says how many parts there are, parts(length) which hold a place. No word of
    the lexicon overlaps itself, so every occurrence counts.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import ahocorasick

        auto = ahocorasick.Automaton()
        for word, (_, x) in words.items():
            auto.add_word(word, (word, len(word), round(x * 10)))
        auto.make_automaton()
        for b, texts in T.slices(batches):
            lengths, weights, found = [], [], []
            for t in texts:
                t = FRONT.sub("", t or "")
                w, n, of = [0] * number(len(t)), Counter(), parts(len(t))
                if w:
                    for end, (word, size, x) in auto.iter(t):
                        for i in of(end + 1 - size, end + 1):
                            w[i] += x
                            n[word] += 1
                lengths.append(len(t))
                weights.append(w)
                found.append([{"n": -k, "word": word} for word, k in n.items()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths, pa.int32()), pa.array(weights, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.struct([("n", pa.int32()), ("word", pa.string())])))], names=["doc_id", "length", "w", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, length int, w array<bigint>, found array<struct<n:int,word:string>>")


def _top(d: DataFrame, k: int) -> DataFrame:
    return d.select("doc_id", F.posexplode(F.slice(F.sort_array("found"), 1, k)).alias("rank", "x")).select("doc_id", "rank", "x.word", (-F.col("x.n")).alias("n"))


def _windows(docs: DataFrame) -> DataFrame:
    """Whole windows: a place of a few characters lies in two at most."""

    def number(length: int) -> int:
        return max(0, (length - SIZE) // STEP + 1)

    def parts(length: int):
        last = number(length) - 1
        return lambda a, b: range(max(0, -((SIZE - b) // STEP)), min(last, a // STEP) + 1)

    return _weighed(docs, V.EMOTIONS, parts, number)


def _intensity(tenths: Column) -> Column:
    """Weight for a hundred characters times 0.7, and 0.3 of an even sentiment; unrounded."""
    return tenths * 0.7 / (SIZE / 10.0) + 0.15


def curve(docs: DataFrame) -> DataFrame:
    """EM-1, EM-2: (doc_id, i, intensity) of each whole window of the text without its front matter."""
    return _windows(docs).select("doc_id", F.posexplode("w").alias("i", "x")).select("doc_id", "i", _intensity(F.col("x")).alias("intensity"))


def _stats(d: DataFrame) -> DataFrame:
    n = F.size("w")
    a, q = T.total(F.col("w")), T.total(F.transform("w", lambda x: x * x))
    mean = F.when(n > 0, _intensity(a / F.greatest(n, F.lit(1)))).otherwise(0.0)
    spread = F.sqrt((q * n - a * a).cast("double")) / F.greatest(n, F.lit(1)) * 0.7 / (SIZE / 10.0)
    penalty = F.when(F.col("length") < 2000, F.greatest(F.lit(0.3), F.col("length") / 2000)).otherwise(1.0)
    d = d.withColumns({"windows": n, "avg_intensity": mean, "intensity_variance": F.when(n > 1, spread * penalty).otherwise(0.0)})
    least = F.greatest(F.when(F.col("avg_intensity") > 0, F.col("avg_intensity") * 1.5).otherwise(0.5), F.lit(0.2))
    peaks = F.filter(F.transform("w", lambda x, i: F.when(_intensity(x) >= least, (i * STEP) / F.col("length"))), lambda p: p.isNotNull())
    return d.withColumn("peaks", peaks).withColumn("peak_count", F.size("peaks"))


def summary(docs: DataFrame) -> DataFrame:
    """EM-3: windows, mean intensity, its population deviation (less for texts under 2,000 characters), peaks (places)."""
    return _stats(_windows(docs)).select("doc_id", "windows", "avg_intensity", "intensity_variance", "peaks", "peak_count")


def keywords(docs: DataFrame, k: int = 15) -> DataFrame:
    """EM-4: (doc_id, rank, word, n): the words that occur most in the windows, an occurrence counting once in each window
    that holds it; ties by word."""
    return _top(_windows(docs), k)


def _arc(d: DataFrame) -> DataFrame:
    n, low, high = F.size("w"), F.array_min("w"), F.array_max("w")
    pick = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: (F.get("w", F.floor(j * (n - 1) / 7).cast("int")) - low) / (high - low))
    d = d.withColumn("s", F.when((n >= 4) & (_intensity(high) - _intensity(low) >= 0.01), pick))
    mse = lambda v: F.aggregate(F.zip_with("s", F.array(*map(F.lit, v)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x) / 8
    best = F.array_min(F.array(*[F.struct(mse(v).alias("e"), F.lit(k).alias("o"), F.lit(name).alias("name")) for k, (name, v) in enumerate(V.ARCS.items())]))
    d = d.withColumn("best", F.when(F.col("s").isNotNull(), best))
    arc = F.when(n < 4, "unknown").when(F.col("s").isNull(), "flat").otherwise(F.col("best.name"))
    confidence = F.when(n < 4, 0.0).when(F.col("s").isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.col("best.e")))
    return d.withColumns({"arc": arc, "confidence": confidence})


def arcs(docs: DataFrame) -> DataFrame:
    """EM-5: the nearest of six shapes by eight samples of the curve, and one less its mean square error; unknown (0)
    below four windows, flat (0.5) within 0.01."""
    return _arc(_windows(docs)).select("doc_id", "arc", "confidence")


def report(docs: DataFrame) -> DataFrame:
    """EM-6: everything about a document's curve but its keywords, in one projection; texts under a hundred characters
    have an error and no figures."""
    d = _arc(_stats(_windows(docs)))
    short = F.col("length") < 100
    figures = ["windows", "avg_intensity", "intensity_variance", "peaks", "peak_count", "arc", "confidence"]
    return d.select("doc_id", F.when(short, "Text too short").alias("error"), *[F.when(~short, F.col(c)).alias(c) for c in figures])


def _segments(docs: DataFrame, segments: int) -> DataFrame:
    """Equal segments of texts of a hundred characters or more, the last with the rest: c has their intensities."""

    def parts(length: int):
        size = max(length // segments, 1)

        def of(a: int, b: int) -> range:
            i = min(a // size, segments - 1)
            return range(i, i + (b <= (length if i == segments - 1 else (i + 1) * size)))

        return of

    d = _weighed(docs, {**V.EMOTIONS, **V.RHYTHM_EXTRA}, parts, lambda length: segments if length >= 100 else 0).where("length >= 100")
    size = F.greatest(F.floor(F.col("length") / segments), F.lit(1))
    long = lambda i: F.when(i < segments - 1, size).otherwise(F.col("length") - size * (segments - 1))
    return d.select("doc_id", "found", F.transform("w", lambda x, i: F.least(x * 10 / long(i), F.lit(3.0))).alias("c"))


def rhythm(docs: DataFrame, segments: int = 40) -> DataFrame:
    """ST-22: (doc_id, i, intensity) of equal segments, the last with the rest; weight for each hundred characters, 3 at
    most. Front matter is left out; texts under a hundred characters have no curve."""
    return _segments(docs, segments).select("doc_id", F.posexplode("c").alias("i", "intensity"))


def rhythm_report(docs: DataFrame, segments: int = 40) -> DataFrame:
    """ST-22: (doc_id, avg_intensity, peaks, peak_count): segments of over 0.2 and half more than the mean, as shares of
    the text."""
    d = _segments(docs, segments).select("doc_id", "c", (T.total_double(F.col("c")) / segments).alias("avg_intensity"))
    least = F.when(F.col("avg_intensity") > 0, F.col("avg_intensity") * 1.5).otherwise(0.5)
    peaks = F.filter(F.transform("c", lambda x, i: F.when((x >= least) & (x > 0.2), i / segments)), lambda p: p.isNotNull())
    return d.select("doc_id", "avg_intensity", peaks.alias("peaks")).withColumn("peak_count", F.size("peaks"))


def rhythm_keywords(docs: DataFrame, segments: int = 40, k: int = 15) -> DataFrame:
    """ST-22: (doc_id, rank, word, n): the words that occur most in the segments; ties by word."""
    return _top(_segments(docs, segments), k)
