"""Reviews and scraped pages: dimensions that reviews speak of, chapter text from HTML, clean titles."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselens.functions import fixed_values as V
from proselens.functions import text as T


def dimensions(reviews: DataFrame) -> DataFrame:
    """VL-1, VL-2: reviews(id, text) -> (id, dimension, sentiment): a dimension's longest word that occurs decides; a
    negation in the five characters before its first place turns the sentiment. One projection, no shuffle."""
    t = F.col("text")

    def sentiment(word: str, default: str):
        at = F.instr(t, word)
        before = F.when(at > 1, t.substr(F.greatest(at - 5, F.lit(1)), F.least(at - 1, F.lit(5)))).otherwise("")
        other = "positive" if default == "negative" else "negative"
        return F.when(at > 0, F.when(before.rlike("|".join(V.REVIEW_NEGATIONS)), other).otherwise(default))

    rules = sorted(V.REVIEW_WORDS, key=lambda r: -len(r[0]))
    each = [F.struct(F.lit(d).alias("dimension"), F.coalesce(*[sentiment(w, s) for w, x, s in rules if x == d]).alias("sentiment")) for d in dict.fromkeys(x for _, x, _ in rules)]
    return reviews.select("id", F.explode(F.array(*each)).alias("x")).select("id", "x.*").where("sentiment is not null")


class _Text(HTMLParser):
    """Stripped text nodes of a page, of its body, and of each container with a known id."""

    SKIP = {"script", "style", "noscript", "iframe"}
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str | None]] = []
        self.parts: dict[str | None, list[str]] = {None: []}

    def handle_starttag(self, tag, attrs):
        name = dict(attrs).get("id")
        mine = "body" if tag == "body" else f"#{name}" if name in V.CONTENT_IDS else None
        if mine in self.parts:  # the first container of a kind counts
            mine = None
        if mine:
            self.parts[mine] = []
        if tag not in self.VOID:
            self.open.append((tag, mine))

    def handle_endtag(self, tag):
        for i in reversed(range(len(self.open))):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if data.strip() and not any(tag in self.SKIP for tag, _ in self.open):
            for kind in {None, *(mine for _, mine in self.open)}:
                self.parts[kind].append(data.strip())


def chapter_of(page: str | None) -> str:
    """Text of the first known container, else of the body, else of all, without advertising and blank lines."""
    p = _Text()
    p.feed(page or "")
    p.close()
    kind = next((k for k in [f"#{i}" for i in V.CONTENT_IDS] + ["body"] if k in p.parts), None)
    text = "\n".join(p.parts[kind])
    for pattern in V.NAVIGATION:
        text = re.sub(pattern, "", text, flags=re.DOTALL)
    return "\n".join(x for x in (line.strip() for line in text.split("\n")) if x)


def clean_pages(pages: DataFrame) -> DataFrame:
    """HT-1: pages(page_id, html) -> (page_id, text). Nested containers need a parser, so this is Python in Arrow batches."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([chapter_of(x) for x in b.column(1).to_pylist()], pa.string())], names=["page_id", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "page_id long, text string")


def clean_titles(books: DataFrame) -> DataFrame:
    """HT-9: (id, title) without noise words and what stands in parentheses."""
    t = F.col("title")
    for word in V.TITLE_NOISE:
        t = F.replace(t, F.lit(word), F.lit(""))
    return books.select("id", T.strip(F.regexp_replace(t, r"[（(][^)）]*[)）]", "")).alias("title"))
