"""Books, chapters and reviews from HTML pages: site rules, listings, chapter lists, search, discovery, comments, posts.

Fetching is not done here: pages come as rows (page_id, url, html).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proselens.functions import fixed_values as V
from proselens.functions import text as T

#: Characters of links in one batch, so that what a task holds is its page and not all links of its pages.
MOST = 1 << 20
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def domain(url: Column) -> Column:
    """HT-2: a url's host in lower case, without the first of www., m. and wap."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), r"^(?:www\.|m\.|wap\.)", "")


def site_rules(pages: DataFrame) -> DataFrame:
    """HT-2: pages(page_id, url) with domain, list_kind, list_value, content_kind, content_value and base_type of its
    site; null without a rule. The rules are a constant map, so nothing is joined."""
    return pages.select("page_id", domain(F.col("url")).alias("domain")).withColumn("r", _rule(F.col("domain"))).select("page_id", "domain", "r.*")


def _rule(domain: Column) -> Column:
    kind = "struct<list_kind:string,list_value:string,content_kind:string,content_value:string,base_type:string>"
    rules = F.create_map(*[x for d, r in V.SITE_RULES.items() for x in (F.lit(d), F.struct(*map(F.lit, r)).cast(kind))])
    return F.try_element_at(rules, domain)


def _matches(html: Column, pattern: str, names: list[str]) -> Column:
    """The groups of all places of a pattern, as an array of structs."""
    groups = [F.regexp_extract_all(html, F.lit(pattern), F.lit(k + 1)) for k in range(len(names))]
    return F.transform(F.arrays_zip(*groups), lambda x: F.struct(*[T.strip(x[str(k)]).alias(n) for k, n in enumerate(names)]))


def _first_urls(found: DataFrame, limit: int | None) -> DataFrame:
    """Rows of found(page_id, i, url, ...) without those whose url stands earlier on the page, the first `limit` of each
    (None: all)."""
    once = found.withColumn("k", F.row_number().over(Window.partitionBy("page_id", "url").orderBy("i"))).where("k = 1")
    numbered = once.withColumn("i", F.row_number().over(Window.partitionBy("page_id").orderBy("i")) - 1).drop("k")
    return numbered if limit is None else numbered.where(F.col("i") < limit)


def home_books(pages: DataFrame, base: str, limit: int = 10) -> DataFrame:
    """HT-3: (page_id, i, title, author, url) of the books of a home page: a link and the span after it."""
    p = r'(?s)<a href="(/look/\d+/)"[^>]*>([^<]+)</a>.*?<span[^>]*>([^<]+)</span>'
    d = pages.select("page_id", F.posexplode(_matches(F.col("html"), p, ["path", "title", "author"])).alias("i", "x"))
    return _first_urls(d.select("page_id", "i", "x.title", "x.author", F.concat(F.lit(base), "x.path").alias("url")), limit)


def category_books(pages: DataFrame, base: str, limit: int = 10) -> DataFrame:
    """HT-3: (page_id, i, title, author, url) of a category page: links by place, with the span of the same number; titles
    of one character are left out."""
    groups = lambda p, *ks: [F.regexp_extract_all("html", F.lit(p), F.lit(k)) for k in ks]
    # Zipped before they are dealt out: a row beside the whole array of spans made as many copies of it as there are links.
    found = F.arrays_zip(*groups(r'<a\s+href="(/look/\d+/)"[^>]*>([^<]+)</a>', 1, 2), *groups(r"<span[^>]*>([^<]{2,8})</span>", 1))
    d = pages.select("page_id", F.posexplode(found).alias("i", "x")).where(F.col("x.0").isNotNull())
    d = d.select("page_id", "i", T.strip(F.col("x.0")).alias("path"), T.strip(F.col("x.1")).alias("title"), F.coalesce("x.2", F.lit("")).alias("author")).where(F.length("title") >= 2)
    return _first_urls(d.select("page_id", "i", "title", "author", F.concat(F.lit(base), "path").alias("url")), limit)


class _Node:
    """An open element: what links below it need of it. The first span below it is two places in the page's texts."""

    __slots__ = ("tag", "up", "classes", "first_of", "span", "around")

    def __init__(self, tag: str, up: _Node | None, classes: list[str], first_of: list[str]):
        self.tag, self.up, self.classes, self.first_of, self.span, self.around = tag, up, classes, first_of, None, None


class _Links(HTMLParser):
    """Links in order. No tree is kept: an element's texts are neighbours in the page's list of texts, and whether an
    element has a span below is noted as the span opens, up to the first element around that has one already. So time
    and memory grow with the page, not with its links times what is beside or around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.at = self.root = _Node("", None, [], [])
        self.known: set[str] = set()
        self.open: Counter = Counter()
        self.texts: list[str] = []
        self.links: list[tuple[str, _Node, list[int]]] = []
        self.ends: dict[int, list[int]] = {}  # of open links and spans, by node

    def handle_starttag(self, tag, attrs):
        attrs = dict((k, v or "") for k, v in attrs)
        classes, first_of = attrs.get("class", "").split(), []
        for name in [*(f"class={c}" for c in classes), *([f"id={attrs['id']}"] if "id" in attrs else [])]:
            if name not in self.known:
                self.known.add(name)
                first_of.append(name)
        node = _Node(tag, self.at, classes, first_of)
        if tag == "span" or (tag == "a" and "href" in attrs):
            place = [len(self.texts), -1]
            self.ends[id(node)] = place
            if tag == "a":
                self.links.append((attrs["href"].strip(), self.at, place))
            else:
                up = self.at
                while up is not None and up.span is None:
                    up.span = place
                    up = up.up
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_endtag(self, tag):
        while self.open[tag]:
            node = self.at
            self.at = node.up
            self.open[node.tag] -= 1
            if place := self.ends.pop(id(node), None):
                place[1] = len(self.texts)
            if node.tag == tag:
                break

    def handle_data(self, data):
        if data := data.strip():
            self.texts.append(data)

    def text(self, place: list[int]) -> str:
        return "".join(self.texts[place[0] : place[1] if place[1] >= 0 else len(self.texts)])


def _around(node: _Node) -> tuple[list[str], list[str]]:
    """The classes around, and the names of which the page's first element is around; kept where links hang."""
    if node.around is None:
        inside, first_in, at = set(), set(), node
        while at is not None and at.around is None:
            inside.update(at.classes)
            first_in.update(at.first_of)
            at = at.up
        more = at.around if at is not None else ([], [])
        same = at is not None and inside <= set(more[0]) and not first_in
        node.around = more if same else (sorted(inside.union(more[0])), sorted(first_in.union(more[1])))
    return node.around


def page_links(html: str | None, url: str | None) -> Iterator[dict]:
    """Links of a page: target as it stands and resolved, text, the first span of the parent, the classes of all elements
    around (inside), and the classes and ids of which the page's first element is around (first_in)."""
    t = _Links()
    t.feed(html or "")
    t.close()
    for i, (href, up, place) in enumerate(t.links):
        inside, first_in = _around(up)
        try:
            full = urljoin(url or "", href)
        except ValueError:
            full = href
        yield {"i": i, "href": href, "url": full, "text": t.text(place), "author": t.text(up.span) if up.span else "", "inside": inside, "first_in": first_in}


LINKS = "page_id long, i int, href string, url string, text string, author string, inside array<string>, first_in array<string>"


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (page_id, url, html, within) as the links of each page, about MOST characters of them at a time."""
    kinds = [pa.int64(), pa.int32(), *[pa.string()] * 4, pa.list_(pa.string()), pa.list_(pa.string())]
    names = ["page_id", "i", "href", "url", "text", "author", "inside", "first_in"]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)
    for b in batches:
        rows, size = [], 0
        for k in range(b.num_rows):
            page_id, url, html, within = (c[k].as_py() for c in b.columns)
            for x in page_links(html, url):
                if within is not None and within not in x["first_in"]:
                    continue
                rows.append({"page_id": page_id, **x})
                size += 64 + sum(len(x[n]) for n in names[2:6]) + 16 * (len(x["inside"]) + len(x["first_in"]))
                if size > MOST:
                    yield made(rows)
                    rows, size = [], 0
        yield made(rows)


def links(pages: DataFrame, holder: Column | None = None) -> DataFrame:
    """Every link of pages(page_id, url, html), see page_links; with a holder (class=... or id=...) only those inside the
    page's first such element. Containers nest, so this is a parser in Arrow batches."""
    within = F.lit(None).cast("string") if holder is None else holder
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", within.alias("within")).mapInArrow(_link_batches, LINKS)


def other_home_books(pages: DataFrame, limit: int = 10) -> DataFrame:
    """HT-3: books of a home page of any other site: links with a text of two characters or more that isn't navigation."""
    d = links(pages).where((F.length("text") >= 2) & (F.col("href") != "#") & ~F.col("text").isin(V.SKIP_HOME))
    return _first_urls(d.select("page_id", "i", F.col("text").alias("title"), "author", "url"), limit)


def ranking_books(pages: DataFrame, base: str, page: int = 1, limit: int = 10) -> DataFrame:
    """HT-3: (page_id, i, title, author, url, rank) of a ranking page: links inside blocks; ranks count repeated books,
    too, and start after twenty for each page before."""
    d = links(pages).where(F.array_contains("inside", "block") & F.col("href").rlike(r"^/look/\d+/") & (F.col("text") != ""))
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy("i")) + (page - 1) * 20)
    return _first_urls(d.select("page_id", "i", F.col("text").alias("title"), "author", F.concat(F.lit(base), "href").alias("url"), "rank"), limit)


def chapter_list(pages: DataFrame, base: str, limit: int = 50) -> DataFrame:
    """HT-4: (page_id, chapter_no, title, url) of a book's page by its definition list: the first of equal numbers, in
    order of number. A bare file's folder is the page's own."""
    p = r'<dd>\s*<a\s+href\s*=\s*"((?:/look/\d+/)?(\d+)\.html)"\s*>\s*([^<]+?)\s*</a>\s*</dd>'
    d = pages.select("page_id", "url", F.posexplode(_matches(F.col("html"), p, ["path", "no", "title"])).alias("i", "x"))
    folder = F.regexp_extract("url", r"/look/(\d+)/", 1)
    path = F.when(~F.startswith("x.path", F.lit("/look/")) & (folder != ""), F.concat(F.lit("/look/"), folder, F.lit("/"), F.col("x.path"))).otherwise(F.col("x.path"))
    d = d.select("page_id", "i", F.col("x.no").try_cast("long").alias("chapter_no"), "x.title", F.concat(F.lit(base), path).alias("url"))
    once = d.withColumn("k", F.row_number().over(Window.partitionBy("page_id", "chapter_no").orderBy("i"))).where("k = 1")
    return once.withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy("chapter_no"))).where(F.col("k") <= limit).select("page_id", "chapter_no", "title", "url")


def site_chapter_list(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """HT-4: (page_id, chapter_no, title, url) of a book's page by its site's rule: links of the first container that the
    rule names, numbered in order; navigation is left out. Pages without a rule give nothing; a limit keeps the first."""
    r = _rule(domain(F.col("url")))
    ruled = pages.select("page_id", "url", "html", F.concat(r["list_kind"], F.lit("="), r["list_value"]).alias("holder")).where("holder is not null")
    d = links(ruled, F.col("holder")).where((F.col("text") != "") & ~F.col("href").isin("", "#"))
    d = d.where(~F.col("text").rlike("|".join(V.SKIP_CHAPTER)))
    return _first_urls(d.select("page_id", "i", F.col("text").alias("title"), "url"), limit).select("page_id", (F.col("i") + 1).alias("chapter_no"), "title", "url")


def search_match(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """HT-5: found(page_id, i, title, author, url) against wanted(page_id, want_title, want_author): the first whose title
    holds the wanted one and whose author, if both are known, holds the wanted one or stands in it."""
    lenient = (F.coalesce("want_author", F.lit("")) == "") | (F.coalesce("author", F.lit("")) == "") | F.col("author").contains(F.col("want_author")) | F.col("want_author").contains(F.col("author"))
    j = found.join(wanted, "page_id").where(F.col("title").contains(F.col("want_title")) & lenient)
    return j.groupBy("page_id").agg(F.min(F.struct("i", "title", "author", "url")).alias("x")).select("page_id", "x.title", "x.author", "x.url")


def discover(sources: list[DataFrame], limit: int = 10) -> DataFrame:
    """HT-6: books of several sources(i, title, author, url), each url where it comes first, in order of source and place,
    the first `limit`. One sorted limit, not a window over everything."""
    every = None
    for k, s in enumerate(sources):
        part = s.select(F.lit(k).alias("source"), "i", "title", "author", "url")
        every = part if every is None else every.unionByName(part)
    once = every.groupBy("url").agg(F.min(F.struct("source", "i", "title", "author")).alias("x"))
    return once.select("x.source", "x.i", "x.title", "x.author", "url").orderBy("source", "i", "url").limit(limit)


def deprecated(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """HT-6: books(id, status, ...) with status deprecated if chapters(book_id) has none of theirs."""
    some = chapters.select(F.col("book_id").alias("id")).distinct().withColumn("some", F.lit(True))
    return books.join(some, "id", "left").withColumn("status", F.when(F.col("some").isNull(), "deprecated").otherwise(F.col("status"))).drop("some")


def _plain(html: Column) -> Column:
    return T.strip(F.regexp_replace(html, "<[^>]+>", ""))


def comments(pages: DataFrame, limit: int = 20) -> DataFrame:
    """HT-7: (page_id, i, content, rating, sentiment) of a page's short comments of five characters or more among the first
    `limit`; the rating has the same number and is null beyond the ratings there are, and two or less is negative."""
    said = F.slice(F.regexp_extract_all("html", F.lit(r'(?s)<span class="short">(.*?)</span>'), F.lit(1)), 1, limit)
    d = pages.select("page_id", F.regexp_extract_all("html", F.lit(r'class="allstar(\d+)'), F.lit(1)).alias("r"), F.posexplode(said).alias("i", "x"))
    rating = F.floor(F.get("r", F.col("i")).try_cast("int") / 10).cast("int")
    d = d.select("page_id", "i", _plain(F.col("x")).alias("content"), rating.alias("rating")).where(F.length("content") >= 5)
    return d.withColumn("sentiment", F.when(F.col("rating") <= 2, "negative").when(F.col("rating").isNotNull(), "positive"))


def posts(pages: DataFrame, limit: int = 20) -> DataFrame:
    """HT-8: (page_id, i, content) of a page's first `limit` threads: title, and up to a hundred characters of the abstract
    of the same number; over five characters."""
    titles = F.slice(F.regexp_extract_all("html", F.lit(r'(?s)<a[^>]*class="j_th_tit"[^>]*title="([^"]*)"'), F.lit(1)), 1, limit)
    d = pages.select("page_id", F.regexp_extract_all("html", F.lit(r'(?s)<div class="threadlist_abs[^"]*">(.*?)</div>'), F.lit(1)).alias("a"), F.posexplode(titles).alias("i", "x"))
    more = F.left(_plain(F.coalesce(F.get("a", F.col("i")), F.lit(""))), F.lit(100))
    return d.select("page_id", "i", F.concat(T.strip(F.col("x")), F.when(more != "", F.concat(F.lit(" | "), more)).otherwise("")).alias("content")).where(F.length("content") > 5)


def rendered_books(pages: DataFrame, base: str, limit: int = 15) -> DataFrame:
    """HT-10: (page_id, i, title, url) of a rendered listing: links to numbered books that aren't an index."""
    d = links(pages).where((F.length("text") >= 2) & F.col("href").rlike(r"/tongren/\d+/") & ~F.col("href").rlike("index|tags|rating|search"))
    url = F.when(F.startswith("href", F.lit("/")), F.concat(F.lit(base), "href")).otherwise(F.col("href"))
    return _first_urls(d.select("page_id", "i", F.col("text").alias("title"), url.alias("url")), limit)


def rendered_chapters(pages: DataFrame, base: str, limit: int | None = None) -> DataFrame:
    """HT-10: (page_id, chapter_no, title, url) of a rendered book's page, each link once; a limit keeps the first in order
    of number."""
    d = links(pages).where((F.col("text") != "") & F.col("href").rlike(r"/tongren/\d+/\d+\.html"))
    d = d.withColumn("k", F.row_number().over(Window.partitionBy("page_id", "href").orderBy("i"))).where("k = 1")
    d = d.withColumn("chapter_no", F.regexp_extract("href", r"/(\d+)\.html", 1).try_cast("long"))
    if limit is not None:
        d = d.withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy("chapter_no", "i"))).where(F.col("k") <= limit)
    return d.select("page_id", "chapter_no", F.col("text").alias("title"), F.when(F.startswith("href", F.lit("/")), F.concat(F.lit(base), "href")).otherwise(F.col("href")).alias("url"))


def rendered_content(texts: DataFrame) -> DataFrame:
    """HT-10: texts(page_id, text) without lines' script remains and with single blank lines; null up to 200 characters."""
    t = F.col("text")
    for p in V.SCRIPT_REMAINS:
        t = F.regexp_replace(t, "(?d)" + p, "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return texts.select("page_id", F.when(F.length(t) > 200, T.strip(t)).alias("text"))
