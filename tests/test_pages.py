import time

import pyarrow as pa

from proselens.operators import pages

LIST = """<div class="listmain extra"><dl><dt><a href="/">首页</a></dt><dd> <a href ="2.html" >第二章 </a> </dd><dd><a href="/look/9/1.html">第一章</a></dd><dd><a href="2.html">again</a></dd><dd><a href="#">none</a></dd></dl></div>
<div class="listmain"><a href="7.html">outside</a></div>"""


def test_domain_and_rules(spark):
    urls = ["https://www.m.biquge.tv/x", "HTTP://WAP.BQGLLL.CC:80/", "http://m.23qb.com?x", "no url", None, "//xbiquge.la/"]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.domain, r.list_value) for r in pages.site_rules(d).collect()}
    assert got == {0: ("m.biquge.tv", None), 1: ("bqglll.cc:80", None), 2: ("23qb.com", "chapterList"), 3: ("", None), 4: ("", None), 5: ("xbiquge.la", "box_con")}


def test_chapter_lists(spark):
    d = spark.createDataFrame([(1, "https://www.bqglll.cc/look/9/", LIST), (2, "https://other/", LIST), (3, None, None)], "page_id long, url string, html string")
    got = [(r.page_id, r.chapter_no, r.title, r.url) for r in pages.chapter_list(d, "B").orderBy("page_id", "chapter_no").collect()]
    assert got == [(1, 1, "第一章", "B/look/9/1.html"), (1, 2, "第二章", "B/look/9/2.html"), (2, 1, "第一章", "B/look/9/1.html"), (2, 2, "第二章", "B2.html")]
    got = [(r.page_id, r.chapter_no, r.title, r.url) for r in pages.site_chapter_list(d).orderBy("chapter_no").collect()]
    assert got == [(1, 1, "第二章", "https://www.bqglll.cc/look/9/2.html"), (1, 2, "第一章", "https://www.bqglll.cc/look/9/1.html")]


def test_listings(spark):
    html = '<div class="block"><p><a href="/look/1/">甲书</a> <span>张</span></p><p><a href="/look/1/">甲书</a></p><p><a href="/look/2/">乙<b>书</b></a><span>李四</span></p></div><a href="/look/3/">丙书</a>'
    d = spark.createDataFrame([(1, "http://h/", html)], "page_id long, url string, html string")
    assert [(r.title, r.author, r.url, r["rank"]) for r in pages.ranking_books(d, "B", 2).orderBy("i").collect()] == [("甲书", "张", "B/look/1/", 21), ("乙书", "李四", "B/look/2/", 23)]
    assert [(r.title, r.author) for r in pages.home_books(d, "B").orderBy("i").collect()] == [("甲书", "张")]
    assert [(r.title, r.author) for r in pages.category_books(d, "B").orderBy("i").collect()] == [("甲书", "李四"), ("丙书", "")]
    assert [(r.title, r.url) for r in pages.other_home_books(d, 2).orderBy("i").collect()] == [("甲书", "http://h/look/1/"), ("乙书", "http://h/look/2/")]
    found = pages.other_home_books(d)
    want = lambda t, a: [r.title for r in pages.search_match(found, spark.createDataFrame([(1, t, a)], "page_id long, want_title string, want_author string")).collect()]
    assert want("书", "李") == ["乙书"] and want("书", None) == ["甲书"] and want("丙", "张") == ["丙书"] and want("丙", "x") == [] and want("甲", "王") == []


def test_discover_keeps_the_first_of_a_url(spark):
    one = spark.createDataFrame([(0, "a", "", "u1"), (1, "b", "", "u2")], "i int, title string, author string, url string")
    two = spark.createDataFrame([(0, "c", "", "u2"), (1, "d", "", "u3")], "i int, title string, author string, url string")
    assert [(r.title, r.url) for r in pages.discover([one, two], 3).collect()] == [("a", "u1"), ("b", "u2"), ("d", "u3")]
    books = spark.createDataFrame([(1, "active"), (2, "active")], "id int, status string")
    assert {(r.id, r.status) for r in pages.deprecated(books, spark.createDataFrame([(1,), (1,)], "book_id int")).collect()} == {(1, "active"), (2, "deprecated")}


def test_reviews_and_rendered_pages(spark):
    html = '<i class="allstar40 rating"></i><span class="short"> <b>很好</b>看的书\n</span><i class="allstar10"></i><span class="short">短</span><span class="short">没有评分的评论</span><a rel="x" class="j_th_tit" title=" 标题一 ">x</a><div class="threadlist_abs a"><b> 摘要 </b></div><a class="j_th_tit" title="短">'
    d = spark.createDataFrame([(1, "u", html), (2, "u", None)], "page_id long, url string, html string")
    assert [(r.content, r.rating, r.sentiment) for r in pages.comments(d).orderBy("i").collect()] == [("很好看的书", 4, "positive"), ("没有评分的评论", None, None)]
    assert [r.content for r in pages.posts(d).collect()] == ["标题一 | 摘要"]
    html = '<a href="/tongren/5/">书名</a><a href="/tongren/index/5/">目录页</a><a href="/tongren/5/12.html">章十二</a><a href="/tongren/5/3.html">章三</a><a href="/tongren/5/3.html">章三</a>'
    d = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    assert [r.title for r in pages.rendered_books(d, "B").orderBy("i").collect()] == ["书名", "章十二", "章三"]
    assert [(r.chapter_no, r.url) for r in pages.rendered_chapters(d, "B").orderBy("chapter_no").collect()] == [(3, "B/tongren/5/3.html"), (12, "B/tongren/5/12.html")]
    text = "正文" * 120 + "\nvar x = 1;\n\n\n\n结尾"
    d = spark.createDataFrame([(1, text), (2, "短"), (3, None)], "page_id long, text string")
    assert [r.text for r in pages.rendered_content(d).orderBy("page_id").collect()] == ["正文" * 120 + "\n\n结尾", None, None]


def test_links_in_one_pass_over_long_and_deep_pages():
    start = time.monotonic()
    flat = "".join(f'<a href="{i}.html">x{i}</a>' for i in range(30000))
    assert sum(1 for _ in pages.page_links(flat, "http://h/")) == 30000
    assert time.monotonic() - start < 30  # each link looked for a span among all others: minutes
    deep = "<b>" * 3000 + '<a href="x"><i>t</i></a><span>s</span>'
    assert [(x["text"], x["author"]) for x in pages.page_links(deep, None)] == [("t", "s")]
    assert [x["text"] for x in pages.page_links('<a href="x">' + "<b>" * 3000 + "t", None)] == ["t"]  # a tree's text was recursive


def test_links_come_in_bounded_batches():
    n = 3000
    html = '<div class="listmain"><a href="x.html">' + "t" * 1000 + "</a></div>"
    b = pa.RecordBatch.from_pydict({"page_id": list(range(n)), "url": ["http://h/"] * n, "html": [html] * n, "within": pa.array([None] * n, pa.string())})
    sizes = [x.num_rows for x in pages._link_batches([b])]
    assert sum(sizes) == n and max(sizes) < 1500


def test_site_chapter_list_is_whole(spark):
    html = '<div class="listmain">' + "".join(f'<a href="{i}.html">第{i}章</a>' for i in range(120)) + "</div>"
    d = spark.createDataFrame([(1, "https://www.bqglll.cc/look/9/", html)], "page_id long, url string, html string")
    assert [r.chapter_no for r in pages.site_chapter_list(d).orderBy("chapter_no").collect()] == list(range(1, 121))
    assert pages.site_chapter_list(d, 7).count() == 7


def test_rendered_chapters_are_whole(spark):
    html = "".join(f'<a href="/tongren/5/{i}.html">c{i}</a>' for i in range(90))
    d = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    assert sorted(r.chapter_no for r in pages.rendered_chapters(d, "B").collect()) == list(range(90))
    assert pages.rendered_chapters(d, "B", 7).count() == 7


def test_category_books_deal_out_no_arrays(spark):
    html = '<a href="/look/1/">甲书</a><a href="/look/2/">乙书</a><span>张三</span>'
    d = spark.createDataFrame([(1, "u", html), (2, "u", "<span>张三</span><span>李四</span>"), (3, "u", None)], "page_id long, url string, html string")
    b = pages.category_books(d, "B")
    assert [(r.page_id, r.i, r.title, r.author) for r in b.orderBy("i").collect()] == [(1, 0, "甲书", "张三"), (1, 1, "乙书", "")]
    generate = [x for x in b._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate" in x]
    assert generate and all("arrays_zip" in x for x in generate)
    kept = b._jdf.queryExecution().optimizedPlan().toString()
    assert "get(" not in kept  # a whole array beside each link
