import time

import pytest

from proselens.operators import consistency, emotion, outline, reviews, style

OUTLINE = """---
level: volume
---
# 第1章 起风

## 叙事目标
主角离开家乡

## 情绪基调
平静

## 检查点
- 主角收到来信
1. 雨夜出门
不是检查点

## 涉及角色
- 林远（主角）
- 苏晴: 同学
"""


def frame(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_time_marks(spark):
    d = frame(spark, "清晨，3天后他来了，当天下雨。12时", "", None, "当天当天")
    got = [(r.doc_id, r.position, r.tag, r.value) for r in consistency.time_marks(d).orderBy("doc_id", "position").collect()]
    assert got == [(0, 0, "early_morning", None), (0, 3, "days_later", 3), (0, 10, "same_day", None), (0, 15, "hour", 12), (3, 0, "same_day", None), (3, 2, "same_day", None)]
    assert [(r.doc_id, r.position, r.before) for r in consistency.time_issues(d).collect()] == [(0, 10, "days_later")]


def test_time_between_chapters(spark):
    rows = [(1, "a", 1, "光阴似箭"), (2, "a", 2, "清晨"), (3, "a", 3, "次日"), (4, "b", 1, "3天后，黄昏，黄昏，黄昏"), (5, "b", 2, "当天"), (6, "c", 1, None)]
    d = spark.createDataFrame(rows, "doc_id long, book string, chapter_no int, text string")
    assert [r.doc_id for r in consistency.time_between_chapters(d).collect()] == [2]


def test_names(spark):
    d = frame(spark, "王小明来了王小明走了。李雷，李雷。", "王。王。王。", None)
    got = {(r.doc_id, r.name, r.n, r.known) for r in consistency.names(d, ["王小明"]).collect()}
    assert got == {(0, "王小明", 2, True)}
    assert [(r.doc_id, r.surname, r.n) for r in consistency.surnames(d).collect()] == [(1, "王", 3)]


def test_pronouns(spark):
    d = frame(spark, "他说，她说，他想：她笑。他走了，小红，小明。\n\n短。", "他他他他他", None)
    assert [(r.doc_id, r.paragraph, r.pronouns) for r in consistency.pronouns(d).collect()] == [(0, 0, 5)]


def test_conflicts(spark):
    rule = spark.createDataFrame([(7, "天空，大地，河流，山川"), (8, "天空"), (9, None)], "rule_id long, content string")
    d = frame(spark, "天空，大地，河流，山川，没有，天空", "天空，大地，河流，山川", None)
    assert [tuple(r) for r in consistency.conflicts(d, rule).collect()] == [(0, 7, 4)]


def test_rhythm(spark):
    text = "---\nx: 1\n---\n" + "狂喜" + "一" * 98 + "雀跃" + "二" * 18
    got = {r.i: r.intensity for r in emotion.rhythm(frame(spark, text, "短", None)).where("doc_id = 0").collect()}
    assert len(got) == 40 and got[0] == 3.0 and got[1] == 0.0 and emotion.rhythm(frame(spark, "短", None)).count() == 0


def test_quick_scan(spark):
    d = frame(spark, "他们走得很远了。他们回到家里了。他们再次出发了！", "", None)
    got = {r.type: r.amount for r in style.quick_scan(d).where("doc_id = 0").collect()}
    assert got["repetition"] == 2 and set(got) == {"repetition", "filler"}


def test_repetition(spark):
    got = {(r.kind, r.phrase, r.n) for r in style.repetition(frame(spark, "他们走了啊。他们来了啊。他们又走了。", "", None)).collect()}
    assert got == {("sentence_2", "他们", 3)}


def test_outline(spark):
    o = spark.createDataFrame([(1, OUTLINE), (2, "- 没有标题的一条线索\n- 短"), (3, None)], "outline_id long, text string")
    a, b, c = outline.parse(o).orderBy("outline_id").collect()
    assert (a.title, a.level, a.goal, a.emotion) == ("第1章 起风", "volume", "主角离开家乡", "平静")
    assert a.checkpoints == ["主角收到来信", "雨夜出门"] and a.characters == ["林远", "苏晴"] and len(a.sections) == 4
    assert (b.title, b.checkpoints, c.title) == ("2", [], "3")
    points = outline.checkpoints(o)
    assert points.where("outline_id = 2").first().points == ["没有标题的一条线索"]
    ch = spark.createDataFrame([(5, 1, "雨夜出门的时候，天很黑。\n\n" + "山" * 60 + "。尾")], "doc_id long, outline_id long, text string")
    r = outline.compare(ch, points).first()
    assert (r.total, r.covered, r.missed, r.match_percentage, r.extra) == (2, 1, 1, 50.0, ["山" * 50])
    s = spark.createDataFrame([(5, 1, "雨夜出门，他没有带伞也没有回头。")], "doc_id long, outline_id long, text string")
    assert tuple(outline.summarize(s, points).first()) == (5, 1, 2, 1)


def test_reviews(spark):
    r = spark.createDataFrame([(1, "节奏好，但是有些老套"), (2, "一点都不拖"), (3, "时间混乱"), (4, ""), (5, None)], "id long, text string")
    got = {(x.id, x.dimension, x.sentiment) for x in reviews.dimensions(r).collect()}
    assert got == {(1, "pacing", "positive"), (1, "template_score", "negative"), (2, "pacing", "positive"), (3, "timeline", "negative"), (3, "readability", "negative")}


@pytest.mark.parametrize(
    "page, text",
    [
        ("<body><nav>a</nav><div id=content> b <br>c<div>d&amp;</div><script>x</script></div><p>e</p></body>", "b\nc\nd&"),
        ("<html><head><title>t</title></head><body>x<p>y</p></body></html>", "x\ny"),
        ("只有文字", "只有文字"),
        ("", ""),
        (None, ""),
        ("<div id=txt>正文<p>一秒记住某站：某地。</p>完</div>", "正文\n完"),
    ],
)
def test_pages(page, text):
    assert reviews.chapter_of(page) == text


def test_titles(spark):
    d = spark.createDataFrame([(1, "某书全文免费阅读（完结）"), (2, None)], "id long, title string")
    assert [r.title for r in reviews.clean_titles(d).orderBy("id").collect()] == ["某书", None]


def test_outlines_of_many_points_in_seconds(spark):
    words = ["".join(chr(0x4E00 + (i * 7919 + k * 104729) % 20000) for k in range(2 + i % 4)) for i in range(6000)]
    points = spark.createDataFrame([(k, ["，".join(words[i : i + 30]) for i in range(0, 6000, 30)]) for k in (1, 2)] + [(3, [])], "outline_id long, points array<string>")
    texts = [(i, i % 4, "、".join(words[i : i + 3000])) for i in range(400)] + [(900, 1, None)]
    d = spark.createDataFrame(texts, "doc_id long, outline_id long, text string")
    start = time.monotonic()
    got = {r.doc_id: (r.total, r.covered, r.missed, r.extra) for r in outline.compare(d, points).collect()}
    assert time.monotonic() - start < 20 and len(got) == 201  # every chunk of every point was looked for in every text
    there = [sum(w in texts[1][2] for w in words[i : i + 30]) for i in range(0, 6000, 30)]
    assert got[1][:2] == (200, sum(n >= 12 for n in there)) and sum(got[1][1:3]) == 200 and got[900] == (200, 0, 200, None)
    start = time.monotonic()
    got = {r.doc_id: (r.points, r.covered) for r in outline.summarize(d, points).collect()}
    assert time.monotonic() - start < 20 and len(got) == 301 and got[3] == (0, 0) and got[900] == (200, 0)


def test_outline_reads_whole_paragraphs(spark):
    points = spark.createDataFrame([(1, ["雨夜出门"])], "outline_id long, points array<string>")
    text = "\n\n".join(["山，" * 60 + "雨夜出门"] + [chr(0x4E00 + i) * 60 for i in range(12)])
    r = outline.compare(spark.createDataFrame([(5, 1, text)], "doc_id long, outline_id long, text string"), points).first()
    assert (r.covered, r.extra) == (1, [chr(0x4E00 + i) * 50 for i in range(12)])


def test_marks_are_made_once_a_text(spark):
    rows = [(1, "a", 1, "3天后"), (2, "a", 2, "清晨"), (3, "a", 2, "次日"), (4, None, 3, "当天"), (5, "a", 3, None)]
    d = spark.createDataFrame(rows, "doc_id long, book string, chapter_no int, text string")
    c = consistency.time_between_chapters(d)
    assert sorted(tuple(r) for r in c.collect()) == [("a", 2, 2), ("a", 2, 3)]
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("光阴似箭") <= 4  # one look, one split and one extraction of each pattern; the filters had copied them
    assert consistency._literals(r"(\d+)个?时辰后") == ["时辰后"] and consistency._literals("a|b") == []
