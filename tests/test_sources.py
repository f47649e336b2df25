import json

from proselens.operators import stats
from proselens.sources import tables
from proselens.streaming.documents import measure


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_chapter_files(spark, tmp_path):
    write(tmp_path / "正文" / "第10章_a b.md", "十")
    write(tmp_path / "正文" / "卷一" / "第2章.md", "二\n二")
    write(tmp_path / "正文" / "context-brief.md", "x")
    write(tmp_path / "notes" / "chapter9.md", "九")
    write(tmp_path / "正文" / "第3章.md", b"\xff\xfe")
    got = [(r.chapter_no, r.text, r.error) for r in tables.chapter_files(spark, str(tmp_path)).orderBy("chapter_no").collect()]
    assert got == [(2, "二\n二", None), (3, None, "not UTF-8"), (10, "十", None)]
    assert [r.text for r in tables.chapter_files(spark, str(tmp_path / "notes")).collect()] == ["九"]


def test_project(spark, tmp_path):
    brief = "---\ntitle: '书名'\n---\n# 标题\n\n| 项 | 值 |\n|---|---|\n| 类型 | 玄幻 |\n\n2024-05-06 更新，待处理：3 个\n"
    write(tmp_path / "context-brief.md", brief)
    (tmp_path / "a" / "b").mkdir(parents=True)
    r = tables.find_project(spark, str(tmp_path / "a" / "b")).first()
    assert (r.title, r.date, r.pending) == ("书名", "2024-05-06", 3) and [(x.key, x.value) for x in r.fields] == [("项", "值"), ("类型", "玄幻")]
    assert tables.find_project(spark, str(tmp_path / "a"), "none.md") is None


def test_lexicon_and_rules(spark, tmp_path):
    write(tmp_path / "l.json", json.dumps({"words": [{"word": "甲"}, {"word": "乙", "category": "c", "severity": "ban", "max_per_chapter": 2}]}))
    assert {tuple(r) for r in tables.lexicon(spark, str(tmp_path / "l.json")).collect()} == {("甲", "filler", "warn", 0), ("乙", "c", "ban", 2)}
    assert tables.lexicon(spark, str(tmp_path / "none.json")).count() == 0
    write(tmp_path / "bad.json", "{not json")
    assert tables.lexicon(spark, str(tmp_path / "bad.json")).count() == 0
    write(tmp_path / "r.json", json.dumps({"_meta": {"a": 1}, "cliche": [{"pattern": "p", "severity": "ban"}], "adverb_abuse": [{"pattern": "q", "max_per_1k": 3}]}))
    assert {tuple(r) for r in tables.rule_sheet(spark, str(tmp_path / "r.json")).collect()} == {("cliche", "p", "ban", None, None), ("adverb_abuse", "q", "warn", None, 3.0)}
    assert tables.rule_sheet(spark, str(tmp_path / "none.json")).count() == 0


def test_outlines(spark, tmp_path):
    for name in ("章纲_第1章.md", "故事大纲.md"):
        write(tmp_path / name, "# " + name)
    assert [(r.outline_id, r.text) for r in tables.outline_files(spark, str(tmp_path)).collect()] == [("章纲_第1章", "# 章纲_第1章.md")]


def test_sinks(spark, tmp_path):
    m = spark.createDataFrame([(1, "b", 2, 3.5), (2, "b", 3, None)], "doc_id long, book string, chapter_no int, x double")
    tables.save_analysis(m, str(tmp_path / "log"), "r1", "stats")
    tables.save_analysis(m, str(tmp_path / "log"), "r2", "stats")
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 4 and {json.loads(r.metrics).get("x") for r in log.collect()} == {3.5, None} and log.where("chapter_no = 3 and finished_at is not null").count() == 2
    assert [json.loads(r.value) for r in tables.as_json(m).collect()][1] == {"doc_id": 2, "book": "b", "chapter_no": 3, "x": None}
    tables.write_chapters(spark.createDataFrame([(7, 2, "第二\n章"), (7, 1234, "x")], "book_id int, chapter_no int, text string"), str(tmp_path / "books"))
    assert sorted(p.read_text() for p in (tmp_path / "books").glob("book_id=7/chapter=ch*/*.txt")) == ["x\n", "第二\n章\n"]
    assert {p.name for p in (tmp_path / "books" / "book_id=7").iterdir()} == {"chapter=ch002", "chapter=ch1234"}


def test_stream(spark, tmp_path):
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for i, t in enumerate(["天地。玄黄。", "日月"]):
        spark.createDataFrame([(i, t)], "doc_id long, text string").write.mode("append").parquet(folder)
        measure(spark, folder, "doc_id long, text string", stats.count_chapter, out, check)
        assert spark.read.parquet(out).count() == i + 1
    assert {(r.doc_id, r.chinese_chars) for r in spark.read.parquet(out).collect()} == {(0, 4), (1, 2)}
