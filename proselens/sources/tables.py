"""Sources and sinks: chapter folders, project briefs, lexicons, rule sheets, analysis logs, and the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Latin letters and punctuation as the Chinese characters that stand for them, so that the operators meet
# words of their lexicons in Latin text. Both sides of a comparison use these two constants.
LATIN = "abcdefghijklmnopqrstuvwxyz.,!?"
CHINESE = "宁「“思平乎红安沉后她和他静危似天机首不险」走次王”。，！？"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chinese(text, paragraphs: bool = True):
    t = F.replace(text, F.lit("\n"), F.lit("\n\n")) if paragraphs else text
    return F.translate(F.lower(t), LATIN, CHINESE)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chapters in Chinese characters: (doc_id, book, text). One file is one split; deal it out."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("book"), chinese(F.col("text")).alias("text"))
    return d.repartition("doc_id")


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As documents(), but put into Chinese characters by the tasks that the rows are dealt to, from a third of the bytes: for
    operators that read a text once, in Arrow batches. An expression over text would be put together with the translation."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("book"), "text").repartition("doc_id")
    return d.withColumn("text", chinese(F.col("text")))


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, chapter_no, text) with chapters numbered by doc_id."""
    d = table(spark, sf_dir, "documents")
    no = d.select("doc_id", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("chapter_no"))
    return documents(spark, sf_dir).join(no, "doc_id")


def chapter_files(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-1, SRC-2: (path, chapter_no, text, error) of the Markdown chapters below a folder, each file once.

    Files below 正文 or directly in chapters count; if there are none, those whose path names 正文 or chapter. Order is a
    matter of chapter_no (the number in the file's name), then path. A file that isn't UTF-8 has an error and no text.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder).select("path", "content")
    f = f.withColumn("path", F.url_decode(F.regexp_replace("path", r"\+", "%2B"))).where(~F.col("path").rlike(r"(context-brief\.md|\.gitkeep)$"))
    f = f.withColumn("inner", F.col("path").rlike("/正文/.*[.]md$") | F.col("path").rlike("/chapters/[^/]*[.]md$"))
    some = not f.where("inner").isEmpty()
    f = f.where("inner") if some else f.where(F.col("path").rlike("正文|chapter"))
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(valid, F.col("content").cast("string"))
    return f.select("path", F.regexp_extract("path", r"(\d+)[^/]*$", 1).try_cast("int").alias("chapter_no"), text.alias("text"), F.when(~valid, "not UTF-8").alias("error"))


def outline_files(spark: SparkSession, folder: str) -> DataFrame:
    """OL-2: (outline_id: the file's name, path, text) of the outlines in a folder, but for the story's own (故事大纲)."""
    t = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select("value", F.url_decode("_metadata.file_path").alias("path"))
    return t.where(~F.col("path").endswith("故事大纲.md")).select(F.regexp_extract("path", r"([^/]*)\.md$", 1).alias("outline_id"), "path", F.col("value").alias("text"))


def project(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3: (title, date, fields, pending) of a brief: the title of the front matter, else of the first header; the first
    date; the key/value rows of its pipe tables but for their rules; and how many issues it says are pending."""
    t = spark.read.text(path, wholetext=True)
    front = F.regexp_extract("value", r"(?s)\A---\s*\n(.*?)\n---", 1)
    named = F.regexp_extract(front, r"(?m)^title:\s*[\"']?(.*?)[\"']?\s*$", 1)
    rows = F.regexp_extract_all("value", F.lit(r"(?m)^\|\s*([^|\n]+?)\s*\|\s*([^|\n]+?)\s*\|"), F.lit(0))
    pairs = F.transform(rows, lambda r: F.struct(F.trim(F.split(r, r"\|")[1]).alias("key"), F.trim(F.split(r, r"\|")[2]).alias("value")))
    pairs = F.filter(pairs, lambda p: ~p["key"].rlike("^:?-+:?$"))
    pending = F.regexp_extract("value", r"待[^\n\d]{0,10}(\d+)", 1).try_cast("int")
    return t.select(F.when(named != "", named).otherwise(F.regexp_extract("value", r"(?m)^#\s+(.+)", 1)).alias("title"), F.regexp_extract("value", r"\d{4}-\d{2}-\d{2}", 0).alias("date"), pairs.alias("fields"), pending.alias("pending"))


def find_project(spark: SparkSession, folder: str, name: str = "context-brief.md") -> DataFrame | None:
    """SRC-3: the brief of a folder, or of the nearest folder above that has one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(conf)
    while at is not None:
        brief = jvm.org.apache.hadoop.fs.Path(at, name)
        if fs.exists(brief):
            return project(spark, str(brief))
        at = at.getParent()
    return None


def _json(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A JSON document under a schema; no rows if the file is missing or holds something else."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(conf).exists(at):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).option("multiLine", "true").json(path)


def rule_sheet(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: (check, pattern, severity, suggestion, max_per_1k) of a JSON sheet {check: [rules]}; none if it is missing."""
    rule = "array<struct<pattern:string,severity:string,suggestion:string,max_per_1k:double>>"
    checks = ["redundancy", "cliche", "weasel", "adverb_abuse", "dialogue_tags"]
    d = _json(spark, path, ", ".join(f"{c} {rule}" for c in checks))

    def of(check: str):
        rules = F.coalesce(F.col(check), F.array().cast(rule))
        return F.transform(rules, lambda r: F.struct(F.lit(check).alias("check"), r["pattern"].alias("pattern"), F.coalesce(r["severity"], F.lit("warn")).alias("severity"), r["suggestion"].alias("suggestion"), r["max_per_1k"].alias("max_per_1k")))

    return d.select(F.inline(F.flatten(F.array(*map(of, checks)))))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4: (word, category, severity, max_per_chapter) of a JSON lexicon with a list `words`, with defaults; no rows if the
    file is missing or invalid."""
    kind = "words array<struct<word:string,category:string,severity:string,max_per_chapter:int>>"
    w = _json(spark, path, kind).select(F.explode("words").alias("w")).select("w.*")
    return w.select("word", F.coalesce("category", F.lit("filler")).alias("category"), F.coalesce("severity", F.lit("warn")).alias("severity"), F.coalesce("max_per_chapter", F.lit(0)).alias("max_per_chapter"))


def save_analysis(metrics: DataFrame, path: str, run_id: str, module: str, tool_version: str = "1") -> None:
    """SNK-2: append one row a document to the analyses log, by run: metrics(doc_id, and book and chapter_no if it has them)
    with the rest as JSON, the version and the time."""
    own = ["doc_id", *[c for c in ("book", "chapter_no") if c in metrics.columns]]
    rest = F.to_json(F.struct(*[c for c in metrics.columns if c not in own]))
    out = metrics.select(F.lit(run_id).alias("run_id"), F.lit(module).alias("module"), F.lit(tool_version).alias("tool_version"), *own, rest.alias("metrics"), F.current_timestamp().alias("finished_at"))
    out.write.mode("append").partitionBy("run_id").parquet(path)


def as_json(rows: DataFrame) -> DataFrame:
    """SNK-1: a JSON object a row, in a column value, nulls included, as a command prints it or write.text stores it."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_chapters(chapters: DataFrame, path: str) -> None:
    """SNK-3: chapters(book_id, chapter_no, text) as Markdown, a folder for each book and chapter: one file each, whose
    bytes are the text's. The columns that name the folders give the number and the book back."""
    name = F.concat(F.lit("ch"), F.lpad(F.col("chapter_no").cast("string"), F.greatest(F.length(F.col("chapter_no").cast("string")), F.lit(3)), F.lit("0")))
    c = chapters.select("book_id", name.alias("chapter"), "text").repartition("book_id", "chapter")
    c.write.mode("append").partitionBy("book_id", "chapter").option("lineSep", "\n").text(path)
