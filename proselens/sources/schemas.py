"""The tables of the story bible and of the corpus store: columns and natural keys, and folders of Parquet for them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: BB-11: the story bible. Arrays and maps are columns, not JSON.
BIBLE = {
    "characters": "id string, name string, role string, aliases array<string>, profile map<string,string>, speech_style struct<patterns:array<string>,vocab_level:string,tone:string,catchphrases:array<string>>, first_appear_ch int, last_appear_ch int, status string, created_at timestamp",
    "world_rules": "id string, category string, key string, content string, is_hard_rule boolean, first_mentioned_ch int, conflicts_with array<string>, created_at timestamp",
    "foreshadows": "id string, description string, planted_ch int, planted_scene string, resolved_ch int, resolved_scene string, status string, tags array<string>, importance string, created_at timestamp",
    "cooccurrence": "char_a string, char_b string, chapter int, distance int, count int",
}
#: DB-9: the corpus store.
CORPUS = {
    "books": "id bigint, title string, author string, source_url string, category string, added_at timestamp, last_analyzed_at timestamp, status string",
    "chapters": "id bigint, book_id bigint, chapter_no int, title string, file_path string, word_count int, fetched_at timestamp",
    "analyses": "id bigint, run_id string, book_id bigint, chapter_id bigint, tool_version string, module string, metrics string, started_at timestamp, finished_at timestamp",
    "reviews": "id bigint, book_id bigint, source string, content string, sentiment string, keywords string, fetched_at timestamp",
    "comparisons": "id bigint, run_id string, analysis_id bigint, review_id bigint, dimension string, matched boolean, confidence double, verdict string, gap_detail string, compared_at timestamp",
    "gaps": "id string, module string, gap_type string, description string, first_seen timestamp, last_seen timestamp, occurrence_count bigint, status string",
    "research": "id bigint, gap_id string, source string, findings string, recommendation string, researched_at timestamp",
    "fixes": "id bigint, gap_id string, pr_url string, branch string, files_changed string, diff_summary string, tool_version_before string, tool_version_after string, verified_at timestamp, improvement_metric string, status string",
}
TABLES = {**BIBLE, **CORPUS}


class Store:
    """SRC-7: a folder of Parquet tables of these shapes. A table that was never written is empty; a write appends
    (DB-5), and replace() rewrites a table beside the old one and then takes its place, since nothing is updated in it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(conf)

    def read(self, name: str) -> DataFrame:
        path, fs = self._path(name)
        if not fs.exists(path):
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(str(path))

    def append(self, name: str, rows: DataFrame) -> None:
        """Columns that rows lacks are null; others are cast to the table's types."""
        self._shaped(name, rows).write.mode("append").parquet(f"{self.folder}/{name}")

    def replace(self, name: str, rows: DataFrame) -> None:
        path, fs = self._path(name)
        new, old = self._path(f"{name}.new")[0], self._path(f"{name}.old")[0]
        self._shaped(name, rows).write.mode("overwrite").parquet(f"{self.folder}/{name}.new")
        fs.delete(old, True)
        if fs.exists(path):
            fs.rename(path, old)
        fs.rename(new, path)
        fs.delete(old, True)

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        kind = self.spark.createDataFrame([], TABLES[name]).schema
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind])


def as_dicts(rows: list[Row]) -> list[dict]:
    """BB-12: rows as plain dictionaries, nested ones too; strings that hold a JSON object or array are read."""

    def read(x):
        if isinstance(x, str) and x[:1] in ("{", "["):
            try:
                return json.loads(x)
            except ValueError:
                return x
        return x

    return [{k: read(v) for k, v in r.asDict(recursive=True).items()} for r in rows]
