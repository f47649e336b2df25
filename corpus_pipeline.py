"""A cleaning pipeline over documents: STAGES in order, each written as Parquet and read again by run()."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.llm import decontamination, quality, sentencepiece_codec, simhash, substring_dedup
from proselens.llm.common import checkpoint, drop_path, free_name, scratch, table

#: 256-bit fingerprints of five-word shingles find candidates; similarity 0.8 of the sets of shingles decides.
#: Pairs of similarity 0.8 differ in 39 bits with a deviation of 6, so that the radius leaves out about one in 10,000.
NEAR = {"shingle": 5, "bits": 256, "radius": 60, "similarity": 0.8}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the lines that fail the rules leave the others' texts."""
    kept = quality.judge(docs).where("kept")
    return kept.withColumns({"text": F.col("cleaned"), "n_chars": F.char_length("cleaned").cast(dict(docs.dtypes)["n_chars"])}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: the one with the smallest id, a null id being larger than all. Rows are
    told apart by id and text, so that a row that shares its id with a copy stays; of rows equal in both one stays."""
    mark = free_name("mark", docs)
    groups = simhash.similar_groups(docs, **NEAR)
    same = lambda some: F.col(id_).eqNullSafe(some["doc_id"]) & (F.col(mark) == some["m"])
    id_ = free_name("id", docs)
    rows = docs.withColumns({mark: F.xxhash64("text"), id_: F.col("doc_id").cast("long")})
    gone = groups.where("not first").select("doc_id", F.col("mark").alias("m")).distinct()
    rows = rows.join(gone, same(gone), "left_anti")
    twice = checkpoint(groups.where("first").groupBy("doc_id", F.col("mark").alias("m")).count().where("count > 1").drop("count"))
    if twice.isEmpty():
        return rows.select(*docs.columns)
    one = rows.join(twice, same(twice), "left_semi").groupBy(id_, mark).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return rows.join(twice, same(twice), "left_anti").select(*docs.columns).unionByName(one)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in one document only; texts that lose nothing stay as they are."""
    out = substring_dedup.dedup(docs)
    text = F.when(F.col("n_removed") > 0, F.decode("kept", "UTF-8")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    hits = decontamination.mark(docs, table(spark, sf_dir, "benchmark"))
    return hits.where(F.size(decontamination.HITS) == 0).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document that is left."""
    return sentencepiece_codec.encode(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens", "ids")


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_duplicates), ("substring dedup", repeated_passages), ("benchmark decontamination", benchmark_passages), ("SentencePiece encoding", encode)]

#: The near-duplicate stage and the encoder can't be written in SQL. Tests hold each operator against brute force, the
#: near-duplicate stage too, and the stages together against what a small corpus must leave.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage has written goes when the next one has been; the last stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
