"""Helpers that the corpus operators share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the word contract has it; Java's regex and bytes.split() agree on it.
SPACE = r"[\x20\x09-\x0D]+"
#: A key with more than total/HOT_SHARE rows is hot; so there are fewer than HOT_SHARE hot keys, at any size.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset, a new local one if Spark runs in one process,
    as in tests, and an error otherwise, since executors don't share local folders."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="proselens-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def parts_for(total: int, each: int) -> int:
    """How many parts of about `each` units hold `total`; grows with the input and is never zero."""
    return max(1, math.ceil((total or 0) / each))


def others(docs: DataFrame, *names: str) -> list[str]:
    """The columns of docs that are named like none of names, whatever the case of letters."""
    taken = {n.lower() for n in names}
    return [c for c in docs.columns if c.lower() not in taken]


def free_name(name: str, docs: DataFrame) -> str:
    """A column name that docs doesn't have in any case of letters: name, with underscores before it as needed."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = "_" + name
    return name


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0


def join_hot(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join on `key`, of which `right` has one row each with its number of rows of `left` in `count`.

    Keys with over total/HOT_SHARE rows are fewer than HOT_SHARE whatever the data, so they are broadcast
    and their left rows stay where they are; all other keys are too small to skew a shuffled join.
    """
    hot_rule = F.col(count) * HOT_SHARE > F.lit(total)
    right_rows = right.select(key, *[c for c in right.columns if c not in (key, count)], count)
    hot = right_rows.where(hot_rule)
    cold = right_rows.where(~hot_rule)
    in_hot = left.join(F.broadcast(hot), key)
    in_cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return in_hot.unionByName(in_cold)
