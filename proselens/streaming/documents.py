"""Per-document measures on a stream of documents; an extension, since they need no state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def measure(spark: SparkSession, folder: str, schema: str, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Apply an operator to the documents that are new since the last call, and append its rows as Parquet."""
    rows = operator(spark.readStream.schema(schema).parquet(folder))
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
