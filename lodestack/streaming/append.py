"""Structured Streaming: incremental appends and running windows over Parquet sources.

Every micro-batch is pre-aggregated or reduced to its latest rows and written below the shared folder
under its batch id, so a batch that runs twice after a failure replaces its own output.  The state is
the table of these parts; reading it merges them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.index import latest
from lodestack.session import shared_dir


def _run(spark: SparkSession, path: str, reduce: Callable[[DataFrame], DataFrame], files_per_batch: int) -> DataFrame:
    """The parts that ``reduce`` leaves of every micro-batch of the source, after all data available now."""
    target = f"{shared_dir(spark)}/lodestack-stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema

    def write(batch: DataFrame, number: int) -> None:
        reduce(batch).write.mode("overwrite").parquet(f"{target}/parts/batch={number}")

    # a file stream watches a folder; of a single file, its folder and its name
    place = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():  # noqa: SLF001
        reader = reader.option("pathGlobFilter", place.getName())
        path = str(place.getParent().toString())
    source = reader.parquet(path)
    query = source.writeStream.option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.parquet(f"{target}/parts").drop("batch")


def windowed_counts(spark: SparkSession, path: str, minutes: int = 60, files_per_batch: int = 8) -> DataFrame:
    """``(window_start, event_type, events, value)`` of tumbling windows over ``events``, late rows included."""

    def reduce(batch: DataFrame) -> DataFrame:
        window = F.window("ts", f"{minutes} minutes").alias("w")
        return batch.where("ts is not null").groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v")).select(F.col("w.start").alias("window_start"), "event_type", "n", "v")

    parts = _run(spark, path, reduce, files_per_batch)
    return parts.groupBy("window_start", "event_type").agg(F.sum("n").alias("events"), F.round(F.sum("v"), 4).alias("value"))


def appended_entries(spark: SparkSession, path: str, key: list[str], columns: list[str], order: str, files_per_batch: int = 8) -> DataFrame:
    """The latest row of every key after all micro-batches; late and repeated deliveries change nothing else."""
    parts = _run(spark, path, lambda batch: latest(batch, key, [*columns, order], order), files_per_batch)
    return latest(parts, key, columns, order)
