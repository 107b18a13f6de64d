"""Readers and writers: folders of source files, JSON lines, query files, Parquet index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.text import ENDINGS, language_of

EXCLUDED = ("node_modules", "__pycache__", "dist", "build", "vendor")


def source_files(spark: SparkSession, root: str, include_all: bool = False, max_bytes: int | None = None) -> DataFrame:
    """``(path, content BINARY, bytes, reason)`` of all files below ``root``; ``reason`` is null for kept ones.

    Files are left out for an unknown ending, their size, or an excluded folder, in this order; hidden
    version-control folders and pack files are never listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    rows = files.select(path.alias("path"), "content", F.col("length").alias("bytes")).where(~path.rlike(r"/\.git/|\.ldst$"))
    reason = (
        F.when(language_of(F.col("path")).isNull() & F.lit(not include_all), "unsupported_ext")
        .when(F.lit(max_bytes is not None) & (F.col("bytes") > F.lit(max_bytes or 0)), "too_large")
        .when(F.col("path").rlike(f"/({'|'.join(EXCLUDED)})/"), "excluded_dir")
    )
    return rows.withColumn("reason", reason)


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(title, text)`` of JSON lines with ``text`` or ``content`` and ``title`` or ``path``; blank texts are dropped."""
    rows = spark.read.json(path)
    text = F.coalesce(*[F.col(c) for c in ("text", "content") if c in rows.columns], F.lit(None).cast("string"))
    title = F.coalesce(*[F.col(c) for c in ("title", "path") if c in rows.columns], F.lit(""))
    return rows.select(title.alias("title"), text.alias("text")).where(F.trim("text") != "")


def query_file(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of labelled queries as ``(id, query_type, query, expected_paths)``."""
    schema = "id string, query_type string, query string, expected_paths array<string>"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_table(df: DataFrame, path: str, sort: str | None = None, partitions: int | None = None) -> None:
    """A Parquet table; sorted by ``sort`` within range partitions, so its statistics prune lookups."""
    if sort:
        df = (df.repartitionByRange(partitions, sort) if partitions else df.repartitionByRange(sort)).sortWithinPartitions(sort)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


SUPPORTED = tuple(ENDINGS)
