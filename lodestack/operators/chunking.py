"""Cutting texts into overlapping pieces and putting chunk scores together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed_chunks(docs: DataFrame, body: Column, size: int = 1800, overlap: int = 180) -> DataFrame:
    """``docs`` with ``chunk_index`` and ``chunk``: pieces of ``size`` code points, each starting ``size - overlap`` after the one before.

    A text of up to ``size`` is one chunk, the last chunk ends with the text; ``size <= 0`` keeps texts whole.
    """
    step = max(1, size - overlap)
    rows = docs.withColumn("_body", F.coalesce(body, F.lit("")))
    if size <= 0:
        return rows.withColumn("chunk_index", F.lit(0)).withColumnRenamed("_body", "chunk")
    last = F.ceil(F.greatest(F.lit(0), F.length("_body") - size) / step).cast("int")
    rows = rows.select("*", F.posexplode(F.sequence(F.lit(0), last * step, F.lit(step))).alias("chunk_index", "_start"))
    return rows.withColumn("chunk", F.substring(F.col("_body"), F.col("_start") + 1, F.lit(size))).drop("_body", "_start")


def token_windows(docs: DataFrame, terms: Column, size: int = 180, stride: int = 80) -> DataFrame:
    """``docs`` with ``window_index`` and ``window ARRAY<STRING>``: ``size`` terms every ``stride`` terms."""
    rows = docs.withColumn("_terms", terms)
    last = F.ceil(F.greatest(F.lit(0), F.size("_terms") - size) / stride).cast("int")
    rows = rows.select("*", F.posexplode(F.sequence(F.lit(0), last * stride, F.lit(stride))).alias("window_index", "_start"))
    return rows.withColumn("window", F.slice(F.col("_terms"), F.col("_start") + 1, F.lit(size))).drop("_terms", "_start")


def max_pool(scores: DataFrame, owner: str, score: str = "score", key: str = "query_id") -> DataFrame:
    """The best chunk score of every owner."""
    return scores.groupBy(key, owner).agg(F.max(score).alias(score))
