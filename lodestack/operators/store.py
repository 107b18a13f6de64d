"""The pack store as tables: entries, tombstones, inspection, decode policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators.index import latest

#: Payloads above this size are not opened unasked.
DEFER_BYTES = 16 * 1024


def upsert(existing: DataFrame, arriving: DataFrame, key: list[str], order: str) -> DataFrame:
    """``existing`` with ``arriving`` rows in place of those with the same key; the latest of several wins."""
    columns = existing.columns
    fresh = latest(arriving.select(*columns), key, columns, order).select(*columns)
    return existing.join(fresh.select(*key), key, "left_anti").select(*columns).unionByName(fresh)


def without_deleted(entries: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Entries that no later tombstone of the same pack and path removes; packed again, a path is back."""
    last = tombstones.groupBy("pack_id", F.col("source_path").alias("source")).agg(F.max("deleted_at").alias("deleted_at"))
    joined = entries.join(last, ["pack_id", "source"], "left")
    return joined.where(F.col("deleted_at").isNull() | (F.col("deleted_at") < F.col("packed_at"))).drop("deleted_at")


def inspect(entries: DataFrame) -> DataFrame:
    """``(pack_id, entries, original_bytes, spec_bytes, ratio)``; unknown original sizes count as missing."""
    known = F.when(F.col("original_size") >= 0, F.col("original_size"))
    sizes = [F.count("*").alias("entries"), F.sum(known).alias("original_bytes"), F.sum("spec_size").alias("spec_bytes"), F.count(known).alias("sized")]
    both = F.sum(F.when(known.isNotNull(), F.col("spec_size")))
    return entries.groupBy("pack_id").agg(*sizes, F.round(both / F.sum(known), 4).alias("ratio"))


def decode_policy(entries: DataFrame, policy: str = "auto", limit: int = DEFER_BYTES) -> DataFrame:
    """``entries`` with ``opened``: none, all, or those up to ``limit`` bytes."""
    if policy not in ("none", "auto", "exact"):
        raise ValueError(f"unknown decode policy {policy!r}")
    opened = F.lit(policy == "exact") if policy != "auto" else F.coalesce(F.col("spec_size") <= limit, F.lit(False))
    return entries.withColumn("opened", opened)
