"""Relevance evaluation: judgements, metrics, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.session import materialize


def resolve_judgements(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """``(query_id, expected_path, doc_id)``: each expected path with its document, the smallest id of several, or null."""
    wanted = queries.select("query_id", F.explode("expected_paths").alias("expected_path")).distinct()
    found = docs.where("path is not null").groupBy(F.col("path").alias("expected_path")).agg(F.min("doc_id").alias("doc_id"))
    return wanted.join(found, "expected_path", "left").select("query_id", "expected_path", "doc_id")


def first_hits(ranked: DataFrame, judgements: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, query_type, first)``: the rank of the first relevant result, 0 if there is none."""
    hits = ranked.join(judgements.where("doc_id is not null").select("query_id", "doc_id").distinct(), ["query_id", "doc_id"])
    best = hits.groupBy("query_id").agg(F.min("rank").alias("first"))
    return queries.select("query_id", "query_type").join(best, "query_id", "left").fillna(0, ["first"])


def metrics(first: DataFrame, k: int = 5, by: str | None = None) -> DataFrame:
    """Hit@1, MRR and Recall@k (a success rate), rounded to 4 digits; with ``by`` also a total row, by rollup."""
    found = (F.col("first") > 0) & (F.col("first") <= k)
    values = [
        F.count("*").alias("queries"),
        F.round(F.avg((F.col("first") == 1).cast("double")), 4).alias("hit_at_1"),
        F.round(F.avg(F.when(found, 1.0 / F.col("first")).otherwise(0.0)), 4).alias("mrr"),
        F.round(F.avg(found.cast("double")), 4).alias("recall_at_k"),
    ]
    if by is None:
        return first.agg(*values)
    named = first.withColumn("kind", F.coalesce(by, F.lit("unlabelled")))
    return named.rollup("kind").agg(*values).withColumn("kind", F.coalesce("kind", F.lit("(all)")))


def running_metrics(first: DataFrame, prefix: int = 7) -> DataFrame:
    """``(query_id, seen, hits, mrr_sum)`` after each query in order of its id.

    Running totals come in steps: within ranges of ids that share ``prefix`` characters, over these ranges
    within those of one character less, and so on up to the first character, so no window holds all queries
    nor all ranges: at most as many as there are characters.
    """
    gain = F.when(F.col("first") > 0, 1.0 / F.col("first")).otherwise(0.0)
    names = ("n", "h", "g")
    parts = materialize(first.select("query_id", F.lit(1).cast("long").alias("n"), (F.col("first") > 0).cast("long").alias("h"), gain.alias("g")), "gains")
    cut = lambda i: F.substring("query_id", 1, i)
    inside = Window.partitionBy(cut(prefix)).orderBy("query_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.select("query_id", *[F.sum(c).over(inside).alias(c) for c in names])
    for i in range(prefix, 0, -1):
        sums = parts.groupBy(cut(i).alias("bucket")).agg(*[F.sum(c).alias(c) for c in names])
        before = Window.partitionBy(F.substring("bucket", 1, i - 1)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.select(F.col("bucket").alias(f"b{i}"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"o{c}") for c in names])
        joined = rows.withColumn(f"b{i}", cut(i)).join(offsets, f"b{i}")
        rows = joined.select("query_id", *[(F.col(c) + F.col(f"o{c}")).alias(c) for c in names])
    return rows.select("query_id", F.col("n").alias("seen"), F.col("h").alias("hits"), F.round("g", 6).alias("mrr_sum"))


def nearest_rank(df: DataFrame, value: str, percent: float, by: list[str]) -> DataFrame:
    """The nearest-rank percentile of ``value`` per group: the value at place ceil(p/100 n).

    Counts per distinct value come first, so a group's window holds distinct values only.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*by).orderBy(value)
    whole = Window.partitionBy(*by)
    placed = counts.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(whole))
    return placed.where(F.col("upto") >= F.ceil(F.col("n") * percent / 100)).groupBy(*by).agg(F.min(value).alias("value"), F.first("n").alias("n"))
