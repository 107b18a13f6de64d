"""Registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import corpus_queries, encoding_repair, handwritten, packing, shared_spans
from lodestack.llm.mixing import Mixture
from lodestack.llm.secrets import SecretScan
from lodestack.session import load, materialize


def secret_scan(spark: SparkSession, sf_dir: str) -> SecretScan:
    docs = load(spark, sf_dir, "bench_docs").select(F.lit("bench_docs").alias("origin"), F.col("id").alias("row_id"), F.col("collection").alias("owner"), "text", F.col("harvested_at").alias("at"))
    entries = load(spark, sf_dir, "pack_entries").select(F.lit("pack_entries").alias("origin"), F.col("entry_id").alias("row_id"), F.col("pack_id").cast("string").alias("owner"), F.col("source").alias("text"), F.col("received_at").alias("at"))
    return SecretScan(docs.union(entries), path_origins=("pack_entries",))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(spark, sf_dir).occurrences()


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(spark, sf_dir).redacted()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.file_reasons(load(spark, sf_dir, "code_chunks")).where(F.size("reasons") > 0).select("page_index")


def p2_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.file_reasons(load(spark, sf_dir, "code_chunks"))


def p2_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each file shows, by measure, mark or folder."""
    return handwritten.file_signals(load(spark, sf_dir, "code_chunks"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_repair.restored_digests(encoding_repair.garbled_records(load(spark, sf_dir, "bench_docs"), "id", "text", "harvested_at"))


def p5_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_repair.garbled_records(load(spark, sf_dir, "bench_docs"), "id", "text", "harvested_at")


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), load(spark, sf_dir, "container_plans"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = load(spark, sf_dir, "container_plans")
    return packing.fill_report(materialize(packing.pack(load(spark, sf_dir, "documents"), plans), "packed"), plans)


def mixture(spark: SparkSession, sf_dir: str, budget_share: float | None = 1.0) -> Mixture:
    return Mixture(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"), budget_share=budget_share)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark, sf_dir).interleaved()


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark, sf_dir).selection()


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark, sf_dir).shares()


def p7_budget_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark, sf_dir, budget_share=1.0).shares()


def p7_exact_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark, sf_dir, budget_share=None).interleaved()


def p7_exact_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark, sf_dir, budget_share=None).shares()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_chars(shared_spans.shared_intervals(load(spark, sf_dir, "documents"), "doc_id", "text"))


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.maximal_spans(shared_spans.shared_intervals(load(spark, sf_dir, "documents"), "doc_id", "text"))


QUERIES = corpus_queries.QUERIES | {f.__name__: f for f in (p1_found, p1_redacted, p2_found, p2_reasons, p2_signals, p5_found, p5_chains, p6_pack, p6_fill, p7_mix, p7_selection, p7_shares, p7_budget_shares, p7_exact_mix, p7_exact_shares, p8_found, p8_spans)}
ORACLE: dict[str, str] = corpus_queries.ORACLE | {
    "p8_found": """WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 200),
w AS (SELECT doc_id, s, hash(substring(text, s + 1, 200)) AS h FROM (SELECT doc_id, text, unnest(range(0, length(text) - 199)) AS s FROM d)),
g AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
i AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM w WHERE h IN (SELECT h FROM g))
SELECT doc_id, sum(least(200, coalesce(s - p, 200)))::BIGINT AS shared_chars FROM i GROUP BY doc_id""",
    "p8_spans": """WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 200),
w AS (SELECT doc_id, s, hash(substring(text, s + 1, 200)) AS h FROM (SELECT doc_id, text, unnest(range(0, length(text) - 199)) AS s FROM d)),
g AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
i AS (SELECT doc_id, s, s > coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s), -999) + 200 AS opens FROM w WHERE h IN (SELECT h FROM g)),
n AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM i)
SELECT doc_id, min(s) AS first, max(s) + 200 AS last FROM n GROUP BY doc_id, island""",
}
