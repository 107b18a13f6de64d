"""Registered queries of near-duplicates and term frequencies, each with the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestack.llm.near_duplicates import NearDuplicates
from lodestack.llm.term_frequency import marked_terms
from lodestack.session import load


def near_duplicate_chunks(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    return NearDuplicates(load(spark, sf_dir, "code_chunks"), "id", "text", shingle_words=4, threshold=0.6, least_words=40)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_chunks(spark, sf_dir).all_pairs()


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_chunks(spark, sf_dir).groups()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = marked_terms(load(spark, sf_dir, "bench_docs"), "id", "text", "harvested_at")
    return terms.where("mark <> 'useful'").select("term", "n_total", "n_docs", "mark")


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_terms(load(spark, sf_dir, "bench_docs"), "id", "text", "harvested_at").select("term", "n_total", "n_docs", "mark")


def p4_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = marked_terms(load(spark, sf_dir, "bench_docs"), "id", "text", "harvested_at", max_n=3)
    return terms.where("n_docs > 2").select("n", "term", "n_total", "n_docs", "mark")


def p4_all_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_terms(load(spark, sf_dir, "bench_docs"), "id", "text", "harvested_at", max_n=3).select("n", "term", "n_total", "n_docs", "mark")


def p4_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All n-grams of up to five terms with their marks."""
    return marked_terms(load(spark, sf_dir, "bench_docs"), "id", "text", "harvested_at", max_n=5).select("n", "term", "n_total", "n_docs", "mark")


QUERIES = {f.__name__: f for f in (p3_found, p3_groups, p4_found, p4_terms, p4_phrases, p4_all_phrases, p4_ngrams)}

_SIMILAR = """
WITH RECURSIVE t AS (SELECT id, max(text) AS text FROM code_chunks WHERE text IS NOT NULL GROUP BY id),
w AS (SELECT id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w FROM t),
s AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 2), lambda i: concat_ws(' ', w[i], w[i+1], w[i+2], w[i+3]))) AS g FROM w WHERE len(w) >= 40),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.id < y.id GROUP BY ALL),
p AS (SELECT a AS id_a, b AS id_b FROM c JOIN n x ON a = x.id JOIN n y ON b = y.id WHERE c >= 0.6 * (x.n + y.n - c))
"""
_TERMS = """
WITH t AS (SELECT id, max(text) AS text FROM (SELECT *, rank() OVER (PARTITION BY id ORDER BY harvested_at DESC NULLS LAST) AS r FROM bench_docs WHERE text IS NOT NULL) WHERE r = 1 GROUP BY id),
w AS (SELECT id, list_transform(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]{2,}'), lambda x: lower(x)) AS w FROM t),
"""
_MARKS = """
SELECT term, n_total, n_docs, CASE WHEN n_docs >= 0.2 * (SELECT count(*) FROM t) THEN 'common' WHEN n_docs <= 2 THEN 'rare' ELSE 'useful' END AS mark
"""
_ONE = _TERMS + """
c AS (SELECT term, count(*) AS n_total, count(DISTINCT id) AS n_docs FROM (SELECT id, unnest(w) AS term FROM w) GROUP BY term),
m AS (""" + _MARKS + "FROM c)"


def _grams(most: int) -> str:
    """SQL of all n-grams of up to ``most`` terms."""
    spelled = [" || ' ' || ".join(f"w[i+{k}]" for k in range(n)) for n in range(1, most + 1)]
    parts = [f"SELECT id, unnest(list_transform(range(1, len(w) + {2 - n}), lambda i: {t})) AS term, {n} AS n FROM w" for n, t in enumerate(spelled, 1)]
    return _TERMS + "g AS (" + " UNION ALL ".join(parts) + "), c AS (SELECT n, term, count(*) AS n_total, count(DISTINCT id) AS n_docs FROM g GROUP BY n, term)" + _MARKS.replace("SELECT term", "SELECT n::INT AS n, term") + "FROM c"


ORACLE = {
    "p3_found": _SIMILAR + "SELECT id_a, id_b FROM p",
    "p3_groups": _SIMILAR
    + """, e AS (SELECT id_a AS x, id_b AS y FROM p UNION ALL SELECT id_b, id_a FROM p),
r AS (SELECT id AS x, id AS y FROM n UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT r.x AS id, min(r.y) AS group_id, (SELECT count(*) FROM e WHERE e.x = r.x) AS links FROM r GROUP BY r.x""",
    "p4_found": _ONE + " SELECT * FROM m WHERE mark <> 'useful'",
    "p4_terms": _ONE + " SELECT * FROM m",
    "p4_phrases": _TERMS
    + """
g AS (SELECT id, unnest(w) AS term, 1 AS n FROM w UNION ALL
 SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])), 2 FROM w UNION ALL
 SELECT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])), 3 FROM w),
c AS (SELECT n, term, count(*) AS n_total, count(DISTINCT id) AS n_docs FROM g GROUP BY n, term HAVING count(DISTINCT id) > 2)
"""
    + _MARKS.replace("SELECT term", "SELECT n::INT AS n, term")
    + "FROM c",
    "p4_ngrams": _grams(5),
}
