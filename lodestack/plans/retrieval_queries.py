"""Registered queries of indexing and ranking, each with the same thing in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import index, rank
from lodestack.session import load, shared_dir


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, title, text, path, language_id, collection)``: the latest copy of every record with a text."""
    rows = load(spark, sf_dir, "bench_docs").where("text is not null")
    return index.latest(rows, ["id"], ["title", "text", "path", "language_id", "collection"], "harvested_at").withColumnRenamed("id", "doc_id")


def spread_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`documents` with an id, in at least as many partitions as there are cores; texts are shuffled only where files have fewer."""
    rows = load(spark, sf_dir, "bench_docs").where("text is not null and id is not null")
    cores = spark.sparkContext.defaultParallelism
    rows = rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
    return index.latest_apart(rows, ["id"], ["title", "text", "path", "language_id", "collection"], "harvested_at").withColumnRenamed("id", "doc_id")


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "labelled_queries").select(F.col("id").alias("query_id"), "query", "query_type", "expected_paths")


_INDEXES: dict[tuple[str, str], index.TextIndex] = {}


def text_index(spark: SparkSession, sf_dir: str) -> index.TextIndex:
    """The index of a data folder's documents: written at the first search of an application, read by all."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = index.TextIndex.build(documents(spark, sf_dir), f"{shared_dir(spark)}/lodestack-index-{uuid.uuid4().hex}")
    return _INDEXES[key]


def space(spark: SparkSession, sf_dir: str) -> index.SearchSpace:
    return index.SearchSpace(text_index(spark, sf_dir), search_queries(spark, sf_dir))


DOCS = """
docs AS (SELECT id AS doc_id, title, text, path, language_id, collection FROM
 (SELECT *, row_number() OVER (PARTITION BY id ORDER BY harvested_at DESC NULLS LAST) AS rn FROM bench_docs WHERE text IS NOT NULL) WHERE rn = 1)"""
TERMS = """list_transform(regexp_extract_all(coalesce({0}, ''), '[A-Za-z][A-Za-z0-9'']+'), lambda x: lower(x))"""
TF = DOCS + f""",
toks AS (SELECT doc_id, {TERMS.format("text")} AS terms, len({TERMS.format("text")}) AS dl FROM docs),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(terms) AS term FROM toks) GROUP BY ALL),
cs AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM toks),
idf AS (SELECT term, df, df / n AS df_ratio, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), cs)"""
SPACE = TF + f""",
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT id AS query_id, unnest({TERMS.format("query")}) AS term FROM labelled_queries) GROUP BY ALL),
titles AS (SELECT DISTINCT doc_id, unnest({TERMS.format("title")}) AS term FROM docs),
hit AS (SELECT query_id, qtf, term, doc_id, dl, tf, df, df_ratio, idf FROM qt JOIN tf USING (term) JOIN idf USING (term))"""


def bm25_sql(k1: float = 1.5, b: float = 0.75, where: str = "true", weight: str = "qtf", boost: str = "", k: int = 10) -> str:
    parts = f"SELECT query_id, doc_id, idf * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl)) * {weight} AS s FROM hit, cs WHERE {where}"
    if boost:
        parts += f" UNION ALL SELECT query_id, doc_id, {boost} FROM qt JOIN titles USING (term)"
    return f"(SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM (SELECT query_id, doc_id, round(sum(s), 6) AS score FROM ({parts}) GROUP BY ALL) WHERE score > 0 QUALIFY rank <= {k})"


def raw_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = index.tokenized(documents(spark, sf_dir))
    return tokens.select("doc_id", "dl", F.md5(F.array_join("terms", " ")).alias("terms_md5"))


def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.term_freq(documents(spark, sf_dir))


def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.doc_stats(documents(spark, sf_dir))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.corpus_stats(documents(spark, sf_dir))


def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return index.idf_table(docs, docs.count()).select("term", "df", F.round("df_ratio", 6).alias("df_ratio"), F.round("idf", 6).alias("idf"))


def postings_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings_segments(index.term_freq(documents(spark, sf_dir)))


def postings_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings_gaps(index.term_freq(documents(spark, sf_dir)))


def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.candidates(space(spark, sf_dir))


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.bm25(space(spark, sf_dir))


def bm25_matched_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = space(spark, sf_dir)
    return rank.matched_terms(s, rank.bm25(s, k=5)).select("query_id", "rank", "doc_id", "score", F.array_join("matched", " ").alias("matched"))


def bm25_df_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.bm25(space(spark, sf_dir), max_df_ratio=0.1)


def bm25_unique_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.bm25(space(spark, sf_dir), unique_terms=True)


def bm25_title_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.bm25(space(spark, sf_dir), k1=1.2, title_boost=1.0)


VARIANTS = (("classic", 1.5, 0.75), ("serving", 1.2, 0.75), ("short", 0.9, 0.4), ("flat", 1.2, 0.0))


def bm25_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = space(spark, sf_dir)
    out = None
    for name, k1, b in VARIANTS:
        ranked = rank.bm25(s, k=5, k1=k1, b=b).withColumn("variant", F.lit(name))
        out = ranked if out is None else out.union(ranked)
    return out


def query_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.token_types(space(spark, sf_dir)).select("query_id", "term", "df", F.round("df_ratio", 6).alias("df_ratio"))


def token_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.token_types(space(spark, sf_dir)).select("query_id", "term", "kind")


def binary_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.binary_cosine(space(spark, sf_dir), index.doc_stats(documents(spark, sf_dir)))


def tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.tfidf_cosine(space(spark, sf_dir), text_index(spark, sf_dir))


def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = space(spark, sf_dir)
    return rank.reciprocal_rank_fusion([rank.bm25(s, k=40), rank.tfidf_cosine(s, text_index(spark, sf_dir), k=40)], k=10)


def selective_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.selective_search(space(spark, sf_dir))


def selective_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.selective_search(space(spark, sf_dir), cap=25)


def fallback_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = space(spark, sf_dir)
    return rank.merge_first(rank.selective_search(s, k=10, cap=25), rank.bm25(s, k=10, k1=1.2, title_boost=1.0), k=10)


def self_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id divides by 100 as a query, with all its terms, against all documents."""
    docs = documents(spark, sf_dir)
    queries = docs.where("doc_id % 100 = 0").select(F.col("doc_id").cast("string").alias("query_id"), F.col("text").alias("query"))
    ranked = rank.bm25(index.SearchSpace(text_index(spark, sf_dir), queries), k=10, unique_terms=True)
    own = ranked.where(F.col("query_id").cast("long") == F.col("doc_id")).select("query_id", F.col("rank").alias("own_rank"))
    return queries.select("query_id").join(own, "query_id", "left").select("query_id", F.coalesce("own_rank", F.lit(0)).alias("own_rank"))


QUERIES = {
    f.__name__: f
    for f in (
        raw_terms, term_freq, doc_stats, corpus_stats, idf_table, postings_lists, postings_gaps, candidate_union, bm25_search, bm25_matched_terms, bm25_df_filter, bm25_unique_terms,
        bm25_title_boost, bm25_variants, query_token_stats, token_types, binary_cosine, tfidf_cosine, rrf_hybrid, selective_search, selective_cap, fallback_merge, self_retrieval,
    )
}

KINDS = """,
stats AS (SELECT query_id, qt.term, qtf, coalesce(df, 0) AS df, coalesce(df_ratio, 0) AS df_ratio, coalesce(idf, 0) AS idf,
 qt.term IN (SELECT term FROM titles) OR regexp_matches(qt.term, '^[A-Za-z0-9_]*([A-Za-z][A-Za-z0-9_]*[0-9]|[0-9][A-Za-z0-9_]*[A-Za-z])[A-Za-z0-9_]*$') AS codelike FROM qt LEFT JOIN idf USING (term)),
kinds AS (SELECT *, CASE WHEN df = 0 THEN 'missing' WHEN df_ratio <= 0.05 THEN 'rare' WHEN df_ratio > 0.10 THEN 'common' WHEN codelike THEN 'identifier/path' ELSE 'text' END AS kind FROM stats)"""


def selective_sql(cap: int, k: int = 10) -> str:
    return f""",
w0 AS (SELECT *, CASE WHEN df = 0 THEN 0 WHEN kind IN ('rare', 'identifier/path') THEN greatest(0.35, idf / greatest(1, ln(n + 1))) ELSE idf / greatest(1, ln(n + 1)) END AS w FROM kinds, cs),
wt AS (SELECT query_id, term, w, idf, row_number() OVER (PARTITION BY query_id ORDER BY round(w, 9) DESC, df, round(idf, 9) DESC, term) AS turn FROM w0 WHERE w >= 0.05),
walk AS (SELECT query_id, doc_id, w, row_number() OVER (PARTITION BY query_id ORDER BY turn, doc_id) AS rn FROM wt JOIN tf USING (term)),
walk2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rn) = 1 AS fresh FROM walk),
walk3 AS (SELECT *, coalesce(sum(fresh::INT) OVER (PARTITION BY query_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM walk2),
cand AS (SELECT query_id, doc_id FROM walk3 WHERE seen < {cap} GROUP BY ALL HAVING round(sum(w), 9) >= 0.35),
sparts AS (SELECT query_id, doc_id, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) * w AS s FROM wt JOIN tf USING (term) JOIN cand USING (query_id, doc_id), cs
 UNION ALL SELECT query_id, doc_id, 1.0 FROM wt JOIN titles USING (term) JOIN cand USING (query_id, doc_id)),
sel AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM (SELECT query_id, doc_id, round(sum(s), 6) AS score FROM sparts GROUP BY ALL) WHERE score > 0 QUALIFY rank <= {k})"""


def tfidf_sql(k: int) -> str:
    weight = "(ln((n + 1) / (df + 1)) + 1)"
    return f""",
norms AS (SELECT doc_id, sqrt(sum((tf * {weight}) ** 2)) AS norm FROM tf JOIN idf USING (term), cs GROUP BY doc_id),
qw AS (SELECT query_id, term, qtf * {weight} AS w, {weight} AS v FROM qt JOIN idf USING (term), cs),
qn AS (SELECT query_id, sqrt(sum(w ** 2)) AS qnorm FROM qw GROUP BY query_id),
cosine AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM
 (SELECT query_id, doc_id, round(dot / (norm * qnorm), 6) AS score FROM (SELECT query_id, doc_id, sum(w * tf * v) AS dot FROM qw JOIN tf USING (term) GROUP BY ALL) JOIN norms USING (doc_id) JOIN qn USING (query_id)) QUALIFY rank <= {k})"""


ORACLE = {
    "raw_terms": "WITH" + TF + " SELECT doc_id, dl, md5(array_to_string(terms, ' ')) AS terms_md5 FROM toks",
    "term_freq": "WITH" + TF + " SELECT doc_id, term, tf FROM tf",
    "doc_stats": "WITH" + TF + " SELECT doc_id, dl, len(list_distinct(terms)) AS distinct_terms FROM toks",
    "corpus_stats": "WITH" + TF + " SELECT count(*) AS n_docs, sum(dl)::BIGINT AS total_terms, round(avg(dl), 2) AS avgdl FROM toks",
    "idf_table": "WITH" + TF + " SELECT term, df, round(df_ratio, 6) AS df_ratio, round(idf, 6) AS idf FROM idf",
    "postings_lists": "WITH" + TF + " SELECT term, doc_id // 4096 AS segment, list(doc_id ORDER BY doc_id) AS doc_ids, list(tf ORDER BY doc_id) AS tfs FROM tf GROUP BY ALL",
    "postings_gaps": "WITH" + TF + " SELECT term, doc_id // 4096 AS segment, doc_id, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term, doc_id // 4096 ORDER BY doc_id), doc_id // 4096 * 4096) AS gap FROM tf",
    "candidate_union": "WITH" + SPACE + " SELECT query_id, count(DISTINCT doc_id) AS candidates FROM hit GROUP BY query_id",
    "bm25_search": "WITH" + SPACE + " SELECT * FROM " + bm25_sql(),
    "bm25_matched_terms": "WITH" + SPACE + " SELECT r.*, (SELECT string_agg(term, ' ' ORDER BY term) FROM hit h WHERE h.query_id = r.query_id AND h.doc_id = r.doc_id) AS matched FROM " + bm25_sql(k=5) + " r",
    "bm25_df_filter": "WITH" + SPACE + " SELECT * FROM " + bm25_sql(where="df_ratio <= 0.1"),
    "bm25_unique_terms": "WITH" + SPACE + " SELECT * FROM " + bm25_sql(weight="1"),
    "bm25_title_boost": "WITH" + SPACE + " SELECT * FROM " + bm25_sql(k1=1.2, boost="1.0"),
    "bm25_variants": "WITH" + SPACE + " UNION ALL ".join(f" SELECT *, '{n}' AS variant FROM " + bm25_sql(k1=k1, b=b, k=5) for n, k1, b in VARIANTS),
    "query_token_stats": "WITH" + SPACE + KINDS + " SELECT query_id, term, df, round(df_ratio, 6) AS df_ratio FROM kinds",
    "token_types": "WITH" + SPACE + KINDS + " SELECT query_id, term, kind FROM kinds",
    "binary_cosine": "WITH"
    + SPACE
    + """, qs AS (SELECT query_id, count(*) AS q FROM qt GROUP BY ALL), ds AS (SELECT doc_id, count(*) AS d FROM tf GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM
 (SELECT query_id, doc_id, round(c / sqrt(q * d), 6) AS score FROM (SELECT query_id, doc_id, count(*) AS c FROM hit GROUP BY ALL) JOIN qs USING (query_id) JOIN ds USING (doc_id)) QUALIFY rank <= 10""",
    "tfidf_cosine": "WITH" + SPACE + tfidf_sql(10) + " SELECT * FROM cosine",
    "rrf_hybrid": "WITH"
    + SPACE
    + tfidf_sql(40)
    + ", ranks AS (SELECT query_id, rank, doc_id FROM "
    + bm25_sql(k=40)
    + """ UNION ALL SELECT query_id, rank, doc_id FROM cosine)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM ranks GROUP BY ALL) QUALIFY rank <= 10""",
    "selective_search": "WITH" + SPACE + KINDS + selective_sql(2000) + " SELECT * FROM sel",
    "selective_cap": "WITH" + SPACE + KINDS + selective_sql(25) + " SELECT * FROM sel",
    "fallback_merge": "WITH"
    + SPACE
    + KINDS
    + selective_sql(25)
    + ", parts AS (SELECT query_id, rank, doc_id, 0 AS source FROM sel UNION ALL SELECT query_id, rank, doc_id, 1 FROM "
    + bm25_sql(k1=1.2, boost="1.0")
    + """), firsts AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY source, rank) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY source, firsts.rank, doc_id) AS rank, doc_id, source FROM firsts QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY source, firsts.rank, doc_id) <= 10""",
    "self_retrieval": "WITH"
    + TF
    + """, hit AS (SELECT q.doc_id AS query_id, tf.doc_id, dl, tf.tf, idf FROM (SELECT doc_id, term FROM tf WHERE doc_id % 100 = 0) q JOIN tf USING (term) JOIN idf USING (term)),
scored AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM hit, cs GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 10)
SELECT doc_id::VARCHAR AS query_id, coalesce((SELECT rank FROM ranked r WHERE r.query_id = d.doc_id AND r.doc_id = d.doc_id), 0) AS own_rank FROM docs d WHERE doc_id % 100 = 0""",
}
