"""Registered queries of spellings, retrieval terms, retries, run modes and migration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.operators import chunking, codec, dense, lsa, rank
from lodestack.plans.retrieval_queries import DOCS, SPACE, TERMS, bm25_sql, documents, search_queries, space, text_index
from lodestack.plans.store_queries import _TEXTS, _VOCAB, VOCABULARY, chunk_texts, words
from lodestack.plans.text_queries import ORACLE as TEXT_SQL
from lodestack.plans.text_queries import clean_sql
from lodestack.session import broadcast_if_small, load, materialize


def spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spellings of every title and path."""
    rows = documents(spark, sf_dir).select("doc_id", F.explode(F.array("title", "path")).alias("of")).where("of is not null")
    return rows.select("doc_id", "of", F.posexplode(T.text_variants(F.col("of"))).alias("place", "spelling")).distinct()


def retrieval_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of every query: its own that the collection knows, then the stems of these that it knows, each once."""
    known = text_index(spark, sf_dir).table("postings").select("term").distinct()
    own = search_queries(spark, sf_dir).select("query_id", F.explode(F.array_distinct(T.raw_terms("query"))).alias("term"))
    stems = own.select("query_id", F.explode(T.word_stems(F.col("term"))).alias("term"))
    every = own.withColumn("alias", F.lit(False)).union(stems.withColumn("alias", F.lit(True))).groupBy("query_id", "term").agg(F.min("alias").alias("alias"))
    return every.join(known, "term", "left_semi").select("query_id", "term", "alias")


def vocabulary_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary tokens that say something: neither blank nor without letter and digit."""
    blank, spoken = F.col("token").rlike(r"^\s*$"), F.col("token").rlike("[A-Za-z0-9]")
    return words(spark, sf_dir).select("token", (~blank & spoken).alias("meaningful"))


def bm25_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without terms in more than a tenth of the documents; queries that this leaves empty are asked again with all."""
    found = space(spark, sf_dir)
    strict = materialize(rank.bm25(found, max_df_ratio=0.1), "strict")
    again = rank.bm25(found).join(broadcast_if_small(strict.select("query_id").distinct()), "query_id", "left_anti")
    return strict.withColumn("retried", F.lit(False)).union(again.withColumn("retried", F.lit(True)))


def gen_first_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query of every document: the first five different words of its text with three letters or more."""
    found = F.filter(F.array_distinct(T.raw_terms("text")), lambda w: F.length(w) >= 3)
    return documents(spark, sf_dir).select("doc_id", F.array_join(F.slice(found, 1, 5), " ").alias("query"))


def collected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 different paths in order: what a preset of that size collects."""
    return load(spark, sf_dir, "code_chunks").where("source_path is not null").select(T.clean_path(F.col("source_path")).alias("path")).distinct().orderBy("path").limit(500)


def chunk_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title of every chunk: the path, with the chunk's number where a text has several."""
    chunks = chunking.fixed_chunks(documents(spark, sf_dir), F.col("text")).select("doc_id", "chunk_index")
    several = F.count("*").over(Window.partitionBy("doc_id")) > 1  # the chunks of one text
    named = chunks.withColumn("several", several).join(documents(spark, sf_dir).select("doc_id", F.coalesce("path", F.lit("")).alias("path")), "doc_id")
    return named.select("doc_id", "chunk_index", F.when(F.col("several"), F.concat("path", F.lit("#"), F.col("chunk_index"))).otherwise(F.col("path")).alias("title"))


def collapsed_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of 360 characters of the whole texts with blanks collapsed, around the first query word over two letters."""
    found = materialize(rank.bm25(space(spark, sf_dir), k=3), "found")
    texts = text_index(spark, sf_dir).table("documents").select("doc_id", "text").join(broadcast_if_small(found.select("doc_id").distinct()), "doc_id", "left_semi")
    rows = found.join(texts, "doc_id").join(search_queries(spark, sf_dir).select("query_id", "query"), "query_id")
    terms = F.filter(T.snippet_terms("query"), lambda t: F.length(t) > 2)
    return rows.select("query_id", "rank", "doc_id", T.windowed_snippet(T.collapsed(F.col("text")), terms, 360).alias("snippet"))


def costliest_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty queries that read most postings."""
    found = space(spark, sf_dir)
    read = found.query_terms.join(broadcast_if_small(found.idf), "term").groupBy("query_id").agg(F.sum("df").alias("postings"))
    return read.orderBy(F.desc("postings"), "query_id").limit(20)


def run_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload bytes of every chunk by run mode."""
    texts, vocab = chunk_texts(spark, sf_dir), words(spark, sf_dir)
    sizes = None
    for mode in codec.RUN_MODES:
        part = codec.encode(texts, vocab, VOCABULARY, runs=mode).select("id", F.octet_length("payload").alias(mode))
        sizes = part if sizes is None else sizes.join(part, "id")
    return sizes


def migrated_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of a vocabulary of 2,000, every second one already of the full one, all brought to the full one."""
    texts, vocab = chunk_texts(spark, sf_dir), words(spark, sf_dir)
    small = materialize(codec.prefix(vocab, 2_000), "prefix")
    old = codec.encode(texts.where("id % 2 = 0"), small, 2_000).union(codec.encode(texts.where("id % 2 <> 0"), vocab, VOCABULARY, version=2))
    moved = materialize(codec.migrate(materialize(old, "old"), small, 2_000, vocab, VOCABULARY, 2), "migrated")
    ok = codec.verify(texts, moved, vocab, VOCABULARY)
    return codec.headers(moved).select("id", "version").join(ok, "id")


def lsa_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents nearest to every query in 32 latent dimensions."""
    found, queries = text_index(spark, sf_dir), search_queries(spark, sf_dir)
    counts = found.table("postings").select("doc_id", "term", "tf")
    latent = lsa.fit(counts, found.table("documents").count())
    asked = queries.select("query_id", F.explode(T.raw_terms("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("tf"))
    return dense.dense_topk(materialize(latent.vectors(counts, "doc_id"), "vectors"), latent.vectors(asked, "query_id"), 5)


QUERIES = {
    f.__name__: f
    for f in (spellings, retrieval_terms, vocabulary_kinds, bm25_retry, gen_first_words, collected_files, chunk_titles, collapsed_snippet, costliest_queries, run_savings, migrated_payloads, lsa_topk)
}

_STEMS = TEXT_SQL["stem_aliases"].split("SELECT DISTINCT term, alias")[0]
_SNIPPET = """, t AS (SELECT r.query_id, rank, doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS body, list_filter(list_transform(regexp_extract_all(query, '[A-Za-z0-9_]{2,}'), lambda x: lower(x)), lambda x: length(x) > 2) AS terms FROM r JOIN docs USING (doc_id) JOIN labelled_queries q ON q.id = r.query_id),
a AS (SELECT *, length(body) AS size, greatest(0, coalesce(list_min(list_filter(list_transform(terms, lambda x: instr(lower(body), x)), lambda p: p > 0)) - 1, 0) - 120) AS b0 FROM t),
b AS (SELECT *, least(size, b0 + 360) AS e FROM a),
c AS (SELECT *, CASE WHEN e - b0 < 360 THEN greatest(0, e - 360) ELSE b0 END AS s FROM b),
d AS (SELECT *, CASE WHEN s > 0 THEN '...' ELSE '' END AS pre, CASE WHEN e < size THEN '...' ELSE '' END AS post, trim(substring(body, s + 1, e - s), ' ') AS body2 FROM c)
SELECT query_id, rank, doc_id, CASE WHEN size <= 360 THEN body ELSE pre || substring(body2, 1, 360 - length(pre) - length(post)) || post END AS snippet FROM d"""

ORACLE = {
    "retrieval_terms": _STEMS
    + f""", own AS (SELECT DISTINCT id AS query_id, unnest({TERMS.format("query")}) AS term FROM labelled_queries),
w AS (SELECT DISTINCT term FROM own),
qs AS ({_STEMS[_STEMS.index("\ns AS (") + 7 : _STEMS.rindex(")")].replace("FROM v", "FROM w")}),
e AS (SELECT query_id, term, false AS alias FROM own UNION ALL SELECT query_id, qs.alias, true FROM own JOIN qs USING (term))
SELECT query_id, term, bool_and(alias) AS alias FROM e WHERE term IN (SELECT term FROM v) GROUP BY ALL""",
    "vocabulary_kinds": _VOCAB + " SELECT token, NOT regexp_full_match(token, '\\s*') AND regexp_matches(token, '[A-Za-z0-9]') AS meaningful FROM vocab",
    "bm25_retry": "WITH" + SPACE + f", f AS (SELECT * FROM {bm25_sql(where='df_ratio <= 0.1')}) SELECT *, false AS retried FROM f UNION ALL SELECT *, true FROM {bm25_sql()} WHERE query_id NOT IN (SELECT query_id FROM f)",
    "gen_first_words": "WITH" + DOCS + f""", w AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {TERMS.format("text")} AS l FROM docs)),
m0 AS (SELECT doc_id, word, min(i) AS i FROM w WHERE length(word) >= 3 GROUP BY ALL),
m AS (SELECT * FROM m0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 5)
SELECT doc_id, coalesce((SELECT string_agg(word, ' ' ORDER BY i) FROM m WHERE m.doc_id = docs.doc_id), '') AS query FROM docs""",
    "collected_files": f"SELECT DISTINCT {clean_sql('source_path')} AS path FROM code_chunks WHERE source_path IS NOT NULL ORDER BY path LIMIT 500",
    "chunk_titles": "WITH" + DOCS + """, c AS (SELECT doc_id, path, unnest(range(0, 1 + ceil(greatest(0, length(text) - 1800) / 1620)::BIGINT)) AS i FROM docs)
SELECT doc_id, i::INT AS chunk_index, CASE WHEN count(*) OVER (PARTITION BY doc_id) > 1 THEN coalesce(path, '') || '#' || i ELSE coalesce(path, '') END AS title FROM c""",
    "collapsed_snippet": "WITH" + SPACE + ", r AS (SELECT * FROM " + bm25_sql(k=3) + ")" + _SNIPPET,
    "costliest_queries": "WITH" + SPACE + " SELECT query_id, sum(df)::BIGINT AS postings FROM qt JOIN idf USING (term) GROUP BY query_id ORDER BY postings DESC, query_id LIMIT 20",
    "migrated_payloads": f"WITH {_TEXTS} SELECT id, 2 AS version, true AS length_ok, true AS checksum_ok, true AS lossless FROM ct",
}
