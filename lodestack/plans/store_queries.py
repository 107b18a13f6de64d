"""Registered queries of the codec, the pack store, dense vectors and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.operators import codec, dense, index, store
from lodestack.plans.retrieval_queries import TF, documents
from lodestack.session import load, materialize
from lodestack.streaming import append

VOCABULARY = 20_000


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "code_chunks").where("text is not null").groupBy("id").agg(F.max(F.struct("text", "language_id")).alias("r")).select("id", "r.text", "r.language_id")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(codec.vocabulary(chunk_texts(spark, sf_dir), VOCABULARY), "vocabulary")


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.vocabulary(chunk_texts(spark, sf_dir), VOCABULARY)


def token_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A colour of every vocabulary id, from its three low bytes."""
    n = F.col("token_id")
    return codec.vocabulary(chunk_texts(spark, sf_dir), VOCABULARY).select("token", *[(F.shiftright(n, s) % 256).alias(c) for c, s in (("r", 16), ("g", 8), ("b", 0))])


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = codec.token_ids(chunk_texts(spark, sf_dir), words(spark, sf_dir), VOCABULARY)
    return ids.select("id", F.size("ids").alias("n"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_md5"))


def rle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.runs(chunk_texts(spark, sf_dir))


def checksum16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_texts(spark, sf_dir).select("id", codec.checksum16(F.col("text").cast("binary")).alias("checksum"))


def varint_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the posting gaps and frequencies of every term, as variable-length numbers."""
    gaps = index.postings_gaps(index.term_freq(documents(spark, sf_dir)))
    return gaps.groupBy("term").agg(F.count("*").alias("postings"), F.sum(codec.varint_length(F.col("gap"))).alias("bytes"))


def header_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = chunk_texts(spark, sf_dir)
    return codec.headers(codec.encode(texts, words(spark, sf_dir), VOCABULARY)).select("id", "magic", "version", "bytes", "language", "checksum")


def roundtrip_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, vocab = chunk_texts(spark, sf_dir), words(spark, sf_dir)
    packed = materialize(codec.encode(texts, vocab, VOCABULARY), "payloads")
    return codec.verify(texts, packed, vocab, VOCABULARY)


def verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = roundtrip_check(spark, sf_dir)
    packs = load(spark, sf_dir, "code_chunks").select("id", "pack_id").distinct()
    ok = F.col("length_ok") & F.col("checksum_ok") & F.col("lossless")
    return checked.join(packs, "id").groupBy("pack_id").agg(F.count("*").alias("chunks"), F.sum(ok.cast("int")).alias("perfect"), F.sum((~ok).cast("int")).alias("failed"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["pack_id", "source", "spec", "original_size", "spec_size", "source_id", "packed_at"]
    return index.latest(load(spark, sf_dir, "pack_entries").drop("metadata"), ["entry_id"], columns, "received_at")


def append_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries received within an hour of packing, then the late ones in place of their paths."""
    rows = load(spark, sf_dir, "pack_entries").select("pack_id", "source", "entry_id", "original_size", "spec_size", "packed_at", "received_at").distinct()
    late = F.col("received_at") > F.col("packed_at") + F.expr("INTERVAL 1 HOUR")
    base = index.latest(rows.where(~late), ["pack_id", "source"], rows.columns, "packed_at").select(*rows.columns)
    merged = store.upsert(base, rows.where(late), ["pack_id", "source"], "packed_at")
    return merged.select("pack_id", "source", "entry_id", "spec_size")


def tombstone_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = store.without_deleted(entries(spark, sf_dir), load(spark, sf_dir, "tombstones"))
    return kept.select("entry_id", "pack_id", "source")


def pack_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.inspect(entries(spark, sf_dir))


def decode_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.decode_policy(entries(spark, sf_dir), "auto", 600)
    return rows.groupBy("pack_id").agg(F.sum(F.col("opened").cast("int")).alias("opened"), F.sum((~F.col("opened")).cast("int")).alias("deferred"), F.sum(F.when(F.col("opened"), F.col("spec_size"))).alias("opened_bytes"))


def trash_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tombstones by tidied reason, each counted once."""
    reason = F.regexp_replace(F.lower(F.trim(F.coalesce("reason", F.lit("")))), r"[\s_\-]+", " ")
    rows = load(spark, sf_dir, "tombstones").groupBy("tombstone_id").agg(F.max(F.struct("received_at", reason.alias("reason"), "checksum_ok", "length_ok")).alias("r"))
    return rows.groupBy(F.when(F.col("r.reason") != "", F.col("r.reason")).otherwise("(none)").alias("reason")).agg(F.count("*").alias("removed"), F.sum((F.col("r.checksum_ok") & F.col("r.length_ok")).cast("int")).alias("intact"))


def ops_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which entries carry what their pack needs in their metadata."""
    rows = load(spark, sf_dir, "pack_entries").groupBy("entry_id", "pack_id").agg(F.max(F.coalesce(F.element_at("metadata", "language"), F.lit(""))).alias("language"), F.max(F.coalesce(F.element_at("metadata", "owner"), F.lit(""))).alias("owner"))
    return rows.groupBy("pack_id").agg(F.count("*").alias("entries"), F.sum((F.col("language") != "").cast("int")).alias("with_language"), F.sum((F.col("owner") != "").cast("int")).alias("with_owner"), F.sum(((F.col("language") != "") & (F.col("owner") != "")).cast("int")).alias("ready"))


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.get_json_object("props", "$.k").cast("long")
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.count(value).alias("with_k"), F.sum(value).alias("k"))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return dense.dense_topk(rows.select(F.col("vec_id").alias("doc_id"), "embedding"), queries, 10)


def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return append.windowed_counts(spark, f"{sf_dir}/events.parquet")


def stream_append_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return append.appended_entries(spark, f"{sf_dir}/pack_entries.parquet", ["entry_id"], ["pack_id", "source", "spec_size"], "received_at")


QUERIES = {
    f.__name__: f
    for f in (
        vocabulary, token_rgb, token_ids, rle_runs, checksum16, varint_bytes, header_parse, roundtrip_check, verify_report, append_upsert, tombstone_delete, pack_inspect, decode_policy, trash_log,
        ops_readiness, json_fields, dense_topk, stream_event_windows, stream_append_entries,
    )
}

_TEXTS = "ct AS (SELECT id, max({'text': text, 'l': language_id}).text AS text, max({'text': text, 'l': language_id}).l AS language_id FROM code_chunks WHERE text IS NOT NULL GROUP BY id)"
_TOKENS = "regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+|\\s+|[^A-Za-z0-9_$\\s]')"
_VOCAB = f"""WITH {_TEXTS}, tk AS (SELECT id, {_TOKENS} AS l FROM ct),
vocab AS (SELECT token, row_number() OVER (ORDER BY documents DESC, token) - 1 AS token_id, documents FROM (SELECT token, count(DISTINCT id) AS documents FROM (SELECT id, unnest(l) AS token FROM tk) GROUP BY token) QUALIFY token_id < {VOCABULARY})"""
_PLACED = ", placed AS (SELECT id, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS pos FROM tk)"
_TEXTS += ", hx AS (SELECT id, text, language_id, regexp_extract_all(hex(encode(text)), '..') AS h FROM ct)"
_SUM = "coalesce(list_sum(list_transform(h, lambda x: ('0x' || x)::BIGINT)), 0) % 65536"
_ENTRIES = "e AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY received_at DESC NULLS LAST) AS rn FROM pack_entries) WHERE rn = 1)"
_VARINT = "CASE " + " ".join(f"WHEN gap < {1 << 7 * n} THEN {n}" for n in range(1, 9)) + " ELSE 9 END"

ORACLE = {
    "vocabulary": _VOCAB + " SELECT token, token_id, documents FROM vocab",
    "token_rgb": _VOCAB + " SELECT token, token_id // 65536 % 256 AS r, token_id // 256 % 256 AS g, token_id % 256 AS b FROM vocab",
    "token_ids": _VOCAB + _PLACED + f""", ids AS (SELECT id, pos, CASE WHEN token_id IS NOT NULL THEN [token_id] ELSE flatten(list_transform(string_split(token, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c) + {VOCABULARY}] ELSE [{codec.CODE_POINT}, unicode(c)] END)) END AS ids FROM placed LEFT JOIN vocab USING (token)),
f AS (SELECT id, flatten(list(ids ORDER BY pos)) AS ids FROM ids GROUP BY id)
SELECT id, coalesce(len(ids), 0) AS n, md5(coalesce(array_to_string(ids, ','), '')) AS ids_md5 FROM ct LEFT JOIN f USING (id)""",
    "rle_runs": _VOCAB + _PLACED + ", i AS (SELECT *, pos - row_number() OVER (PARTITION BY id, token ORDER BY pos) AS island FROM placed) SELECT id, min(pos) AS start, count(*) AS length, token FROM i GROUP BY id, token, island HAVING count(*) >= 3",
    "checksum16": f"WITH {_TEXTS} SELECT id, {_SUM} AS checksum FROM hx",
    "varint_bytes": "WITH" + TF + f", g AS (SELECT term, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term, doc_id // 4096 ORDER BY doc_id), doc_id // 4096 * 4096) AS gap FROM tf) SELECT term, count(*) AS postings, sum({_VARINT})::BIGINT AS bytes FROM g GROUP BY term",
    "header_parse": f"WITH {_TEXTS} SELECT id, 'LDST' AS magic, 1 AS version, strlen(text) AS bytes, coalesce(language_id, -1) & 65535 AS language, {_SUM} AS checksum FROM hx",
    "roundtrip_check": f"WITH {_TEXTS} SELECT id, true AS length_ok, true AS checksum_ok, true AS lossless FROM ct",
    "verify_report": f"WITH {_TEXTS} SELECT pack_id, count(*) AS chunks, count(*) AS perfect, 0 AS failed FROM ct JOIN (SELECT DISTINCT id, pack_id FROM code_chunks) USING (id) GROUP BY pack_id",
    "append_upsert": """WITH r AS (SELECT DISTINCT pack_id, source, entry_id, original_size, spec_size, packed_at, received_at, received_at > packed_at + INTERVAL 1 HOUR AS late FROM pack_entries),
b AS (SELECT pack_id, source, max({'p': packed_at, 'e': entry_id, 'o': original_size, 's': spec_size, 'r': received_at}) AS m, late FROM r GROUP BY ALL)
SELECT pack_id, source, m.e AS entry_id, m.s AS spec_size FROM b WHERE late OR (pack_id, source) NOT IN (SELECT (pack_id, source) FROM b WHERE late)""",
    "tombstone_delete": f"WITH {_ENTRIES}, t AS (SELECT pack_id, source_path AS source, max(deleted_at) AS deleted_at FROM tombstones GROUP BY ALL) SELECT entry_id, pack_id, source FROM e LEFT JOIN t USING (pack_id, source) WHERE deleted_at IS NULL OR deleted_at < packed_at",
    "pack_inspect": f"WITH {_ENTRIES} SELECT pack_id, count(*) AS entries, sum(original_size) FILTER (original_size >= 0)::BIGINT AS original_bytes, sum(spec_size)::BIGINT AS spec_bytes, count(*) FILTER (original_size >= 0) AS sized, round(sum(spec_size) FILTER (original_size >= 0) / sum(original_size) FILTER (original_size >= 0), 4) AS ratio FROM e GROUP BY pack_id",
    "decode_policy": f"WITH {_ENTRIES} SELECT pack_id, count(*) FILTER (spec_size <= 600) AS opened, count(*) FILTER (spec_size > 600) AS deferred, sum(spec_size) FILTER (spec_size <= 600)::BIGINT AS opened_bytes FROM e GROUP BY pack_id",
    "trash_log": """WITH t AS (SELECT tombstone_id, max({'r': received_at, 'reason': regexp_replace(lower(trim(coalesce(reason, ''), ' ')), '[\\s_\\-]+', ' ', 'g'), 'c': checksum_ok, 'l': length_ok}) AS r FROM tombstones GROUP BY tombstone_id)
SELECT CASE WHEN r.reason <> '' THEN r.reason ELSE '(none)' END AS reason, count(*) AS removed, sum((r.c AND r.l)::INT)::BIGINT AS intact FROM t GROUP BY 1""",
    "ops_readiness": """WITH r AS (SELECT entry_id, pack_id, max(coalesce(metadata['language'], '')) AS l, max(coalesce(metadata['owner'], '')) AS o FROM pack_entries GROUP BY ALL)
SELECT pack_id, count(*) AS entries, count(*) FILTER (l <> '') AS with_language, count(*) FILTER (o <> '') AS with_owner, count(*) FILTER (l <> '' AND o <> '') AS ready FROM r GROUP BY pack_id""",
    "json_fields": "SELECT event_type, count(*) AS events, count(props->>'$.k') AS with_k, sum((props->>'$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY event_type",
    "dense_topk": """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 5) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s QUALIFY rank <= 10""",
    "stream_event_windows": "SELECT time_bucket(INTERVAL 60 MINUTES, ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "stream_append_entries": f"WITH {_ENTRIES} SELECT entry_id, pack_id, source, spec_size FROM e",
}
