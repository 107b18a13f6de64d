"""Registered queries of the text functions: chunks, words, paths, snippets, normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.functions.fields import DECLARED, IMPORTED, field_words, path_words, word_positions
from lodestack.operators import blocks, chunking, index, rank
from lodestack.plans.retrieval_queries import DOCS, SPACE, TERMS, bm25_sql, documents, search_queries, space, text_index
from lodestack.session import broadcast_if_small, load, materialize


def scan_nonblank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").select("doc_id", F.coalesce("title", "path", F.lit("")).alias("title"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"))


def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.col("text"))
    return chunking.fixed_chunks(documents(spark, sf_dir), body).select("doc_id", "chunk_index", F.md5("chunk").alias("chunk_md5"))


def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = chunking.token_windows(documents(spark, sf_dir), T.raw_terms("text"))
    return windows.select("doc_id", "window_index", F.size("window").alias("terms"), F.md5(F.array_join("window", " ")).alias("window_md5"))


def chunk_maxpool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by their best chunk: distinct query terms in the chunk."""
    chunks = load(spark, sf_dir, "code_chunks").where("text is not null").select(F.col("id").alias("doc_id"), "page_index", "text").dropDuplicates(["doc_id"])
    found = index.SearchSpace(chunks, search_queries(spark, sf_dir))
    owners = materialize(chunks.select("doc_id", F.col("page_index").alias("owner")), "owners")
    return rank.best_owners(found, owners).withColumnRenamed("owner", "page_index")


def code_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = T.code_words(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.size(words).alias("words"), F.md5(F.array_join(words, " ")).alias("words_md5"))


def stem_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of every term that are terms of the collection themselves."""
    vocabulary = documents(spark, sf_dir).select(F.explode(F.array_distinct(T.raw_terms("text"))).alias("term")).distinct()
    stems = vocabulary.select("term", F.explode(T.word_stems(F.col("term"))).alias("alias")).where("alias <> term")
    return stems.join(vocabulary.withColumnRenamed("term", "alias"), "alias", "left_semi").distinct()


def text_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(T.separated(F.coalesce("title", F.lit("")))).alias("title_md5"), F.md5(T.separated(F.coalesce("path", F.lit("")))).alias("path_md5"))


def expanded_queries(queries: DataFrame) -> DataFrame:
    """``(query_id, query, aliases, expanded)``: the other names of every synonym group that a query touches."""
    key = lambda c: F.concat(F.lit(" "), F.array_join(T.lower_all("[A-Za-z0-9]+", c), " "), F.lit(" "))
    rows = queries.select("query_id", "query", key(F.col("query")).alias("qkey"))
    # a query against a table of a few fixed rows: an array of structs instead of a join
    listed = F.array(*[F.struct(F.lit(g).alias("group_id"), F.array(*[F.struct(F.lit(a).alias("alias"), key(F.lit(a)).alias("akey")) for a in group]).alias("members")) for g, group in enumerate(T.ALIAS_GROUPS)])
    touched = F.filter(listed, lambda g: F.exists(g["members"], lambda m: F.contains(F.col("qkey"), m["akey"])))
    added = F.filter(F.flatten(F.transform(touched, lambda g: g["members"])), lambda m: ~F.contains(F.col("qkey"), m["akey"]))
    out = rows.withColumn("aliases", F.array_distinct(F.transform(added, lambda m: m["alias"])))
    return out.select("query_id", "query", "aliases", F.when(F.size("aliases") > 0, F.concat_ws(" ", "query", F.array_join("aliases", " "))).otherwise(F.col("query")).alias("expanded"))


def alias_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expanded_queries(search_queries(spark, sf_dir)).select("query_id", F.array_join("aliases", "|").alias("aliases"), "expanded")


def path_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("source_path")
    rows = load(spark, sf_dir, "code_chunks").select("page_index", "source_path").distinct()
    return rows.select("page_index", "source_path", T.file_name(path).alias("name"), T.file_stem(path).alias("stem"), T.file_ending(path).alias("ending"), T.path_depth(path).alias("depth"))


def language_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return documents(spark, sf_dir).groupBy("language_id", T.language_of(path).alias("by_ending")).agg(F.count("*").alias("documents"))


def unsafe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "pack_entries").select("entry_id", "source").distinct()
    return rows.select("entry_id", "source", T.unsafe_path(F.col("source")).alias("unsafe"))


def doc_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = field_words(documents(spark, sf_dir))
    return rows.select("doc_id", F.array_join("path_words", " ").alias("path_words"), F.array_join("stem_words", " ").alias("stem_words"), F.size("identifier_words").alias("identifiers"), F.array_join("structure_words", " ").alias("structure_words"))


def term_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_positions(documents(spark, sf_dir)).groupBy("doc_id", "word").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("kept"))


def snippet_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(F.substring("text", 1, 2000)).alias("head_md5"), F.least(F.lit(2000), F.length("text")).alias("chars"))


def windowed_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rank.bm25(space(spark, sf_dir), k=3)
    rows = found.join(documents(spark, sf_dir).select("doc_id", "text"), "doc_id").join(search_queries(spark, sf_dir).select("query_id", "query"), "query_id")
    return rows.select("query_id", "rank", "doc_id", T.windowed_snippet(F.substring("text", 1, 2000), T.snippet_terms("query"), 240).alias("snippet"))


def literal_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold the literal ``checksum`` in any case, with the place of its first match."""
    docs = documents(spark, sf_dir).where(F.contains(F.lower("text"), F.lit("checksum")))
    return docs.select("doc_id", F.instr(F.lower("text"), F.lit("checksum")).alias("at"))


def literal_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).where(F.contains(F.lower("text"), F.lit("checksum"))).withColumn("at", F.instr(F.lower("text"), F.lit("checksum")))
    begin = F.greatest(F.lit(1), F.col("at") - 240)
    return rows.select("doc_id", F.substring(F.col("text"), begin, F.col("at") + 8 + 240 - begin).alias("snippet"))


def html_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = documents(spark, sf_dir).select("doc_id", F.explode(T.lower_all("</?[A-Za-z][A-Za-z0-9]*", "text")).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("occurrences"), F.count_distinct("doc_id").alias("documents"))


def lexical_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Java-like tokens of every chunk of code; their concatenation gives the text back."""
    rows = load(spark, sf_dir, "code_chunks").where("text is not null").select("id", "text").distinct()
    tokens = F.regexp_extract_all("text", F.lit(T.JAVA_TOKEN), F.lit(0))
    return rows.select("id", F.size(tokens).alias("tokens"), (F.array_join(tokens, "") == F.col("text")).alias("lossless"))


def word_case_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = documents(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w"))
    kind = F.when(F.col("w") == F.lower("w"), "lower").when((F.col("w") == F.upper("w")) & (F.length("w") > 1), "upper").when(F.col("w") == F.initcap("w"), "capital").otherwise("mixed")
    return words.groupBy(kind.alias("case")).agg(F.count("*").alias("words"))


def title_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = documents(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(T.raw_terms("title"))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def path_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    words = documents(spark, sf_dir).select("doc_id", F.explode(path_words(path)).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def title_fallback_frame(found: index.TextIndex, queries: DataFrame, k: int = 10) -> DataFrame:
    """Documents by the query's code words in their paths: most matches, then rarest words, then smallest id."""
    stop = T.literals(T.STOPWORDS)
    wanted = materialize(queries.select("query_id", F.explode(F.array_except(T.code_words(F.col("query")), stop)).alias("term")), "path-words")
    places = found.table("paths").join(broadcast_if_small(wanted.select("term").distinct()), "term", "left_semi")
    n = found.table("documents").count()
    weight = materialize(places.groupBy("term").agg((1 + index.inverse_frequency(F.lit(float(n)), F.count("*"))).alias("w")), "path-weights")
    numbers = materialize(queries.select("query_id").distinct().coalesce(1).withColumn("qn", F.monotonically_increasing_id()), "path-numbers")
    weighed = materialize(wanted.join(broadcast_if_small(weight), "term").join(broadcast_if_small(numbers), "query_id").select("qn", "term", "w"), "weighed")
    greatest = weighed.groupBy("qn").agg(F.sum("w").alias("w")).agg(F.max("w")).first()[0] or 0.0
    # a match counts more than all weights together: one sum holds both, and a power of two costs no digits
    match = float(1 << (int(greatest) + 1).bit_length())
    sums = blocks.best(weighed.select("qn", "term", (F.col("w") + match).alias("w")), places.select("term", "doc_id", F.lit(1.0).alias("c")), n, k)
    ranked = rank.top(sums, k, key="qn").join(broadcast_if_small(numbers), "qn")
    matched = F.floor(F.col("score") / match)
    return ranked.select("query_id", "rank", "doc_id", matched.alias("matched"), F.round(F.col("score") - matched * match, 6).alias("score"))


def title_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return title_fallback_frame(text_index(spark, sf_dir), search_queries(spark, sf_dir)).select("query_id", "rank", "doc_id", "matched", "score")


QUERIES = {
    f.__name__: f
    for f in (
        scan_nonblank, fixed_chunks, token_windows, chunk_maxpool, code_words, stem_aliases, text_variants, alias_expand, path_features, language_lookup, unsafe_paths, doc_fields, term_positions,
        snippet_head, windowed_snippet, literal_search, literal_snippet, html_tag_counts, lexical_tokens, word_case_counts, title_index, path_index, title_fallback,
    )
}


def words_sql(text: str) -> str:
    """Code words of a text expression, sorted and distinct."""
    joined = f"array_to_string(regexp_extract_all(coalesce({text}, ''), '[A-Za-z_][A-Za-z0-9_]{{1,}}'), ' ')"
    spaced = f"regexp_replace(regexp_replace({joined}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({spaced}), '[a-z0-9]+'), lambda w: length(w) >= 2 AND NOT regexp_full_match(w, '[0-9]+'))))"


def clean_sql(path: str) -> str:
    return f"regexp_replace(replace(coalesce({path}, ''), '\\', '/'), '^(\\./)+', '')"


def name_sql(path: str) -> str:
    return f"regexp_extract({clean_sql(path)}, '([^/]*)$', 1)"


def ending_sql(path: str) -> str:
    return f"lower(regexp_extract({name_sql(path)}, '^.+(\\.[^./]+)$', 1))"


def stem_sql(path: str) -> str:
    return f"CASE WHEN {ending_sql(path)} <> '' THEN regexp_extract({name_sql(path)}, '^(.+)\\.[^./]+$', 1) ELSE {name_sql(path)} END"


def parts_sql(path: str) -> str:
    return f"list_filter(string_split({clean_sql(path)}, '/'), lambda p: p <> '')"


def path_words_sql(path: str) -> str:
    return words_sql(f"(array_to_string({parts_sql(path)}, ' ') || ' ' || ({stem_sql(path)}))")


def separated_sql(text: str) -> str:
    out = f"regexp_replace(regexp_replace({text}, '[’‘]', '''', 'g'), '([A-Za-z]+)''s\\b', '\\1', 'g')"
    for pattern, to in (("([A-Za-z])''([A-Za-z])", "\\1\\2"), ("[_\\-./\\\\:]+", " "), ("([A-Z])([A-Z][a-z])", "\\1 \\2"), ("([a-z0-9])([A-Z])", "\\1 \\2"), ("([A-Za-z])([0-9])", "\\1 \\2"), ("([0-9])([A-Za-z])", "\\1 \\2")):
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"trim(regexp_replace(lower({out}), '\\s+', ' ', 'g'))"


_KEY = "' ' || array_to_string(list_transform(regexp_extract_all({0}, '[A-Za-z0-9]+'), lambda x: lower(x)), ' ') || ' '"
_GROUPS = ", ".join(f"({g}, {i}, '{a}')" for g, group in enumerate(T.ALIAS_GROUPS) for i, a in enumerate(group))
_ENDINGS = ", ".join(f"'{k}': {v}" for k, v in T.ENDINGS.items())
_TITLE, _PATH = "coalesce(title, '')", "coalesce(path, '')"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"

ORACLE = {
    "scan_nonblank": "WITH" + DOCS + " SELECT doc_id, coalesce(title, path, '') AS title, length(text) AS chars, strlen(text) AS bytes FROM docs WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''",
    "fixed_chunks": "WITH" + DOCS + """, b AS (SELECT doc_id, coalesce(title, '') || chr(10) || chr(10) || text AS body FROM docs),
c AS (SELECT doc_id, body, unnest(range(0, 1 + ceil(greatest(0, length(body) - 1800) / 1620)::BIGINT)) AS chunk_index FROM b)
SELECT doc_id, chunk_index::INT AS chunk_index, md5(substring(body, chunk_index * 1620 + 1, 1800)) AS chunk_md5 FROM c""",
    "token_windows": "WITH" + DOCS + f""", b AS (SELECT doc_id, {TERMS.format("text")} AS terms FROM docs),
c AS (SELECT doc_id, terms, unnest(range(0, 1 + ceil(greatest(0, len(terms) - 180) / 80)::BIGINT)) AS window_index FROM b),
d AS (SELECT doc_id, window_index::INT AS window_index, terms[window_index * 80 + 1 : window_index * 80 + 180] AS w FROM c)
SELECT doc_id, window_index, len(w) AS terms, md5(array_to_string(w, ' ')) AS window_md5 FROM d""",
    "chunk_maxpool": f"""WITH ch AS (SELECT id, page_index, any_value(text) AS text FROM code_chunks WHERE text IS NOT NULL GROUP BY id, page_index),
t AS (SELECT DISTINCT id, page_index, unnest({TERMS.format("text")}) AS term FROM ch),
qt AS (SELECT DISTINCT id AS query_id, unnest({TERMS.format("query")}) AS term FROM labelled_queries),
s AS (SELECT query_id, id, page_index, count(*) AS score FROM qt JOIN t USING (term) GROUP BY ALL),
p AS (SELECT query_id, page_index, max(score) AS score FROM s GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_index) AS rank, page_index, score FROM p QUALIFY rank <= 5""",
    "code_words": "WITH" + DOCS + f" SELECT doc_id, len(w) AS words, md5(array_to_string(w, ' ')) AS words_md5 FROM (SELECT doc_id, {words_sql('text')} AS w FROM docs)",
    "stem_aliases": "WITH" + DOCS + f""", v AS (SELECT DISTINCT unnest({TERMS.format("text")}) AS term FROM docs),
s AS (SELECT term, left(term, length(term) - 3) || 'y' AS alias FROM v WHERE term LIKE '%ies' AND length(term) > 4
 UNION SELECT term, left(term, length(term) - 1) FROM v WHERE term LIKE '%ers' AND length(term) > 4
 UNION SELECT term, left(term, length(term) - 1) FROM v WHERE term LIKE '%s' AND term NOT LIKE '%ss' AND length(term) > 3
 UNION SELECT term, left(term, length(term) - 3) FROM v WHERE term LIKE '%ing' AND length(term) > 5
 UNION SELECT term, left(term, length(term) - 4) FROM v WHERE term LIKE '%ing' AND length(term) > 5 AND length(term) - 3 > 2 AND substring(term, length(term) - 3, 1) = substring(term, length(term) - 4, 1)
 UNION SELECT term, left(term, length(term) - 3) || 'e' FROM v WHERE term LIKE '%ing' AND length(term) > 5
 UNION SELECT term, left(term, length(term) - 2) FROM v WHERE term LIKE '%ed' AND length(term) > 4
 UNION SELECT term, left(term, length(term) - 2) || 'e' FROM v WHERE term LIKE '%ed' AND length(term) > 4)
SELECT DISTINCT term, alias FROM s WHERE alias <> term AND alias IN (SELECT term FROM v)""",
    "text_variants": "WITH" + DOCS + f" SELECT doc_id, md5({separated_sql(_TITLE)}) AS title_md5, md5({separated_sql(_PATH)}) AS path_md5 FROM docs",
    "alias_expand": f"""WITH a(g, nr, alias) AS (VALUES {_GROUPS}), ak AS (SELECT *, {_KEY.format("alias")} AS akey FROM a),
q AS (SELECT id AS query_id, query, {_KEY.format("query")} AS qkey FROM labelled_queries),
hit AS (SELECT DISTINCT query_id, g FROM q JOIN ak ON contains(qkey, akey)),
added AS (SELECT query_id, alias, min(g * 100 + nr) AS o FROM hit JOIN ak USING (g) JOIN q USING (query_id) WHERE NOT contains(qkey, akey) GROUP BY ALL),
l AS (SELECT query_id, list(alias ORDER BY o) AS aliases FROM added GROUP BY ALL)
SELECT query_id, coalesce(array_to_string(aliases, '|'), '') AS aliases, CASE WHEN aliases IS NULL THEN query ELSE query || ' ' || array_to_string(aliases, ' ') END AS expanded FROM q LEFT JOIN l USING (query_id)""",
    "path_features": f"""SELECT page_index, source_path, {name_sql("source_path")} AS name, {stem_sql("source_path")} AS stem, {ending_sql("source_path")} AS ending, greatest(0, len({parts_sql("source_path")}) - 1) AS depth
FROM (SELECT DISTINCT page_index, source_path FROM code_chunks)""",
    "language_lookup": "WITH" + DOCS + f" SELECT language_id, map_extract_value(MAP {{{_ENDINGS}}}, {ending_sql('path')}) AS by_ending, count(*) AS documents FROM docs GROUP BY ALL",
    "unsafe_paths": """SELECT entry_id, source, (f = '' OR starts_with(f, '/') OR len(list_filter(string_split(f, '/'), lambda p: p IN ('', '.', '..'))) > 0) AS unsafe
FROM (SELECT DISTINCT entry_id, source, replace(coalesce(source, ''), '\\', '/') AS f FROM pack_entries)""",
    "doc_fields": "WITH" + DOCS + f""" SELECT doc_id, array_to_string({path_words_sql("path")}, ' ') AS path_words, array_to_string({words_sql("(" + stem_sql("path") + ")")}, ' ') AS stem_words, len({words_sql("text")}) AS identifiers,
array_to_string({words_sql("array_to_string(list_concat(regexp_extract_all(text, '" + DECLARED + "', 1), regexp_extract_all(text, '" + IMPORTED.replace("'", "''") + "', 1)), ' ')")}, ' ') AS structure_words FROM docs""",
    "term_positions": "WITH" + DOCS + f""", i AS (SELECT doc_id, unnest(l) AS identifier, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{1,}}') AS l FROM docs)),
w AS (SELECT doc_id, pos, unnest({words_sql("identifier")}) AS word FROM i),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, word ORDER BY pos) AS rn FROM w QUALIFY rn <= 8)
SELECT doc_id, word, min(pos) AS first, max(pos) AS last, count(*) AS kept FROM k GROUP BY ALL""",
    "snippet_head": "WITH" + DOCS + " SELECT doc_id, md5(substring(text, 1, 2000)) AS head_md5, least(2000, length(text)) AS chars FROM docs",
    "literal_search": "WITH" + DOCS + " SELECT doc_id, instr(lower(text), 'checksum') AS at FROM docs WHERE contains(lower(text), 'checksum')",
    "literal_snippet": "WITH" + DOCS + " SELECT doc_id, substring(text, greatest(1, p - 240), p + 248 - greatest(1, p - 240)) AS snippet FROM (SELECT *, instr(lower(text), 'checksum') AS p FROM docs) WHERE p > 0",
    "html_tag_counts": "WITH" + DOCS + " SELECT tag, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '</?[A-Za-z][A-Za-z0-9]*'))) AS tag FROM docs) GROUP BY tag",
    "lexical_tokens": "SELECT id, len(t) AS tokens, array_to_string(t, '') = text AS lossless FROM (SELECT id, text, regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+|\\s+|[^A-Za-z0-9_$\\s]') AS t FROM (SELECT DISTINCT id, text FROM code_chunks WHERE text IS NOT NULL))",
    "word_case_counts": "WITH" + DOCS + """, w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM docs)
SELECT CASE WHEN w = lower(w) THEN 'lower' WHEN w = upper(w) AND length(w) > 1 THEN 'upper' WHEN w = upper(left(w, 1)) || lower(substring(w, 2)) THEN 'capital' ELSE 'mixed' END AS "case", count(*) AS words FROM w GROUP BY 1""",
    "title_index": "WITH" + DOCS + f" SELECT term, count(*) AS documents, min(doc_id) AS first, max(doc_id) AS last FROM (SELECT DISTINCT doc_id, unnest({TERMS.format('title')}) AS term FROM docs) GROUP BY term",
    "path_index": "WITH" + DOCS + f" SELECT term, count(*) AS documents, min(doc_id) AS first, max(doc_id) AS last FROM (SELECT doc_id, unnest({path_words_sql('path')}) AS term FROM docs) GROUP BY term",
    "title_fallback": "WITH" + DOCS + f""", q AS (SELECT id AS query_id, unnest(list_filter({words_sql("query")}, lambda w: NOT list_contains({_STOP}, w))) AS term FROM labelled_queries),
p AS (SELECT doc_id, unnest({path_words_sql("path")}) AS term FROM docs), n AS (SELECT count(*) AS n FROM docs),
w AS (SELECT term, 1 + ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1) AS w FROM p, n GROUP BY term, n),
s AS (SELECT query_id, doc_id, count(*) AS matched, round(sum(w), 6) AS score FROM q JOIN p USING (term) JOIN w USING (term) GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, score DESC, doc_id) AS rank, doc_id, matched, score FROM s QUALIFY rank <= 10""",
}
ORACLE["windowed_snippet"] = (
    "WITH"
    + SPACE
    + ", r AS (SELECT * FROM "
    + bm25_sql(k=3)
    + """), t AS (SELECT r.query_id, rank, doc_id, trim(substring(text, 1, 2000), ' ') AS body, list_transform(regexp_extract_all(query, '[A-Za-z0-9_]{2,}'), lambda x: lower(x)) AS terms FROM r JOIN docs USING (doc_id) JOIN labelled_queries q ON q.id = r.query_id),
a AS (SELECT *, length(body) AS size, greatest(0, coalesce(list_min(list_filter(list_transform(terms, lambda x: instr(lower(body), x)), lambda p: p > 0)) - 1, 0) - 80) AS b0 FROM t),
b AS (SELECT *, least(size, b0 + 240) AS e FROM a),
c AS (SELECT *, CASE WHEN e - b0 < 240 THEN greatest(0, e - 240) ELSE b0 END AS s FROM b),
d AS (SELECT *, CASE WHEN s > 0 THEN '...' ELSE '' END AS pre, CASE WHEN e < size THEN '...' ELSE '' END AS post, trim(substring(body, s + 1, e - s), ' ') AS body2 FROM c)
SELECT query_id, rank, doc_id, CASE WHEN size <= 240 THEN body ELSE pre || substring(body2, 1, 240 - length(pre) - length(post)) || post END AS snippet FROM d"""
)
