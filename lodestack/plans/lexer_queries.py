"""Registered queries of the lexers: every chunk of code by its language's family, each with the same thing in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import lexers
from lodestack.functions import text as T
from lodestack.plans.evaluation_queries import _LANGUAGE
from lodestack.plans.text_queries import ending_sql
from lodestack.session import load


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, language, text)`` of all chunks with a text; the language goes by the file's ending, else by its id."""
    rows = load(spark, sf_dir, "code_chunks").where("text is not null")
    return rows.select("id", F.coalesce(T.language_of(F.col("source_path")), "language_id", F.lit(-1)).alias("language"), "text").distinct()


def _lossless(rows: DataFrame, tokens) -> DataFrame:  # noqa: ANN001
    rows = rows.withColumn("tokens", tokens)
    return rows.select("id", "language", F.size("tokens").alias("tokens"), F.md5(F.array_join("tokens", "␟")).alias("tokens_md5"), (F.array_join("tokens", "") == F.col("text")).alias("lossless"))


def _ids(family: str) -> list[int]:
    return [i for i, f in lexers.FAMILY_OF.items() if f == family]


def _of(family: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _lossless(chunks(spark, sf_dir).where(F.col("language").isin(*_ids(family))), lexers.tokens(F.col("text"), family))

    query.__name__ = f"lex_{family}"
    return query


def lex_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks, each by the lexer of its language."""
    return _lossless(chunks(spark, sf_dir), lexers.tokens_by_language(F.col("text"), F.col("language")))


def lex_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and characters by family and kind over all chunks."""
    out = None
    rows = chunks(spark, sf_dir)
    for family in lexers.FAMILIES:
        of = F.col("language").isin(*_ids(family))
        some = rows.where(of if family != "prose" else of | ~F.col("language").isin(*lexers.FAMILY_OF))
        # a token that stands many times is classified once
        token = some.select(F.explode(lexers.tokens(F.col("text"), family)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
        part = token.groupBy(lexers.kind_of(F.col("token"), family).alias("kind")).agg(F.sum("n").alias("tokens"), F.sum(F.col("n") * F.length("token")).alias("chars"))
        part = part.select(F.lit(family).alias("family"), "kind", "tokens", "chars")
        out = part if out is None else out.union(part)
    return out


QUERIES = {f.__name__: f for f in (*map(_of, lexers.FAMILIES), lex_dispatch, lex_kinds)}


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_CHUNKS = f"WITH c AS (SELECT DISTINCT id, coalesce({_LANGUAGE.replace('{0}', ending_sql('source_path'))}, language_id, -1) AS language, text FROM code_chunks WHERE text IS NOT NULL)"
_CHECKED = "SELECT id, language, len(t) AS tokens, md5(array_to_string(t, '␟')) AS tokens_md5, array_to_string(t, '') = text AS lossless FROM"


def _extract(family: str) -> str:
    return f"regexp_extract_all(text, {_sql(lexers.pattern(family))})"


def _in(family: str) -> str:
    return f"language IN ({', '.join(map(str, _ids(family)))})"


def _kind_sql(family: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(token, {_sql(f'^(?:{p})$')}) THEN '{k}'" for k, p in lexers.kinds(family)[:-1]) + " ELSE 'other' END"


def _kinds_sql(family: str) -> str:
    where = _in(family) if family != "prose" else f"{_in(family)} OR language NOT IN ({', '.join(map(str, lexers.FAMILY_OF))})"
    return f"SELECT '{family}' AS family, {_kind_sql(family)} AS kind, sum(n)::BIGINT AS tokens, sum(n * length(token))::BIGINT AS chars FROM (SELECT token, count(*) AS n FROM (SELECT unnest({_extract(family)}) AS token FROM c WHERE {where}) GROUP BY token) GROUP BY 2"


ORACLE = {f"lex_{family}": f"{_CHUNKS} {_CHECKED} (SELECT *, {_extract(family)} AS t FROM c WHERE {_in(family)})" for family in lexers.FAMILIES}
ORACLE["lex_dispatch"] = f"{_CHUNKS} {_CHECKED} (SELECT *, CASE " + " ".join(f"WHEN {_in(f)} THEN {_extract(f)}" for f in lexers.FAMILIES if f != "prose") + f" ELSE {_extract('prose')} END AS t FROM c)"
ORACLE["lex_kinds"] = _CHUNKS + " " + " UNION ALL ".join(map(_kinds_sql, lexers.FAMILIES))
