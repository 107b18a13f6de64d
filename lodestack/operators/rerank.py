"""Feature re-ranking of short candidate lists: path, file name, identifiers, intent.

Only the words of the candidates' documents are computed; they are joined to the ranked rows after the
cut, and everything else is array arithmetic on those rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import text as T

# Word sets that express an intent, file names of a kind, and weights.
TEST_INTENT = ("test", "tests", "broken", "fails", "failure", "regression", "tampered")
CODE_INTENT = ("code", "function", "class", "implementation", "where", "sign", "verify", "url", "json")
PACKAGING_INTENT = ("setup", "entry", "point", "cli", "command", "pyproject", "script", "scripts")
GITHUB_INTENT = ("github", "issue", "pull", "workflow", "ci", "template", "action", "actions")
CONFIG_ENDINGS = (".md", ".json", ".yaml", ".yml", ".toml")
CONFIG_NAMES = (".mcp.json", "docker-compose.yml", "hooks.codex.json", "hooks.json", "package.json", "plugin.json")
GENERIC_DOCS = ("changelog.md", "contributing.md", "readme.md", "roadmap.md")
GENERIC_DOC_INTENT = ("changelog", "changes", "contributing", "readme", "roadmap")
ADVISORY_INTENT = ("advisory", "cve", "xss", "traversal", "vulnerability")
ENVIRONMENTS = ("dev", "development", "lite", "local", "memory", "prod", "production", "root", "staging")
NESTED_INTENT = ("app", "src", "tauri", "src-tauri", "nested", "package", "workspace")
ROOT_CONFIGS = ("cargo.toml", "package.json", "pyproject.toml", "tsconfig.json")
BASE = {"path": 1.2, "filename": 0.6, "identifier": 0.9, "structure": 1.5, "proximity": 0.6}
CODERAG = BASE | {"filename": 2.8}
#: Candidates that each profile ranks again.
PROFILES = {"off": 0, "none": 0, "fast": 10, "balanced": 25, "accurate": 50, "quality": 50}


def _common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double")


def _any(a: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(a, T.literals(words))


def _when(condition: Column, value) -> Column:  # noqa: ANN001
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.lit(0.0)).cast("double")


def query_words(query: Column) -> Column:
    """Code words of a query without stop words; its plain words if it has none."""
    words = T.code_words(query)
    words = F.when(F.size(words) > 0, words).otherwise(F.array_sort(T.snippet_terms(query)))
    return F.array_except(words, T.literals(T.STOPWORDS))


def proximity(candidates: DataFrame, positions: DataFrame, weight: float) -> DataFrame:
    """``(query_id, doc_id, proximity)``: full weight for query words up to 3 identifiers apart, half up to 12.

    ``candidates`` holds ``query_id, doc_id, q`` (the query's words), ``positions`` at most eight places of
    each word of a document.
    """
    wanted = candidates.select("query_id", "doc_id", F.explode("q").alias("word"))
    places = positions.join(wanted, ["doc_id", "word"])
    order = Window.partitionBy("query_id", "doc_id").orderBy("pos", "word")
    gaps = places.withColumn("gap", F.col("pos") - F.lag("pos").over(order)).groupBy("query_id", "doc_id").agg(F.min("gap").alias("gap"))
    value = F.when(F.col("gap") <= 3, weight).when(F.col("gap") <= 12, weight / 2).otherwise(0.0)
    return gaps.select("query_id", "doc_id", value.alias("proximity"))


def gap_between(words: Column, places: Column) -> Column:
    """The least distance between two places of ``words`` in a map of places by word; null if there are no two."""
    at = F.array_sort(F.flatten(F.filter(F.transform(words, lambda w: F.try_element_at(places, w)), lambda p: p.isNotNull())))
    return F.aggregate(at, F.struct(F.lit(None).cast("int").alias("last"), F.lit(None).cast("int").alias("gap")), lambda s, p: F.struct(p.alias("last"), F.least(s["gap"], p - s["last"]).alias("gap")))["gap"]


def features(ranked: DataFrame, queries: DataFrame, fields: DataFrame, positions: DataFrame, coderag: bool = True) -> DataFrame:
    """``(query_id, doc_id, rank, <one column per feature>)`` of every ranked row.

    ``queries`` holds ``query_id, expanded``; ``fields`` the word arrays and the path of every document.
    """
    rows = ranked.select("query_id", "doc_id", "rank").join(fields, "doc_id").join(queries.select("query_id", query_words(F.col("expanded")).alias("q")), "query_id")
    weights = CODERAG if coderag else BASE
    near = proximity(rows.select("query_id", "doc_id", "q"), positions, weights["proximity"])
    return featured(rows.join(near, ["query_id", "doc_id"], "left"), coderag)


def features_at(asked: DataFrame, fields: DataFrame, coderag: bool = True) -> DataFrame:
    """:func:`features` of ranked rows ``asked`` with the query's words ``q``; ``fields`` has a map ``places`` of word positions too.

    Of identifiers, structure and places only words of some query are needed.  No row is shuffled after the join.
    """
    rows = fields.join(asked.select("query_id", "doc_id", "rank", "q"), "doc_id").withColumn("gap", gap_between(F.col("q"), F.col("places")))
    weight = (CODERAG if coderag else BASE)["proximity"]
    return featured(rows.withColumn("proximity", F.when(F.col("gap") <= 3, weight).when(F.col("gap") <= 12, weight / 2).otherwise(0.0)), coderag)


def featured(rows: DataFrame, coderag: bool) -> DataFrame:
    """The features of rows with the words of query and document and their ``proximity``."""
    weights = CODERAG if coderag else BASE
    q, path, stem, name, body = (F.col(c) for c in ("q", "path_words", "stem_words", "name_words", "identifier_words"))
    file, ending, depth = F.lower(T.file_name(F.col("path"))), T.file_ending(F.col("path")), T.path_depth(F.col("path"))
    stem_hits = _common(q, stem)
    whole_stem = (F.size(stem) > 0) & (stem_hits == F.size(stem))
    out = {
        "path": weights["path"] * _common(q, path),
        "filename": weights["filename"] * _common(q, F.array_union(stem, name)),
        "identifier": weights["identifier"] * _common(q, body),
        "structure": weights["structure"] * _common(q, F.col("structure_words")),
        "proximity": F.coalesce("proximity", F.lit(0.0)),
        "test_path_intent": _when(_any(q, TEST_INTENT) & F.array_contains(path, "tests"), 4.0),
        "src_path_intent": _when(_any(q, CODE_INTENT) & F.array_contains(path, "src"), 4.0),
        "packaging_path_intent": _when(_any(q, PACKAGING_INTENT) & _any(path, ("pyproject", "setup", "scripts")), 4.0),
        "metadata_penalty": _when(F.array_contains(path, "github") & ~_any(q, GITHUB_INTENT), -2.0),
    }
    if coderag:
        env_q, env_name = F.array_intersect(q, T.literals(ENVIRONMENTS)), F.array_intersect(name, T.literals(ENVIRONMENTS))
        specific = F.filter(F.array_except(q, T.literals(CODE_INTENT)), lambda w: F.length(w) >= 4)
        nested, config = _any(q, NESTED_INTENT), file.isin(*ROOT_CONFIGS)
        out |= {
            "exact_stem": _when(whole_stem, 5.0),
            "stem_terms": _when(~whole_stem, 2.5 * stem_hits),
            "dotfile_intent": _when(file.startswith(".") & (stem_hits > 0), 5.0),
            "env_filename_match": 4.0 * _common(env_q, env_name),
            "env_filename_mismatch": -4.0 * F.size(F.array_except(env_name, env_q)).cast("double"),
            "specific_filename_mismatch": _when((F.size(specific) > 0) & ~F.arrays_overlap(name, specific) & (F.size(env_name) > 0), -3.0),
            "root_config_intent": _when(config & (depth == 0) & (F.array_contains(q, "root") | ~nested), 4.0),
            "nested_config_penalty": _when(config & (depth > 0) & ~nested, -3.0 * F.least(depth, F.lit(3))),
            "config_doc_intent": _when((ending.isin(*CONFIG_ENDINGS) | file.isin(*CONFIG_NAMES)) & ((_common(q, path) > 0) | (_common(q, F.array_union(stem, name)) > 0)), 5.0),
            "explicit_src_path": _when(F.array_contains(q, "src") & F.array_contains(path, "src"), 3.0),
            "benchmark_path_penalty": _when(F.array_contains(path, "benchmark") & ~F.array_contains(q, "benchmark"), -3.0),
            "generic_doc_penalty": _when(file.isin(*GENERIC_DOCS) & ~_any(F.array_intersect(stem, q), GENERIC_DOC_INTENT), -4.0),
            "generic_advisory_penalty": _when(F.contains(F.lower("path"), F.lit("security-advisories")) & ~_any(q, ADVISORY_INTENT), -4.0),
        }
    ratio = F.round(_common(q, path) / F.greatest(F.lit(1), F.size(path)), 4)
    exact = whole_stem | ((F.size(name) > 0) & (_common(q, name) == F.size(name)))
    tie = F.struct(exact.cast("int").alias("exact"), ratio.alias("ratio"), (-F.size(F.array_except(name, q))).alias("extra"), (-depth).alias("depth"))
    return rows.select("query_id", "doc_id", "rank", *[F.round(v, 6).alias(k) for k, v in out.items()], tie.alias("tie"))


def feature_names(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in ("query_id", "doc_id", "rank", "tie")]


def rerank(rows: DataFrame, k: int = 5, candidates: int = 50) -> DataFrame:
    """``(query_id, rank, doc_id, before, score)``: by features, then file-name fit, then the former rank."""
    total = sum((F.col(c) for c in feature_names(rows)), F.lit(0.0))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("tie"), "before", "doc_id")
    scored = rows.where(F.col("rank") <= candidates).select("query_id", "doc_id", F.col("rank").alias("before"), F.round(total, 6).alias("score"), "tie")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "before", "score")


def explain(rows: DataFrame) -> DataFrame:
    """``(query_id, doc_id, feature, value)`` of every feature that counts."""
    names = feature_names(rows)
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in names])
    return rows.select("query_id", "doc_id", F.explode(F.filter(pairs, lambda p: p["value"] != 0)).alias("p")).select("query_id", "doc_id", "p.feature", "p.value")
