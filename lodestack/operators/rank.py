"""Ranking: BM25 and its variants, cosines, fusion, selective candidates, fallback.

Every function takes a :class:`~lodestack.operators.index.SearchSpace` and returns rows by query.
Scores are rounded to six digits before ranking and ties go to the smaller document id, so results do
not depend on the order of summation.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.operators import blocks
from lodestack.operators.index import SEGMENT, SearchSpace, TextIndex
from lodestack.session import broadcast_if_small, materialize


def top(scores: DataFrame, k: int, score: str = "score", key: str = "query_id") -> DataFrame:
    """The ``k`` best rows of each query with their ``rank``; Spark limits each task's groups first."""
    order = Window.partitionBy(key).orderBy(F.desc(score), F.asc("doc_id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25_term(idf: Column, tf: Column, dl: Column, avgdl: float, k1: float, b: float) -> Column:
    norm = F.lit(1.0) - b + (dl * b / avgdl if avgdl else F.lit(b))
    return idf * tf * (k1 + 1) / (tf + norm * k1)


def matches(space: SearchSpace, max_df_ratio: float | None = None) -> DataFrame:
    """``(query_id, qtf, term, doc_id, dl, tf, df, df_ratio, idf)`` of every query term in every document."""
    idf = space.idf if max_df_ratio is None else space.idf.where(F.col("df_ratio") <= max_df_ratio)
    wanted = materialize(space.query_terms.join(broadcast_if_small(idf), "term"), "wanted")
    return space.postings.join(broadcast_if_small(wanted), "term")


#: Pairs of query terms and postings from which :func:`top_sums` sums by blocks of documents.
FLOOR_PAIRS = 1_000_000


def shared_pairs(space: SearchSpace, wanted: DataFrame) -> int:
    """How many pairs of a query's term and a posting there are."""
    counted = wanted.groupBy("term").agg(F.count("*").alias("n")).join(broadcast_if_small(space.idf), "term")
    return counted.agg(F.coalesce(F.sum(F.col("n") * F.col("df")), F.lit(0))).first()[0]


def top_sums(space: SearchSpace, wanted: DataFrame, postings: DataFrame, k: int, floor_pairs: int = FLOOR_PAIRS, first_rows: int = blocks.DOCUMENTS) -> DataFrame:
    """``(query_id, rank, doc_id, score)``: the ``k`` greatest sums of ``w * c``, exactly, rounded to six digits.

    ``wanted`` holds ``qn, term, w`` and ``postings`` ``term, doc_id, c``, none negative.  Up to ``floor_pairs`` pairs that
    share a term are summed as rows.  More are summed in vectors by blocks of ``first_rows`` documents
    (:mod:`lodestack.operators.blocks`); a task's first block gives a floor for each query, under which no sum of later
    ones is kept.
    """
    wanted = materialize(wanted.select("qn", "term", "w"), "weights")
    if shared_pairs(space, wanted) <= floor_pairs:
        hits = postings.join(broadcast_if_small(wanted), "term").select("qn", "doc_id", (F.col("w") * F.col("c")).alias("s"))
        scores = hits.groupBy("qn", "doc_id").agg(F.round(F.sum("s"), 6).alias("score")).where("score > 0")
    else:
        scores = blocks.best(wanted, postings, space.n_docs, k, per_block=first_rows)
    return top(scores, k, key="qn").join(broadcast_if_small(space.numbers), "qn").select("query_id", "rank", "doc_id", "score")


def bm25(space: SearchSpace, k: int = 10, k1: float = 1.5, b: float = 0.75, max_df_ratio: float | None = None, unique_terms: bool = False, title_boost: float = 0.0) -> DataFrame:
    """``(query_id, rank, doc_id, score)``.

    ``title_boost`` is added once per distinct query term in the title and may bring in documents that
    match nowhere else.  ``unique_terms`` ignores how often a query repeats a term.
    """
    idf = space.idf if max_df_ratio is None else space.idf.where(F.col("df_ratio") <= max_df_ratio)
    wanted = space.query_terms.select("qn", "term", (F.lit(1.0) if unique_terms else F.col("qtf").cast("double")).alias("w"))
    part = bm25_term(F.col("idf"), F.col("tf"), F.col("dl"), space.avgdl, k1, b)
    postings = space.postings.join(broadcast_if_small(idf.select("term", "idf")), "term").select("term", "doc_id", part.alias("c"))
    if title_boost:
        allowed = space.query_terms
        if max_df_ratio is not None:
            allowed = materialize(allowed.join(space.idf.where(F.col("df_ratio") > max_df_ratio).select("term"), "term", "left_anti"), "allowed")
        titled = F.concat(F.lit("title:"), "term").alias("term")  # no term has a colon
        wanted = wanted.union(allowed.select("qn", titled, F.lit(1.0)))
        postings = postings.union(space.titles.select(titled, "doc_id", F.lit(float(title_boost))))
    return top_sums(space, wanted, postings, k)


def matched_terms(space: SearchSpace, ranked: DataFrame) -> DataFrame:
    """``ranked`` with the sorted array ``matched`` of the query terms in each document; only postings of ranked documents are paired."""
    ranked = materialize(ranked, "ranked")
    wanted = materialize(ranked.select("query_id", "doc_id").join(broadcast_if_small(space.query_terms.select("query_id", "term")), "query_id"), "ranked-terms")
    pairs = space.postings.select("term", "doc_id").join(broadcast_if_small(wanted), ["term", "doc_id"])
    words = pairs.groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_set("term")).alias("matched"))  # bounded by the query
    return ranked.join(words, ["query_id", "doc_id"], "left")


def candidates(space: SearchSpace) -> DataFrame:
    """``(query_id, candidates)``: how many documents have a term of each query that matches any."""
    found = blocks.matched(space.query_terms, space.postings, space.n_docs)
    return found.join(broadcast_if_small(space.numbers), "qn").select("query_id", F.col("n").alias("candidates"))


def binary_cosine(space: SearchSpace, lengths: DataFrame, k: int = 10) -> DataFrame:
    """Shared distinct terms over the geometric mean of both numbers of distinct terms."""
    sizes = broadcast_if_small(materialize(lengths.select("doc_id", F.col("distinct_terms").alias("d")), "lengths"))
    postings = space.postings.select("term", "doc_id", F.lit(1.0).alias("c")).join(sizes, "doc_id")
    scores = blocks.best(space.query_terms.select("qn", "term", F.lit(1.0).alias("w")), postings, space.n_docs, k, cosine=True)
    return top(scores, k, key="qn").join(broadcast_if_small(space.numbers), "qn").select("query_id", "rank", "doc_id", "score")


def best_owners(space: SearchSpace, owners: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, rank, owner, score)``: owners by their best document in ``owners (doc_id, owner)``, by distinct query terms in it."""
    postings = space.postings.select("term", "doc_id", F.lit(1.0).alias("c")).join(broadcast_if_small(owners), "doc_id")
    scores = blocks.best(space.query_terms.select("qn", "term", F.lit(1.0).alias("w")), postings, space.n_docs, k)
    ranked = top(scores.withColumn("score", F.col("score").cast("long")), k, key="qn").join(broadcast_if_small(space.numbers), "qn")
    return ranked.select("query_id", "rank", F.when(F.col("doc_id") != blocks.NO_OWNER, F.col("doc_id")).alias("owner"), "score")


def tfidf_cosine(space: SearchSpace, docs: DataFrame | TextIndex, k: int = 10) -> DataFrame:
    """Cosine of tf x (ln((1+N)/(1+df)) + 1) vectors; the document norms need all terms."""
    n = float(space.n_docs)
    weight = F.log((n + 1.0) / (F.col("df") + 1.0)) + 1.0
    from lodestack.operators.index import term_freq

    tf = docs.table("postings") if isinstance(docs, TextIndex) else term_freq(docs)
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    norms = tf.join(df, "term").groupBy("doc_id").agg(F.sqrt(F.sum(F.pow(F.col("tf") * weight, 2))).alias("norm"))
    idf = space.idf.select("term", weight.alias("weight"))
    query = materialize(space.query_terms.join(broadcast_if_small(idf), "term").withColumn("w", F.col("qtf") * F.col("weight")), "weighed")
    query_norm = query.groupBy("qn").agg(F.sqrt(F.sum(F.pow("w", 2))).alias("qnorm"))
    wanted = query.join(broadcast_if_small(query_norm), "qn").select("qn", "term", (F.col("w") / F.col("qnorm")).alias("w"))
    postings = space.postings.join(broadcast_if_small(idf), "term").join(norms, "doc_id")
    return top_sums(space, wanted, materialize(postings.select("term", "doc_id", (F.col("tf") * F.col("weight") / F.col("norm")).alias("c")), "cosines"), k)


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = 10, constant: int = 60) -> DataFrame:
    """Sum of 1/(constant + rank) over ranked lists ``(query_id, rank, doc_id)``."""
    rows = lists[0].select("query_id", "rank", "doc_id")
    for other in lists[1:]:
        rows = rows.union(other.select("query_id", "rank", "doc_id"))
    summed = rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (F.lit(constant) + F.col("rank"))), 6).alias("score"))
    return top(summed, k).select("query_id", "rank", "doc_id", "score")


def token_types(space: SearchSpace) -> DataFrame:
    """``(query_id, term, df, df_ratio, kind)``: missing, rare, common, identifier/path or text."""
    stats = space.query_terms.join(broadcast_if_small(space.idf), "term", "left").fillna(0, ["df"]).fillna(0.0, ["df_ratio", "idf"])
    titled = materialize(space.titles.select("term").distinct().withColumn("titled", F.lit(True)), "titled")
    stats = stats.join(broadcast_if_small(titled), "term", "left")
    codelike = F.col("term").rlike(r"^[A-Za-z0-9_]*([A-Za-z][A-Za-z0-9_]*[0-9]|[0-9][A-Za-z0-9_]*[A-Za-z])[A-Za-z0-9_]*$|[_./\\-]")
    kind = (
        F.when(F.col("df") == 0, "missing")
        .when(F.col("df_ratio") <= 0.05, "rare")
        .when(F.col("df_ratio") > 0.10, "common")
        .when(codelike | F.coalesce("titled", F.lit(False)), "identifier/path")
        .otherwise("text")
    )
    return stats.select("query_id", "qn", "term", "qtf", "df", "df_ratio", "idf", kind.alias("kind"))


def list_heads(postings: DataFrame, cap: int, segment: int = SEGMENT) -> DataFrame:
    """``(term, doc_id)``: the first ``cap`` documents of every posting list.

    A list is cut into segments of document ids, which are numbered apart; only the segments' sizes are
    summed along a whole list.
    """
    rows = postings.select("term", "doc_id", F.expr(f"doc_id DIV {segment}").alias("segment"))
    inside = rows.withColumn("at", F.row_number().over(Window.partitionBy("term", "segment").orderBy("doc_id"))).where(F.col("at") <= cap)
    along = Window.partitionBy("term").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    begun = rows.groupBy("term", "segment").agg(F.count("*").alias("n")).select("term", "segment", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before")).where(F.col("before") < cap)
    return inside.join(begun, ["term", "segment"]).where(F.col("before") + F.col("at") <= cap).select("term", "doc_id")


def selective_search(space: SearchSpace, k: int = 10, cap: int = 2000, floor: float = 0.35, drop: float = 0.05, title_boost: float = 1.0, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 over candidates gathered from the rarest terms first.

    A term weighs idf / ln(N + 1), at least ``floor`` if it is rare or an identifier; terms below
    ``drop`` gather nothing.  Posting lists are walked from the greatest weight on and the walk stops
    with the row at which ``cap`` different documents are reached.  Candidates gathered ``floor`` in
    total and are scored over all gathering terms, each BM25 part times its weight.

    Of the walk only the place where it stops matters (:func:`walk_ends`); what each document gathers up to there, and
    its score, are then summed by blocks of documents.
    """
    kinds = token_types(space)
    strong = F.col("kind").isin("rare", "identifier/path")
    scale = max(1.0, math.log(space.n_docs + 1))
    weight = F.when(F.col("df") == 0, 0.0).when(strong, F.greatest(F.lit(floor), F.col("idf") / scale)).otherwise(F.col("idf") / scale)
    terms = kinds.withColumn("w", weight).where(F.col("w") >= drop)
    order = Window.partitionBy("qn").orderBy(F.desc(F.round("w", 9)), "df", F.desc(F.round("idf", 9)), "term")
    terms = materialize(terms.withColumn("turn", F.row_number().over(order)).select("qn", "term", "w", "df", "turn"), "turns")
    ends = broadcast_if_small(walk_ends(terms, space.postings, cap))
    last = F.when(F.col("end_turn").isNull() | (F.col("turn") < F.col("end_turn")), LAST).when(F.col("turn") == F.col("end_turn"), F.col("end_doc")).otherwise(-LAST)
    wanted = terms.join(ends, "qn", "left").select("qn", "term", "w", F.col("w").alias("g"), last.cast("long").alias("upto"))
    part = bm25_term(F.col("idf"), F.col("tf"), F.col("dl"), space.avgdl, k1, b)
    postings = space.postings.join(broadcast_if_small(space.idf.select("term", "idf")), "term").select("term", "doc_id", part.alias("c"))
    if title_boost:
        titled = F.concat(F.lit("title:"), "term").alias("term")  # no term has a colon
        wanted = wanted.union(terms.select("qn", titled, F.lit(1.0), F.lit(0.0), F.lit(-LAST)))
        postings = postings.union(space.titles.select(titled, "doc_id", F.lit(float(title_boost))))
    scores = blocks.gathered(materialize(wanted, "gathering"), postings, space.n_docs, k, floor)
    return top(scores, k, key="qn").join(broadcast_if_small(space.numbers), "qn").select("query_id", "rank", "doc_id", "score")


#: Above all document ids.
LAST = (1 << 63) - 1


def walk_ends(terms: DataFrame, postings: DataFrame, cap: int, queries: int = 1000) -> DataFrame:
    """``(qn, end_turn, end_doc)``: the turn and document with which a walk has met ``cap`` different documents; no row if it never has.

    ``terms`` holds ``qn, term, df, turn``.  A list of ``cap`` documents ends any walk, so turns after the first such list are
    left out, and of each list the first ``cap`` documents are enough.  About ``queries`` queries at a time are walked in a
    task, which is sent the heads of their lists once.
    """
    order = Window.partitionBy("qn").orderBy("turn")
    before = F.coalesce(F.max("df").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("df").over(Window.partitionBy("qn"))
    walks = materialize(terms.withColumn("before", before).withColumn("whole", whole).where((F.col("whole") >= cap) & (F.col("before") < cap)).select("qn", "turn", "term"), "walks")
    groups = max(terms.sparkSession.sparkContext.defaultParallelism, math.ceil(walks.select("qn").distinct().count() / queries))
    walks = walks.withColumn("walk", F.pmod(F.xxhash64("qn"), F.lit(groups)))
    heads = list_heads(postings.join(broadcast_if_small(walks.select("term").distinct()), "term", "left_semi"), cap)
    listed = heads.groupBy("term").agg(F.array_sort(F.collect_list("doc_id")).alias("docs"))  # at most ``cap``
    needed = listed.join(walks.select(F.col("walk").alias("of_walk"), "term").distinct(), "term")

    def walk(mine: pa.Table, lists: pa.Table) -> pa.Table:
        docs = lists.column("docs").combine_chunks()
        docs = docs if isinstance(docs, pa.Array) else pa.concat_arrays(docs.chunks)
        starts, ids = np.append(0, np.cumsum(np.asarray(docs.value_lengths()))).tolist(), np.asarray(docs.flatten())
        known, at = np.unique(ids, return_inverse=True)
        place = {term: (at[a:b], ids[a:b]) for term, a, b in zip(lists.column("term").to_pylist(), starts[:-1], starts[1:], strict=True)}
        met = np.full(len(known), -1, np.int64)
        out, query, seen = [], None, cap
        for qn, turn, term in zip(*(mine.sort_by([("qn", "ascending"), ("turn", "ascending")]).column(c).to_pylist() for c in ("qn", "turn", "term")), strict=True):
            if qn != query:
                query, seen = qn, 0
            if seen >= cap:
                continue
            spots, docs_of = place[term]
            fresh = np.flatnonzero(met[spots] != qn)
            if seen + len(fresh) >= cap:
                out.append((qn, turn, int(docs_of[fresh[cap - seen - 1]])))
            else:
                met[spots] = qn
            seen += len(fresh)
        columns = list(zip(*out, strict=True)) if out else [()] * 3
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["qn", "end_turn", "end_doc"])

    found = walks.groupBy("walk").cogroup(needed.groupBy("of_walk")).applyInArrow(walk, "qn long, end_turn long, end_doc long")
    return materialize(found, "ends")


def merge_first(primary: DataFrame, *others: DataFrame, k: int = 10) -> DataFrame:
    """Ranked lists one after the other; a document keeps its first place."""
    rows = primary.select("query_id", "doc_id", "rank", F.lit(0).alias("source"))
    for number, other in enumerate(others, 1):
        rows = rows.union(other.select("query_id", "doc_id", "rank", F.lit(number).alias("source")))
    first = rows.groupBy("query_id", "doc_id").agg(F.min(F.struct("source", "rank")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at", "doc_id")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", F.col("at.source").alias("source"))
