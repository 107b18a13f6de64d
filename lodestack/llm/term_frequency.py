"""Occurrence and record counts of all n-grams from suffix arrays.

Each piece of whole records becomes one array of term codes.  Its suffixes are sorted by prefix doubling
(:class:`Suffixes`): after k rounds by their first 2^k terms, until no round tells two more apart, so to any
depth; a suffix ends with its record.  Runs of neighbours with a common prefix of n terms are the intervals
of one n-gram, for every n.  Walking the sorted suffixes record by record, every neighbour pair of one
record that agrees in n terms is one duplicate; occurrences minus duplicates are records.  A record
never spans pieces, so both counts add up, and Spark merges one row per piece and distinct n-gram:
a term that stands in every record is pre-aggregated before the shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators.records import latest_records

#: A maximal run of at least two letters of ASCII and Latin-1, without × and ÷.
TERM_PATTERN = "[A-Za-zÀ-ÖØ-öø-ÿ]{2,}"
#: Characters of the records that go into one suffix array (a longer record is one by itself); bounds a task's memory.
PIECE = 2_000_000


def term_codes(texts: list[str], pattern: re.Pattern) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of all terms in order, the record of each, and the terms by code."""
    found = [pattern.findall(t) for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat = pa.array(" ".join([" ".join(f) for f in found if f]).lower().split(" ") if sizes.any() else [], pa.string())
    coded = flat.dictionary_encode()
    codes = np.asarray(coded.indices).astype(np.int64)
    return codes, np.repeat(np.arange(len(found)), sizes), coded.dictionary


class Suffixes:
    """The sorted suffixes of the records in an array of term codes.

    ``order`` holds their positions, ``left`` how many terms each position has up to its record's end.
    """

    def __init__(self, codes: np.ndarray, record: np.ndarray):
        size = len(codes)
        ends = np.searchsorted(record, record, side="right")
        self.left = ends - np.arange(size)
        self.order = np.argsort(codes, kind="stable")
        rank, place = np.empty(size, np.int64), np.arange(size)
        self._settle(rank, self.order, codes[self.order], place)
        #: By round k: equal for suffixes whose first 2^k terms, as far as they have them, are equal.
        self.ranks = [rank]
        step = 1
        while True:
            # suffixes alone in their group stay where they are
            sorted_rank = rank[self.order]
            alone = np.ones(size, bool)
            same = sorted_rank[1:] == sorted_rank[:-1]
            alone[1:] &= ~same
            alone[:-1] &= ~same
            place = np.flatnonzero(~alone)
            mine = self.order[place]
            further = np.full(len(mine), -1, np.int64)
            goes_on = self.left[mine] > step
            if not goes_on.any():
                break
            further[goes_on] = rank[mine[goes_on] + step]
            key = rank[mine] * (size + 1) + further + 1
            by_key = np.argsort(key, kind="stable")
            key = key[by_key]
            if np.array_equal(key[1:] != key[:-1], ~(rank[mine][1:] == rank[mine][:-1])):
                break  # nothing told apart: no later round will
            rank = rank.copy()
            self.order[place] = mine[by_key]
            self._settle(rank, self.order[place], key, place)
            self.ranks.append(rank)
            step *= 2

    @staticmethod
    def _settle(rank: np.ndarray, members: np.ndarray, key: np.ndarray, place: np.ndarray) -> None:
        """Rank ``members``, sorted by ``key``, by the first place of their group."""
        if len(members):
            opens = np.ones(len(key), bool)
            opens[1:] = key[1:] != key[:-1]
            rank[members] = place[np.maximum.accumulate(np.where(opens, np.arange(len(key)), 0))]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many terms the suffixes at ``a`` have in common with those at ``b``."""
        length = np.zeros(len(a), np.int64)
        most = np.minimum(self.left[a], self.left[b])
        for k in range(len(self.ranks) - 1, -1, -1):
            # whole suffixes may be equal beyond the last round, so the greatest step may be taken again
            while True:
                open_ = np.flatnonzero(length < most)
                step = open_[self.ranks[k][a[open_] + length[open_]] == self.ranks[k][b[open_] + length[open_]]]
                length[step] += 1 << k
                if k < len(self.ranks) - 1 or not len(step):
                    break
        return np.minimum(length, most)


def interval_counts(codes: np.ndarray, record: np.ndarray, max_n: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each n, up to ``max_n`` or the longest record: a position of every distinct n-gram, its occurrences and its records."""
    if not len(codes):
        return
    suffixes = Suffixes(codes, record)
    order, left = suffixes.order, suffixes.left[suffixes.order]
    lcp = np.concatenate(([0], suffixes.common(order[:-1], order[1:])))
    owner = record[order]
    by_owner = np.argsort(owner, kind="stable")
    twin = np.zeros(len(codes), np.int64)
    pair = owner[by_owner[1:]] == owner[by_owner[:-1]]
    later, earlier = by_owner[1:][pair], by_owner[:-1][pair]
    twin[later] = suffixes.common(order[earlier], order[later])
    for n in range(1, int(left.max()) + 1):
        if max_n is not None and n > max_n:
            return
        whole = left >= n
        starts = np.flatnonzero(whole & (lcp < n))
        # suffixes shorter than n sort before longer ones of the same prefix, so they start no interval
        # but may follow one; they count neither as an occurrence nor as a duplicate
        total = np.add.reduceat(whole.astype(np.int64), starts)
        doubled = np.add.reduceat((whole & (twin >= n)).astype(np.int64), starts)
        yield n, order[starts], total, total - doubled


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    """Whole records, in runs of bounded total length."""
    held: list[str] = []
    size = 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text is not None:
                held.append(text)
                size += len(text)
                if size >= PIECE:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def ngram_counts(records: DataFrame, text_col: str, max_n: int | None = 1, pattern: str = TERM_PATTERN) -> DataFrame:
    """``(n, term, n_total, n_docs)`` of every n-gram of up to ``max_n`` terms in ``records``; None sets no bound.

    One row of ``records`` is one record.  Null and empty texts count nothing, an empty table gives an
    empty result, other columns are ignored whatever their names.  Terms are lower-cased and joined by
    one blank; no n-gram crosses two records.
    """
    return _with_records(records, text_col, max_n, pattern).where("n > 0")


def _with_records(records: DataFrame, text_col: str, max_n: int | None, pattern: str) -> DataFrame:
    """Like :func:`ngram_counts`, with one row of n = 0 whose ``n_docs`` counts the records."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = re.compile(pattern)
        columns = ["n", "term", "n_total", "n_docs"]
        for texts in _pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([""]), pa.array([0]), pa.array([len(texts)])], names=columns)
            codes, record, terms = term_codes(texts, compiled)
            for n, at, total, docs in interval_counts(codes, record, max_n):
                words = [terms.take(pa.array(codes[at + k])) for k in range(n)]
                names = words[0] if n == 1 else pc.binary_join_element_wise(*words, " ")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, np.int32)), names, pa.array(total), pa.array(docs)], names=columns)

    parts = records.select(F.col(text_col).cast("string").alias("text")).mapInArrow(partial, "n int, term string, n_total long, n_docs long")
    return parts.groupBy("n", "term").agg(F.sum("n_total").alias("n_total"), F.sum("n_docs").alias("n_docs"))


def marked_terms(df: DataFrame, id_col: str, text_col: str, order_col: str | None = None, rare_docs: int = 2, common_share: float = 0.2, max_n: int | None = 1) -> DataFrame:
    """``(n, term, n_total, n_docs, mark)`` over the latest copy of every id.

    ``mark`` is ``common`` from ``common_share`` of all counted records on, else ``rare`` up to
    ``rare_docs`` records, else ``useful``.  ``common`` wins in a collection so small that both hold.
    """
    counts = _with_records(latest_records(df, id_col, text_col, order_col), text_col="text", max_n=max_n, pattern=TERM_PATTERN)
    counted = counts.where("n = 0").select("n_docs").scalar()
    mark = F.when(F.col("n_docs") >= F.lit(common_share) * counted, "common").when(F.col("n_docs") <= rare_docs, "rare").otherwise("useful")
    return counts.where("n > 0").withColumn("mark", mark)
