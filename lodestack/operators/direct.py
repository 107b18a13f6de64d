"""BM25 of a batch of queries straight from the documents, without an index.

One pass over the texts counts only the terms that some query names, and writes the postings as packed blocks of
documents where they lie; no text, term or posting is shuffled.  A second pass scores the blocks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import raw_terms
from lodestack.operators import blocks, rank
from lodestack.session import broadcast_if_small, materialize

#: ``functions.text.RAW_TERM`` in bytes whose ASCII letters are small.
_TERM = re.compile(rb"[a-z][a-z0-9']+")
#: ``tn, at, tf``: numbers of terms, ascending, with the places of their documents in ``ids`` and counts there; the numbers of titles' terms come after those of texts.
PACKED = "docs int, length long, ids binary, dl binary, tn binary, at binary, tf binary, terms array<int>, sizes array<int>"
#: Blocks that a task scores, if there are more than one for each core.
TASK_BLOCKS = 16


class _Packer:
    def __init__(self, known: dict[bytes, int]):
        self.get, self.titles = known.get, len(known)
        self.clear()

    def clear(self) -> None:
        self.ids, self.dl, self.held, self.tn, self.tf = [], [], [], [], []

    def add(self, doc: int, title: bytes | None, text: bytes) -> None:
        terms = _TERM.findall(text.lower())  # bytes: only ASCII letters change
        found = Counter(filter(None, map(self.get, terms)))
        titled = {n + self.titles for n in map(self.get, _TERM.findall(title.lower())) if n} if title else ()
        self.ids.append(doc)
        self.dl.append(len(terms))
        self.held.append(len(found) + len(titled))
        self.tn += found
        self.tn += titled
        self.tf += found.values()
        self.tf += [1] * len(titled)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.ids:
            return
        tn, tf, at = np.array(self.tn, np.int32) - 1, np.array(self.tf, np.int32), np.repeat(np.arange(len(self.ids), dtype=np.int32), self.held)
        order = np.argsort(tn, kind="stable")
        terms, sizes = np.unique(tn, return_counts=True)
        parts = [np.array(self.ids, np.int64), np.array(self.dl, np.int32), tn[order], at[order], tf[order]]
        columns = [pa.array([len(self.ids)], pa.int32()), pa.array([sum(self.dl)], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in parts], *[pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (terms, sizes)]]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PACKED.split(", ")])
        self.clear()


def packed(docs: DataFrame, terms: list[str], per_block: int = blocks.DOCUMENTS) -> DataFrame:
    """The postings of ``terms`` in ``docs (doc_id, title, text)``, one row for each block of up to ``per_block`` documents."""
    sent = docs.sparkSession.sparkContext.broadcast({term.encode(): n for n, term in enumerate(terms, 1)})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(sent.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                titles, texts = (part.column(i).cast(pa.binary()).to_pylist() for i in (1, 2))
                for doc, title, text in zip(part.column(0).to_pylist(), titles, texts, strict=True):
                    packer.add(doc, title, text or b"")
                    if len(packer.ids) == per_block:
                        yield from packer.rows()
        yield from packer.rows()

    return docs.select(F.col("doc_id").cast("long"), F.col("title").cast("string"), "text").mapInArrow(pack, PACKED)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, title_boost: float = 0.0, per_block: int = blocks.DOCUMENTS) -> DataFrame:
    """:func:`lodestack.operators.rank.bm25` of ``docs (doc_id, title, text)``, one row per id, for ``queries (query_id, query)``.

    The different terms of the queries and their frequencies are held by the driver and every task.
    """
    context = docs.sparkSession.sparkContext
    words = queries.select("query_id", F.explode(raw_terms("query")).alias("term"))
    numbers = materialize(queries.select("query_id").distinct().coalesce(1).withColumn("qn", F.monotonically_increasing_id()), "numbers")
    counted = words.groupBy("query_id", "term").agg(F.count("*").alias("qtf")).join(broadcast_if_small(numbers), "query_id")
    query_terms = materialize(counted.select("qn", "term", "qtf"), "query-terms")
    numbered = materialize(query_terms.select("term").distinct().coalesce(1).withColumn("tn", F.monotonically_increasing_id().cast("int")), "term-numbers")
    terms = [r.term for r in numbered.orderBy("tn").collect()]
    size = len(terms)
    held = materialize(packed(docs, terms, per_block), "packed")
    row = held.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    n_docs, avgdl, count = row[0], row[1] / max(1, row[0]), row[2]
    sizes = held.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).where(F.col("t.terms") < size).groupBy("t.terms").agg(F.sum("t.sizes").alias("df")).collect()
    idf = np.zeros(size)
    for tn, df in sizes:
        idf[tn] = math.log((n_docs - df + 0.5) / (df + 0.5) + 1)
    sent = context.broadcast(idf)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[blocks._Packed]:  # noqa: SLF001
        idf = sent.value
        for batch in batches:
            for ids, dl, tn, at, tf in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                ids, dl, tn, at, tf = np.frombuffer(ids, np.int64), np.frombuffer(dl, np.int32), *(np.frombuffer(x, np.int32) for x in (tn, at, tf))
                norm = 1.0 - b + (dl * b / avgdl if avgdl else np.full(len(dl), b))
                c = np.full(len(tn), float(title_boost))
                end = np.searchsorted(tn, size)
                c[:end] = idf[tn[:end]] * tf[:end] * (k1 + 1) / (tf[:end] + norm[at[:end]] * k1)
                yield blocks._Packed(ids, tn, at, c, 2 * size)  # noqa: SLF001

    asked = query_terms.join(broadcast_if_small(numbered), "term").select("qn", "tn", F.col("qtf").cast("double").alias("w"))
    if title_boost:
        asked = asked.union(asked.select("qn", F.col("tn") + size, F.lit(1.0)))
    tasks = max(context.defaultParallelism, math.ceil(count / TASK_BLOCKS))
    scores = blocks.best_packed(materialize(asked, "asked"), held.select("ids", "dl", "tn", "at", "tf").repartition(tasks), read, k)
    return rank.top(scores, k, key="qn").join(broadcast_if_small(numbers), "qn").select("query_id", "rank", "doc_id", "score")
