"""Exact nearest vectors of a stated query set, in blocks.

Queries go in blocks whose matrix has a stated greatest size.  A block is broadcast once as one matrix, and
every task multiplies its vectors with it; each Arrow batch keeps its best ``k`` rows per query, so what is
shuffled does not grow with the product of both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators.rank import top
from lodestack.session import materialize


#: Bytes of the query matrix that is broadcast at a time.
BLOCK_BYTES = 64 << 20


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(query_id, rank, doc_id, score)`` by inner product.

    ``vectors`` holds ``doc_id, embedding``, ``queries`` holds ``query_id, embedding``.  Null and empty
    vectors, and vectors of another length than the query's, take no part.
    """
    spark = vectors.sparkSession
    usable = queries.where("query_id is not null and size(embedding) > 0").select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    usable = materialize(usable.withColumn("width", F.size("embedding")), "queries")
    sizes = {r.width: r.n for r in usable.groupBy("width").agg(F.count("*").alias("n")).collect()}
    rows = vectors.where("doc_id is not null and size(embedding) > 0").select("doc_id", F.col("embedding").cast("array<double>").alias("embedding"))
    found = None
    for width, n in sorted(sizes.items()):
        blocks = max(1, -(-n * width * 8 // block_bytes))
        for block in range(blocks):
            some = usable.where((F.col("width") == width) & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)).toArrow()
            ids = some.column("query_id").combine_chunks()
            matrix = np.asarray(some.column("embedding").combine_chunks().flatten()).reshape(-1, width)
            shared = spark.sparkContext.broadcast((ids, matrix))
            kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {vectors.schema['doc_id'].dataType.simpleString()}, score double"
            part = rows.where(F.size("embedding") == width).mapInArrow(_best_of(shared, width, k), kinds)
            found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, rank int, doc_id {vectors.schema['doc_id'].dataType.simpleString()}, score double")
    return top(found, k).select("query_id", "rank", "doc_id", "score")


def _best_of(shared, width: int, k: int):  # noqa: ANN001, ANN202
    """The best ``k`` vectors of every batch for each query of a broadcast block."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        q = matrix
        for batch in batches:
            if not batch.num_rows or not len(q):
                continue
            docs = np.asarray(batch.column(0))
            v = np.asarray(batch.column(1).flatten()).reshape(-1, width)
            for at in range(0, len(q), 256):
                scores = np.round(q[at : at + 256] @ v.T, 5)
                order = np.stack([np.lexsort((docs, -row))[:k] for row in scores])
                taken = np.repeat(np.arange(at, at + len(scores)), order.shape[1])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(taken)), pa.array(docs[order.ravel()]), pa.array(np.take_along_axis(scores, order, axis=1).ravel())], names=["query_id", "doc_id", "score"])

    return best
