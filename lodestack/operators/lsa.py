"""Latent vectors of texts: truncated singular value decomposition of a TF-IDF matrix.

The matrix stays distributed, a row for each text with the places and weights of its terms.  Only the basis, at most
``features`` x ``dims`` numbers whatever the collection's size, is held by the driver and sent to the tasks.
One round multiplies the basis by the transposed matrix times the matrix in a single pass over the rows: each
task adds up its rows' share, Spark sums these by term, and the driver makes the sum orthogonal again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.session import broadcast_if_small, materialize


@dataclass
class LatentSpace:
    """``features (term, place, weight)`` and the basis, a row for each place; ``singular`` falls."""

    features: DataFrame
    basis: np.ndarray
    singular: np.ndarray

    def vectors(self, counts: DataFrame, key: str) -> DataFrame:
        """``(key, embedding ARRAY<DOUBLE>)`` of unit length, of ``counts (key, term, tf)``; keys without a feature are left out."""
        shared = counts.sparkSession.sparkContext.broadcast(self.basis)
        dims = self.basis.shape[1]

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = _project(batch.column(1), batch.column(2), shared.value)
                norm = np.linalg.norm(rows, axis=1, keepdims=True)
                unit = np.round(rows / np.where(norm > 0, norm, 1.0), 6)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * dims + 1, dims, dtype=np.int32)), pa.array(unit.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=[key, "embedding"])

        rows = weighted_rows(counts, self.features, key)
        return rows.mapInArrow(project, f"{key} {counts.schema[key].dataType.simpleString()}, embedding array<double>")


def weighted_rows(counts: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """``(key, places ARRAY<INT>, weights ARRAY<DOUBLE>)``: TF-IDF rows of unit length."""
    known = counts.join(broadcast_if_small(features), "term").select(key, "place", (F.col("tf") * F.col("weight")).alias("w"))
    rows = known.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "w"))).alias("r"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.select(key, F.col("r.place").alias("places"), F.transform("r.w", lambda w: w / F.col("norm")).alias("weights"))


def _project(places: pa.Array, weights: pa.Array, basis: np.ndarray) -> np.ndarray:
    at, w = np.asarray(places.flatten()), np.asarray(weights.flatten())
    starts = np.concatenate(([0], np.cumsum(np.asarray(pa.compute.list_value_length(places)))))[:-1].astype(np.int64)
    return np.add.reduceat(w[:, None] * basis[at], starts) if len(starts) else np.zeros((0, basis.shape[1]))


def fit(counts: DataFrame, n_docs: int, dims: int = 32, features: int = 4_000, rounds: int = 6, key: str = "doc_id") -> LatentSpace:
    """The ``dims`` greatest latent directions of ``counts (key, term, tf)``.

    Features are the ``features`` terms in most texts, without stop words; ties go to the smaller term.  An empty
    table gives a space without directions.
    """
    df = counts.where(~F.col("term").isin(*T.STOPWORDS)).groupBy("term").agg(F.count("*").alias("df"))
    best = materialize(df.orderBy(F.desc("df"), "term").limit(features), "features")
    weight = F.log((n_docs + 1.0) / (F.col("df") + 1.0)) + 1.0
    # at most `features` rows, a stated bound
    chosen = materialize(best.select("term", (F.row_number().over(Window.orderBy(F.desc("df"), "term")) - 1).alias("place"), weight.alias("weight")), "features")
    size = chosen.count()
    dims = min(dims, size)
    basis = np.linalg.qr(np.random.default_rng(11).standard_normal((size, dims)))[0] if size else np.zeros((0, 0))
    singular = np.zeros(dims)
    if not size:
        return LatentSpace(chosen, basis, singular)
    rows = materialize(weighted_rows(counts, chosen, key), "rows")
    for _ in range(rounds):
        image = _round(rows, basis)
        values, turn = np.linalg.eigh(basis.T @ image)
        order = np.argsort(-values)
        singular, basis = np.sqrt(np.maximum(values[order], 0)), np.linalg.qr(image @ turn[:, order])[0]
    return LatentSpace(chosen, basis, singular)


def _round(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """Transposed matrix times matrix times ``basis``, in one pass."""
    shared = rows.sparkSession.sparkContext.broadcast(basis)
    dims = basis.shape[1]

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(shared.value)
        for batch in batches:
            places, weights = batch.column(0), batch.column(1)
            sizes = np.asarray(pa.compute.list_value_length(places))
            image = np.repeat(_project(places, weights, shared.value), sizes, axis=0) * np.asarray(weights.flatten())[:, None]
            np.add.at(total, np.asarray(places.flatten()), image)
        used = np.flatnonzero(total.any(axis=1))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(used) * dims + 1, dims, dtype=np.int32)), pa.array(total[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), flat], names=["place", "part"])

    parts = rows.select("places", "weights").mapInArrow(share, "place int, part array<double>")
    summed = parts.groupBy("place").agg(*[F.sum(F.col("part")[i]).alias(f"d{i}") for i in range(dims)])
    out = np.zeros_like(basis)
    for row in summed.toLocalIterator():
        out[row[0]] = row[1:]
    return out
