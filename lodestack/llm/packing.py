"""Filling fixed-capacity containers with neighbouring texts along a Hilbert curve.

Every text has a point in a few dimensions (the hashed vector of :mod:`tokens`, each dimension made
uniform by the mean and deviation over all texts).  The place of the point on the Hilbert curve is
the sort key: texts close on the curve are close in content.  Spark range-sorts all texts of each
plan by that key; each task walks its stretch of the curve in windows of a few containers' worth of
tokens and fits the texts of a window into the containers still open, largest first, each into the
fullest one that has room.  A container closes once the curve has gone on by ``open_windows`` windows, so
what it holds lies close together: wider windows fill better and neighbour less.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.tokens import TOKENIZER, token_table
from lodestack.session import broadcast_if_small


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows) with ``bits`` bits in each dimension."""
    x = points.T.astype(np.uint64).copy()
    dims, one = len(x), np.uint64(1)
    q = np.uint64(1 << (bits - 1))
    while q > one:
        low = q - one
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0]) ^ swap
            x[i] ^= swap
        q >>= one
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    q = np.uint64(1 << (bits - 1))
    while q > one:
        turn = np.where((x[-1] & q) > 0, turn ^ (q - one), turn)
        q >>= one
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[i] >> np.uint64(bit)) & one)
    return key.astype(np.int64)


def curve_order(tokens: DataFrame, dims: int, bits: int) -> DataFrame:
    """``tokens`` with the column ``curve`` instead of ``vector``."""
    moments = tokens.where("n_tokens > 0").agg(*[f(F.col("vector")[i]) for i in range(dims) for f in (F.avg, F.stddev_pop)]).first()
    mean = np.array([moments[2 * i] or 0.0 for i in range(dims)])
    spread = np.array([moments[2 * i + 1] or 1.0 for i in range(dims)])

    @F.pandas_udf("long")
    def place(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype="int64")
        z = (np.stack(vectors.to_numpy()) - mean) / spread
        uniform = 1.0 / (1.0 + np.exp(-1.702 * np.clip(z, -8, 8)))  # about the normal distribution function
        return pd.Series(hilbert_key(np.minimum((uniform * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits))

    return tokens.select(*[c for c in tokens.columns if c != "vector"], place("vector").alias("curve"))


def _fit(capacity: int, items: list[tuple[int, int, int, int]], bins: list[tuple[int, int]], fresh: Iterator[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """Best fit of items (size, doc, piece, start), largest first; ``bins`` are sorted (room, container)."""
    for size, doc, piece, start in sorted(items, reverse=True):
        at = bisect_left(bins, (size, -1))
        if at < len(bins):
            room, container = bins.pop(at)
        else:
            room, container = capacity, next(fresh)
        if room > size:
            insort(bins, (room - size, container))
        yield container, doc, piece, start, size


def pack(documents: DataFrame, plans: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, tokenizer: str = TOKENIZER, dims: int = 4, bits: int = 10, window: int = 32, open_windows: int = 4) -> DataFrame:
    """``(plan_id, container_id, doc_id, piece, start_token, n_tokens)`` of all pieces of all texts of each plan.

    ``plans`` holds ``plan_id, capacity_tokens, lang``; a null ``lang`` takes all texts, otherwise
    only texts of that ``lang`` take part.  A text longer than the capacity is cut into full
    containers and a rest; every other text stays whole as piece 0.  Empty texts take a place of 0
    tokens, null texts none.  Plans with a null or non-positive capacity are left out; empty tables
    give an empty result.  A window holds texts of ``window`` times the capacity, at least ``window`` of them; a
    container takes no text later than ``open_windows`` windows after its first.
    """
    tokens = token_table(documents, id_col, text_col, {"lang": F.col(lang_col)}, tokenizer, dims)
    placed = curve_order(tokens, dims, bits)
    keyed = placed.withColumn("key", F.explode(F.array_compact(F.array(F.lit("*"), F.concat(F.lit("="), "lang")))))
    wanted = plans.where("plan_id is not null and capacity_tokens > 0").select("plan_id", F.col("capacity_tokens").cast("long").alias("capacity"), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("*")).alias("key")).distinct()
    items = keyed.join(broadcast_if_small(wanted), "key").select("plan_id", "capacity", "curve", "doc_id", "n_tokens")
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = items.repartitionByRange(parts, "plan_id", "curve", "doc_id").sortWithinPartitions("plan_id", "curve", "doc_id")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 40  # the number of the next container
        current, bins, items, held = None, [], [], 0
        opened: list[int] = []  # the first container of each of the last windows

        def flush() -> pa.RecordBatch:
            nonlocal made, held
            opened.append(made)
            placed = list(_fit(current[1], items, bins, itertools.count(made)))
            made = max(made, *(container + 1 for container, *_ in placed))
            items.clear()
            held = 0
            del opened[: max(0, len(opened) - open_windows)]
            bins[:] = [b for b in bins if b[1] >= opened[0]]
            columns = list(zip(*placed, strict=True)) if placed else [[]] * 5
            plan = pa.array(np.full(len(placed), current[0], np.int32))
            return pa.RecordBatch.from_arrays([plan, *[pa.array(c, pa.int64()) for c in columns]], names=["plan_id", "container_id", "doc_id", "piece", "start_token", "n_tokens"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1, 3, 4)]
            for plan, capacity, doc, size in zip(*columns, strict=True):
                if current != (plan, capacity):
                    if items:
                        yield flush()
                    current, bins, opened = (plan, capacity), [], []
                held += size
                whole, rest = divmod(size, capacity)
                items.extend((capacity, doc, k, k * capacity) for k in range(whole))
                if rest or not size:
                    items.append((rest, doc, whole, whole * capacity))
                if held >= window * capacity and len(items) >= window:
                    yield flush()
        if items:
            yield flush()

    return ordered.mapInArrow(fill, "plan_id int, container_id long, doc_id long, piece long, start_token long, n_tokens long")


def fill_report(packed: DataFrame, plans: DataFrame) -> DataFrame:
    """``(plan_id, containers, documents, split_documents, tokens, fill)``; fill is tokens over capacity."""
    docs = packed.groupBy("plan_id", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"))
    per_doc = docs.groupBy("plan_id").agg(F.count("*").alias("documents"), F.count(F.when(F.col("pieces") > 1, 1)).alias("split_documents"), F.sum("tokens").alias("tokens"))
    used = packed.select("plan_id", "container_id").distinct().groupBy("plan_id").agg(F.count("*").alias("containers"))
    rows = per_doc.join(used, "plan_id").join(plans.select("plan_id", F.col("capacity_tokens").cast("long").alias("capacity")), "plan_id")
    return rows.select("plan_id", "containers", "documents", "split_documents", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 4).alias("fill"))
