"""Long exact spans shared between records, by a count-min prefilter and an exact second pass.

A span of ``min_chars`` characters holds ``min_chars - gram + 1`` grams; the one with the smallest
hash (the leftmost of equals) is its anchor.  Equal spans have equal anchors, so it is enough to
count anchors, about one in 70 characters.  All anchors are written once as ``(anchor, id, place)``.

1. Each task counts in how many of its records each anchor stands, as a sparse count-min sketch.  The
   sketch has ``cells_per_anchor`` cells a row for every anchor of the collection, so its load, and with
   it the share of unshared anchors that pass, is the same at every size.  It is cut into blocks; an
   anchor has all its cells in one block.  The partial sketches are merged by block and stay partitioned:
   neither the driver nor any task holds the whole.  A cell never undercounts.
2. The anchors, summed per task, meet the merged block that counts them.  Those whose cells all hold at
   least two are grouped exactly by anchor, which leaves the anchors that stand in several records.
   Only for these the text around them is cut out, and spans are compared within each anchor, first by
   hash, then letter by letter.  Nothing shared is lost; a crowded sketch would only let more pass.

Anchors with more than ``hot_anchor`` occurrences go another exact way: equal contexts collapse to one
row first, the different ones are exploded into single spans and pre-aggregated under two independent
hashes, so no task ever holds the records around a hot passage.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.session import broadcast_if_small, materialize

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: Characters that a task hashes at a time; bounds its memory.
_PIECE = 1_500_000
#: Anchors that a task sums up at a time.
_TOGETHER = 500_000
#: Cells of one row of a sketch block.
_BLOCK = 1 << 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hasher:
    """Hashes of all runs of one length in a text, by prefix sums modulo 2^64."""

    def __init__(self) -> None:
        self.power = self.inverse = np.zeros(0, np.uint64)

    def __call__(self, points: np.ndarray, length: int) -> np.ndarray:
        n = len(points)
        if n > len(self.power):
            self.power = np.cumprod(np.full(n, _BASE, np.uint64))
            self.inverse = np.cumprod(np.full(n, _INVERSE, np.uint64))
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((points + np.uint64(1)) * self.power[:n], out=prefix[1:])
        return _mix((prefix[length:] - prefix[:-length]) * self.inverse[: n - length + 1])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _anchors(points: np.ndarray, owner: np.ndarray, min_chars: int, gram: int, hasher: _Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all spans that lie within one record."""
    hashed = hasher(points, gram)
    key = (hashed & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashed), dtype=np.uint64)
    width, reach = min_chars - gram + 1, 1
    while reach * 2 <= width:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    if rest := width - reach:
        key = np.minimum(key[:-rest], key[rest:])
    inside = owner[: len(key)] == owner[min_chars - 1 :]
    at = np.unique(key[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return at, hashed[at]


def _pieces(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts that are long enough, in runs of bounded total length."""
    for batch in batches:
        ids, texts, held = [], [], 0
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text is not None and len(text) >= min_chars:
                ids.append(i)
                texts.append(text)
                held += len(text)
                if held >= _PIECE:
                    yield ids, texts
                    ids, texts, held = [], [], 0
        if ids:
            yield ids, texts


def _block_of(anchor: np.ndarray, blocks: int) -> np.ndarray:
    return (_mix(anchor ^ np.uint64(_BASE)) % np.uint64(blocks)).astype(np.int64)


def _cells(anchor: np.ndarray, depth: int, cells: int) -> list[np.ndarray]:
    """The cell of each anchor in every row of its block."""
    return [(_mix(anchor + np.uint64(row * 2 + 1) * np.uint64(_BASE)) % np.uint64(cells)).astype(np.int64) for row in range(depth)]


def _by_block(block: np.ndarray, kind: int, arrays: list[np.ndarray]) -> pa.RecordBatch:
    """One row ``(block, kind, data)`` per block with the parts of all arrays behind each other."""
    order = np.argsort(block, kind="stable")
    blocks, starts = np.unique(block[order], return_index=True)
    cut = [np.split(a[order], starts[1:]) for a in arrays] if len(blocks) else []
    data = [b"".join(part[i].tobytes() for part in cut) for i in range(len(blocks))]
    return pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(np.full(len(blocks), kind, np.int32)), pa.array(data, pa.binary())], names=["block", "kind", "data"])


def repeated_anchors(anchors: DataFrame, *, cells_per_anchor: int = 8, depth: int = 2, cells: int = _BLOCK) -> DataFrame:
    """``(anchor, n, a, b)`` of anchors that pass the count-min sketch: occurrences, least and greatest id.

    ``anchors`` is a written table ``(anchor, doc_id, at)``.  Every anchor that stands under two ids is
    among them; of the others as few as the sketch's load lets through.
    """
    blocks = max(1, -(-anchors.count() * cells_per_anchor // cells))
    schema = "block long, kind int, data binary"

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if held and (batch is None or sum(b.num_rows for b in held) >= _TOGETHER):
                table = pa.Table.from_batches(held)
                yield np.asarray(table.column(0)).view(np.uint64), np.asarray(table.column(1))
                held = []
            if batch is not None and batch.num_rows:
                held.append(batch)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for anchor, doc in batched(batches):
                order = np.lexsort((doc, anchor))
                value, who = anchor[order], doc[order]
                fresh = np.ones(len(value), bool)
                fresh[1:] = (value[1:] != value[:-1]) | (who[1:] != who[:-1])
                value = value[fresh]
                block = _block_of(value, blocks)
                coded, at = [], []
                for row, cell in enumerate(_cells(value, depth, cells)):
                    found, count = np.unique((block * depth + row) * cells + cell, return_counts=True)
                    coded.append(((found % (depth * cells)) << 1 | (count > 1)).astype(np.uint32))
                    at.append(found // (depth * cells))
                yield _by_block(np.concatenate(at), 0, [np.concatenate(coded)])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, counts = None, np.zeros(depth * cells, np.uint8)

        def bits() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([0], pa.int32()), pa.array([np.packbits(counts > 1).tobytes()], pa.binary())], names=["block", "kind", "data"])

        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if block != current:
                    if current is not None:
                        yield bits()
                    current = block
                    counts[:] = 0
                coded = np.frombuffer(part, np.uint32)
                cell = coded >> 1
                counts[cell] = np.minimum(2, counts[cell] + 1 + (coded & 1)).astype(np.uint8)
        if current is not None:
            yield bits()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for anchor, doc in batched(batches):
                if len(anchor):
                    order = np.argsort(anchor, kind="stable")
                    value, who = anchor[order], doc[order]
                    heads = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
                    n = np.diff(np.append(heads, len(value)))
                    value = value[heads]
                    yield _by_block(_block_of(value, blocks), 1, [value.view(np.int64), n, np.minimum.reduceat(who, heads), np.maximum.reduceat(who, heads)])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(depth * cells // 8, np.uint8)
        with np.errstate(over="ignore"):
            for batch in batches:
                kept = []
                for kind, part in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    if kind == 0:
                        bits = np.frombuffer(part, np.uint8)
                        continue
                    rows = np.frombuffer(part, np.int64).reshape(4, -1)
                    keep = np.ones(rows.shape[1], bool)
                    for row, cell in enumerate(_cells(rows[0].view(np.uint64), depth, cells)):
                        cell = cell + row * cells
                        keep &= (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
                    kept.append(rows[:, keep])
                rows = np.concatenate(kept, axis=1) if kept else np.zeros((4, 0), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=["anchor", "n", "a", "b"])

    merged = materialize(anchors.mapInArrow(sketch, schema).repartition("block").sortWithinPartitions("block").mapInArrow(merge, schema), "sketch")
    both = merged.union(anchors.mapInArrow(summed, schema)).repartition("block").sortWithinPartitions("block", "kind")
    passed = both.mapInArrow(look_up, "anchor long, n long, a long, b long")
    return passed.groupBy("anchor").agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b"))


def _runs(texts: list[str], min_chars: int, hasher: _Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every span of every context: its hash, the context's number and the place in it."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = _points("".join(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)
    hashed = hasher(points, min_chars)
    inside = np.flatnonzero(owner[: len(hashed)] == owner[min_chars - 1 :])
    row = owner[inside]
    return hashed[inside], row, inside - (np.cumsum(sizes) - sizes)[row]


def _unequal(texts: list[str], row: np.ndarray, at: np.ndarray, other: np.ndarray, there: np.ndarray, length: int) -> np.ndarray:
    """Which spans (text, place) differ from those they are paired with; neighbours are compared as one stretch."""
    if not len(row):
        return np.zeros(0, np.int64)
    order = np.lexsort((at, there - at, other, row))
    r, o, a, t = row[order], other[order], at[order], there[order]
    opens = np.ones(len(r), bool)
    opens[1:] = (r[1:] != r[:-1]) | (o[1:] != o[:-1]) | (t[1:] - a[1:] != t[:-1] - a[:-1]) | (a[1:] > a[:-1] + length)
    heads = np.flatnonzero(opens)
    ends = np.append(heads[1:], len(r))
    out = []
    for first, end in zip(heads.tolist(), ends.tolist(), strict=True):
        i, j, x, y, size = r[first], o[first], int(a[first]), int(t[first]), int(a[end - 1] - a[first]) + length
        if texts[i][x : x + size] != texts[j][y : y + size]:
            out += [k for k in order[first:end].tolist() if texts[row[k]][at[k] : at[k] + length] != texts[other[k]][there[k] : there[k] + length]]
    return np.array(out, np.int64)


def _second_hash(points: np.ndarray, length: int) -> np.ndarray:
    """A hash of all runs of one length modulo two primes, independent of :class:`_Hasher`."""
    out = np.zeros(max(0, len(points) - length + 1), np.uint64)
    for prime, base in ((2147483647, 1103515245), (2147483629, 48271)):
        p = np.uint64(prime)
        power = np.ones(1, np.uint64)
        while len(power) < length:  # powers of the base, by doubling
            step = np.uint64(pow(base, len(power), prime))
            power = np.concatenate([power, power * step % p])
        part = np.zeros(len(out), np.uint64)
        for k in range(length):
            part = (part + points[k : k + len(out)] % p * power[k]) % p
        out = (out << np.uint64(32)) ^ part
    return out


def anchor_table(texts: DataFrame, min_chars: int, gram: int) -> DataFrame:
    """``(anchor, doc_id, at)`` of all anchors of ``(id, text)``, written once."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        with np.errstate(over="ignore"):
            for ids, bodies in _pieces(batches, min_chars):
                sizes = np.array([len(t) for t in bodies])
                owner = np.repeat(np.arange(len(ids)), sizes)
                at, hashed = _anchors(_points("".join(bodies)), owner, min_chars, gram, hasher)
                who = owner[at]
                yield pa.RecordBatch.from_arrays([pa.array(hashed.view(np.int64)), pa.array(np.array(ids, np.int64)[who]), pa.array((at - (np.cumsum(sizes) - sizes)[who]).astype(np.int32))], names=["anchor", "doc_id", "at"])

    return materialize(texts.mapInArrow(find, "anchor long, doc_id long, at int"), "anchors")


def anchor_contexts(texts: DataFrame, places: DataFrame, min_chars: int, gram: int) -> DataFrame:
    """``(anchor, doc_id, first, context)``: the text around each of ``places (anchor, doc_id, at)`` that a span anchored there can cover.

    The places of one record are as many as its text is long, so one row holds them.
    """
    reach = min_chars - gram
    by_record = materialize(places.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("at", "anchor")).alias("places")).select("id", F.col("places.at").alias("at"), F.col("places.anchor").alias("anchor")), "places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                batch = whole.slice(start, 200)
                docs, firsts, anchors, contexts = [], [], [], []
                for i, text, ats, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for at, value in zip(ats, values, strict=True):
                        low = max(0, at - reach)
                        docs.append(i)
                        firsts.append(low)
                        anchors.append(value)
                        contexts.append(text[low : at + gram + reach])
                yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(docs, pa.int64()), pa.array(firsts, pa.int64()), pa.array(contexts, pa.string())], names=["anchor", "doc_id", "first", "context"])

    located = texts.join(broadcast_if_small(by_record), "id").select("id", "text", "at", "anchor")
    return materialize(located.mapInArrow(cut, "anchor long, doc_id long, first long, context string"), "contexts")


def shared_intervals(records: DataFrame, id_col: str, text_col: str, *, min_chars: int = 200, gram: int = 64, depth: int = 2, cells_per_anchor: int = 8, cells: int = _BLOCK, hot_anchor: int = 2000) -> DataFrame:
    """``(doc_id, first, last)``: the shared spans of at least ``min_chars`` code points, possibly overlapping.

    ``first`` is 0-based, ``last`` exclusive.  A span counts as shared if it stands in a record with
    another id.  Null ids and texts take no part, nor do texts shorter than ``min_chars``; an empty
    table gives an empty result; other columns are ignored.  Ids are taken as unique: rows repeated
    under one id are one record only if their texts are equal.  Anchors are counted in place of all
    windows: every window has exactly one, and equal windows have equal ones.
    """
    texts = records.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    anchors = anchor_table(texts, min_chars, gram)
    passed = repeated_anchors(anchors, cells_per_anchor=cells_per_anchor, depth=depth, cells=cells)
    counted = materialize(passed.where("a < b").select("anchor", "n"), "repeated")
    places = anchors.join(broadcast_if_small(counted.select("anchor")), "anchor", "left_semi")
    found = anchor_contexts(texts, places, min_chars, gram)
    schema = "doc_id long, first long, last long"

    def spans(doc: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
        """Starts of shared spans as runs of covered characters."""
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        opens = np.ones(len(doc), bool)
        opens[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + min_chars)
        heads = np.flatnonzero(opens)
        tails = np.append(heads[1:], len(doc)) - 1 if len(doc) else heads
        return pa.RecordBatch.from_arrays([pa.array(doc[heads]), pa.array(start[heads]), pa.array(start[tails] + min_chars)], names=["doc_id", "first", "last"])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        held: list[pa.RecordBatch] = []

        def settle(table: pa.Table) -> pa.RecordBatch:
            fp, doc, first = (np.asarray(table.column(c)) for c in range(3))
            texts = table.column(3).to_pylist()
            value, row, offset = _runs(texts, min_chars, hasher)
            anchor, who, start = fp[row], doc[row], first[row] + offset
            order = np.lexsort((who, value, anchor))
            value, anchor, who, start = value[order], anchor[order], who[order], start[order]
            opens = np.ones(len(value), bool)
            opens[1:] = (value[1:] != value[:-1]) | (anchor[1:] != anchor[:-1])
            heads = np.flatnonzero(opens)
            sizes = np.diff(np.append(heads, len(value)))
            many = np.repeat(who[heads] != who[heads + sizes - 1], sizes) if len(value) else opens
            lead = np.repeat(heads, sizes)[many]
            who, start, row, offset = who[many], start[many], row[order], offset[order]
            wrong = _unequal(texts, row[lead], offset[lead], row[many], offset[many], min_chars)
            if not len(wrong):
                return spans(who, start)
            bad = np.isin(lead, lead[wrong])  # unequal spans of one hash: grouped by their letters
            by_letters: dict[tuple[int, str], list[int]] = {}
            for i in np.flatnonzero(bad).tolist():
                r, o = int(row[many][i]), int(offset[many][i])
                by_letters.setdefault((int(lead[i]), texts[r][o : o + min_chars]), []).append(i)
            equal = [i for same in by_letters.values() if len({int(who[i]) for i in same}) > 1 for i in same]
            keep = np.concatenate([np.flatnonzero(~bad), np.array(equal, np.int64)])
            return spans(who[keep], start[keep])

        with np.errstate(over="ignore"):
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    held.append(batch.slice(at, 2000))
                    table = pa.Table.from_batches(held)
                    keys = np.asarray(table.column(0))
                    cut = int(np.searchsorted(keys, keys[-1]))  # the last anchor may go on in the next batch
                    if cut:
                        yield settle(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
            if held:
                yield settle(pa.Table.from_batches(held))

    usual = found.join(broadcast_if_small(counted.where(F.col("n") <= hot_anchor).select("anchor")), "anchor", "left_semi")
    out = usual.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(group, schema)
    hot = counted.where(F.col("n") > hot_anchor).select("anchor")
    if not hot.isEmpty():

        def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher = _Hasher()
            with np.errstate(over="ignore"):
                for batch in batches:
                    for at in range(0, batch.num_rows, 2000):
                        part = batch.slice(at, 2000)
                        fp, key, least, most = (np.asarray(part.column(c)) for c in range(4))
                        texts = part.column(4).to_pylist()
                        value, row, offset = _runs(texts, min_chars, hasher)
                        begin = np.cumsum([0, *map(len, texts)])[:-1]
                        check = _second_hash(_points("".join(texts)), min_chars)[begin[row] + offset]
                        columns = [fp[row], key[row], value.view(np.int64), check.view(np.int64), least[row], most[row], offset]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "key", "span", "check", "a", "b", "offset"])

        # copies of one context collapse to a row; only different contexts are spelled out as spans
        crowd = found.join(broadcast_if_small(hot), "anchor", "left_semi").withColumn("key", F.xxhash64("context"))
        different = crowd.groupBy("anchor", "key", "context").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).select("anchor", "key", "a", "b", "context")
        single = materialize(different.mapInArrow(explode, "anchor long, key long, span long, check long, a long, b long, offset long"), "hot-spans")
        shared = single.groupBy("anchor", "span", "check").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a < b").select("anchor", "span", "check")
        covered = single.join(shared, ["anchor", "span", "check"], "left_semi").select("anchor", "key", "offset").distinct()
        order = Window.partitionBy("anchor", "key").orderBy("offset")  # at most one row for each place in a context
        islands = covered.withColumn("island", F.col("offset") - F.row_number().over(order)).groupBy("anchor", "key", "island").agg(F.min("offset").alias("from"), F.max("offset").alias("to"))
        placed = crowd.select("anchor", "key", "doc_id", "first").join(materialize(islands.select("anchor", "key", "from", "to"), "hot-runs"), ["anchor", "key"])
        out = out.union(placed.select("doc_id", (F.col("first") + F.col("from")).alias("first"), (F.col("first") + F.col("to") + min_chars).alias("last")).distinct())
    return out


def _merged(intervals: DataFrame) -> DataFrame:
    """Each interval with the end of all earlier ones of its record."""
    before = Window.partitionBy("doc_id").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    return intervals.distinct().withColumn("before", F.max("last").over(before))


def shared_chars(intervals: DataFrame) -> DataFrame:
    """``(doc_id, shared_chars)``: how many characters of a record lie in shared spans."""
    fresh = F.greatest(F.lit(0).cast("long"), F.col("last") - F.greatest("first", F.coalesce("before", F.lit(0).cast("long"))))
    return _merged(intervals).groupBy("doc_id").agg(F.sum(fresh).alias("shared_chars"))


def maximal_spans(intervals: DataFrame) -> DataFrame:
    """``(doc_id, first, last)`` of the disjoint stretches that the shared spans of a record cover."""
    opens = F.when(F.col("before").isNull() | (F.col("first") > F.col("before")), 1).otherwise(0)
    marked = _merged(intervals).withColumn("island", F.sum(opens).over(Window.partitionBy("doc_id").orderBy("first", "last")))
    return marked.groupBy("doc_id", "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")
