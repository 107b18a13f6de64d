"""Near-duplicate texts: SuperMinHash signatures, banding, exact verification, grouping.

A text is the set of its runs of ``shingle_words`` words.  For every element of a set SuperMinHash
draws one random permutation of the signature slots; the rank in that permutation is the integer part
of the value, so the values of one element are negatively correlated and the signature varies less
than independent minima do.  The draw stops as soon as every slot holds a rank below the next one.

Texts with the same set collapse to one representative before banding, so a group of copies, however
large, costs one row per band.  Bands are counted by a pre-aggregated groupBy; only bands with more
than one owner go on.  Pairs are verified on the exact sets of shingle hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.components import connected_components
from lodestack.session import broadcast_if_small, materialize

WORD = re.compile("[A-Za-z0-9_]+")
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], size: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all texts end to end, and how many each has.

    Texts with fewer than ``max(size, least_words)`` words have none.
    """
    words = [WORD.findall(t) for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    short = counts < max(size, least_words)
    words = [w for w, s in zip(words, short, strict=True) if not s]
    if not words:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    coded = pa.array(" ".join([" ".join(w) for w in words]).lower().split(" "), pa.string()).dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    hashed = table[np.asarray(coded.indices)]
    owner = np.repeat(np.flatnonzero(~short), counts[~short])
    n = len(hashed) - size + 1
    shingle = np.zeros(n, np.uint64)
    for k in range(size):
        shingle = _mix(shingle * _GOLD + hashed[k : k + n])
    inside = owner[:n] == owner[size - 1 :]
    shingle, owner = shingle[inside], owner[:n][inside]
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    fresh = np.ones(len(shingle), bool)
    fresh[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    return shingle[fresh], np.bincount(owner[fresh], minlength=len(texts))


def _minima(seeds: np.ndarray, owner: np.ndarray, count: int, slots: int) -> np.ndarray:
    """Signatures of ``count`` sets whose elements lie end to end, ``owner`` telling whose each is."""
    permutation = np.tile(np.arange(slots, dtype=np.int16), (len(seeds), 1))
    # integer part and fraction of rank + u in one 64-bit number, so minima are exact
    values = np.full(count * slots, np.iinfo(np.uint64).max, np.uint64)
    rows = np.arange(len(seeds))
    for rank in range(slots):
        draw = _mix(seeds + np.uint64(rank + 1) * _GOLD)
        other = rank + ((draw >> np.uint64(48)) % np.uint64(slots - rank)).astype(np.int64)
        slot = permutation[rows, other]
        permutation[rows, other] = permutation[rows, rank]
        value = (np.uint64(rank) << np.uint64(48)) | (draw & np.uint64((1 << 48) - 1))
        np.minimum.at(values, owner * slots + slot, value)
        most = values.reshape(count, slots).max(axis=1) >> np.uint64(48)
        active = most[owner] > rank
        if not active.all():
            seeds, owner, rows = seeds[active], owner[active], rows[active]
        if not len(seeds):
            break
    return values.reshape(count, slots)


def super_min_hash(elements: np.ndarray, sizes: np.ndarray, slots: int, block: int = 40_000) -> np.ndarray:
    """SuperMinHash signatures, one row of ``slots`` 64-bit values per non-empty set.

    The k-th round gives each element's k-th slot the value k + u; a set leaves the rounds once all
    its slots are below k, since no later round can lower them.  Elements count for themselves, so a
    set larger than ``block`` is signed in parts and the parts' minima are taken.
    """
    sizes = sizes[sizes > 0]
    ends = np.cumsum(sizes)
    out = np.empty((len(sizes), slots), np.uint64)
    first = 0
    with np.errstate(over="ignore"):
        while first < len(sizes):
            base = int(ends[first] - sizes[first])
            last = max(first + 1, int(np.searchsorted(ends, base + block, "right")))
            if sizes[first] > block:
                parts = [elements[at : min(at + block, int(ends[first]))] for at in range(base, int(ends[first]), block)]
                out[first] = np.minimum.reduce([_minima(p, np.zeros(len(p), np.int64), 1, slots)[0] for p in parts])
                first += 1
                continue
            out[first:last] = _minima(elements[base : ends[last - 1]], np.repeat(np.arange(last - first), sizes[first:last]), last - first, slots)
            first = last
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per set and band; the band's number is hashed in."""
    keys = np.empty((len(signatures), bands), np.int64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(signatures), b + 1, np.uint64) * _GOLD
            for r in range(rows):
                key = _mix(key * _GOLD + signatures[:, b * rows + r])
            keys[:, b] = key.view(np.int64)
    return keys


class NearDuplicates:
    """Pairs and groups of texts whose shingle sets have a Jaccard similarity of ``threshold``.

    ``texts`` holds ``id BIGINT`` and ``text STRING`` under the given column names; other columns are
    ignored, whatever their names.  Rows repeated under one id count once.  Null ids, null texts and
    texts with fewer than ``least_words`` words take no part; an empty table gives empty results.

    With the default 36 bands of 3 rows a pair of similarity 0.6 has a chance of 1.6e-4 to share no
    band; 0.7 has 1.2e-7.  ``bands`` and ``rows`` are the knobs for other thresholds.

    ``hot_bucket``: a band shared by more than so many different sets is not paired off.  Its members
    are joined exactly by prefix filter instead (sets of similarity t must share one of their rarest
    ``n - ceil(t n) + 1`` shingles), so nothing is lost and common boilerplate pairs with nothing.
    """

    def __init__(self, texts: DataFrame, id_col: str, text_col: str, *, shingle_words: int = 5, threshold: float = 0.8, least_words: int = 0, bands: int = 36, rows: int = 3, hot_bucket: int = 200):
        self.size, self.threshold, self.least, self.bands, self.rows, self.hot = shingle_words, threshold, least_words, bands, rows, hot_bucket
        self.texts = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
        self._features: DataFrame | None = None
        self._pairs: DataFrame | None = None
        self._copy_ids: DataFrame | None = None

    def features(self) -> DataFrame:
        """``(id, set_hi, set_lo, bands)`` of every text that takes part; the set key is 128 bits."""
        if self._features is None:
            size, least, bands, rows = self.size, self.least, self.bands, self.rows

            def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    shingles, sizes = shingle_sets(batch.column(1).to_pylist(), size, least)
                    kept = np.flatnonzero(sizes)
                    keys = band_keys(super_min_hash(shingles, sizes, bands * rows), bands, rows)
                    ends = np.cumsum(sizes[kept])
                    digests = [xxhash.xxh3_128_intdigest(shingles[e - n : e].tobytes()) for e, n in zip(ends, sizes[kept], strict=True)]
                    high = np.array([d >> 64 for d in digests], np.uint64).view(np.int64)
                    low = np.array([d & (2**64 - 1) for d in digests], np.uint64).view(np.int64)
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(kept) * bands + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.array(high), pa.array(low), flat], names=["id", "set_hi", "set_lo", "bands"])

            self._features = materialize(self.texts.mapInArrow(sign, "id long, set_hi long, set_lo long, bands array<long>"), "signatures")
        return self._features

    def members(self) -> DataFrame:
        """``(rep, id)``: the least id with the same set stands for all of them, itself included."""
        rows = self.features().select("set_hi", "set_lo", "id").distinct()
        reps = rows.groupBy("set_hi", "set_lo").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
        several = reps.where("copies > 1").drop("copies")
        return rows.join(several, ["set_hi", "set_lo"]).select("rep", "id")

    def candidates(self) -> DataFrame:
        """Distinct pairs ``(a, b)``, a < b, of representatives that share a band."""
        keyed = self.features().join(broadcast_if_small(self._copies()), "id", "left_anti").select("id", F.explode("bands").alias("band"))
        counted = materialize(keyed.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).where("n > 1 and a < b"), "bands")
        pairs = counted.where("n = 2").select("a", "b")
        crowded = materialize(counted.where(f"n between 3 and {self.hot}").select("band"), "bands")
        inside = materialize(keyed.join(broadcast_if_small(crowded), "band").distinct(), "bands")
        several = inside.alias("l").join(inside.alias("r"), F.expr("l.band = r.band and l.id < r.id")).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
        hot = counted.where(f"n > {self.hot}").select("band")
        pairs = pairs.union(several)
        if not hot.isEmpty():
            crowd = materialize(keyed.join(broadcast_if_small(hot), "band", "left_semi").select("id").distinct(), "crowd")
            pairs = pairs.union(self._prefix_pairs(crowd))
        return materialize(pairs.distinct(), "candidates")

    def _copies(self) -> DataFrame:
        """Ids that another one stands for."""
        if self._copy_ids is None:
            self._copy_ids = materialize(self.members().where("rep <> id").select("id").distinct(), "copies")
        return self._copy_ids

    def _prefix_pairs(self, ids: DataFrame) -> DataFrame:
        """All pairs among ``ids`` that can reach the threshold, by their rarest shingles."""
        size, least, threshold = self.size, self.least, self.threshold

        def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shingles, sizes = shingle_sets(batch.column(1).to_pylist(), size, least)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(np.repeat(sizes, sizes)), pa.array(shingles.view(np.int64))], names=["id", "n", "shingle"])

        own = self.texts.join(broadcast_if_small(ids), "id", "left_semi").dropDuplicates(["id"])
        spelled = materialize(own.mapInArrow(spell, "id long, n long, shingle long"), "spelled")
        frequency = spelled.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
        ranked = spelled.join(frequency, "shingle", "left").withColumn("df", F.coalesce("df", F.lit(1)))
        order = Window.partitionBy("id").orderBy("df", "shingle")  # one text's shingles: bounded by the text
        prefix = ranked.withColumn("at", F.row_number().over(order)).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).where("df > 1").select("id", "n", "shingle")
        left, right = prefix.alias("l"), prefix.alias("r")
        close = F.expr(f"l.shingle = r.shingle and l.id < r.id and l.n >= r.n * {threshold} and r.n >= l.n * {threshold}")
        return left.join(right, close).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))

    def representative_pairs(self) -> DataFrame:
        """``(a, b, similarity)`` of representatives that reach the threshold, verified exactly."""
        if self._pairs is None:
            pairs = self.candidates()
            ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
            own = self.texts.join(broadcast_if_small(ids), "id", "left_semi").dropDuplicates(["id"])
            size, least = self.size, self.least

            def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for whole in batches:
                    for at in range(0, whole.num_rows, 2000):
                        batch = whole.slice(at, 2000)
                        shingles, sizes = shingle_sets(batch.column(1).to_pylist(), size, least)
                        ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(shingles.view(np.int64)))], names=["id", "shingles"])

            # each set is spelled once; pairs carry the hashes, which the JVM intersects
            sets = materialize(own.select("id", "text").mapInArrow(spell, "id long, shingles array<long>"), "sets")
            joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
            common = F.size(F.array_intersect("sa", "sb"))
            rows = joined.select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).alias("sizes")).where(F.col("common") < F.col("sizes"))
            # the division is the correctly rounded quotient, so 3/5 equals the literal 0.6
            self._pairs = materialize(rows.select("a", "b", (F.col("common") / (F.col("sizes") - F.col("common"))).alias("similarity")).where(F.col("similarity") >= self.threshold), "pairs")
        return self._pairs

    def all_pairs(self) -> DataFrame:
        """``(id_a, id_b)`` of all texts that reach the threshold, copies spelled out.

        For callers that need every pair: k copies of one text give k(k - 1)/2 of them.  A large class is cut
        into shares that are joined in tasks of their own.  :meth:`groups` says the same with a row for each text.
        """
        members = materialize(self.members(), "members")
        pairs = self.representative_pairs()
        left = pairs.join(members.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a", "left").select(F.coalesce("x", "a").alias("x"), "b")
        both = left.join(members.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b", "left").select("x", F.coalesce("y", "b").alias("y"))
        shares = F.ceil(F.count("*") / 500)
        cut = members.join(members.groupBy("rep").agg(shares.alias("shares")), "rep")
        some = cut.select("rep", "id", F.pmod(F.xxhash64("id"), "shares").alias("share"))
        every = cut.select("rep", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
        copies = some.alias("l").join(every.alias("r"), F.expr("l.rep = r.rep and l.share = r.share and l.id < r.id")).select(F.col("l.id").alias("x"), F.col("r.id").alias("y"))
        return both.union(copies).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    def groups(self) -> DataFrame:
        """``(id, group_id, links)`` of every text that takes part; alone, it is its own group.

        ``group_id`` is the least id of the group, ``links`` counts the other texts within the
        threshold: similar representatives with all their copies, and the text's own copies.
        """
        pairs = self.representative_pairs().select("a", "b")
        labels = connected_components(pairs)
        members = materialize(self.members(), "members")
        weight = members.groupBy("rep").agg(F.count("*").alias("copies"))
        ends = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = ends.join(weight.withColumnRenamed("rep", "b"), "b", "left").groupBy("a").agg(F.sum(F.coalesce("copies", F.lit(1))).alias("near"))
        everyone = self.features().select("id").distinct().join(members.where("rep <> id"), "id", "left").withColumn("rep", F.coalesce("rep", "id"))
        out = everyone.join(labels.withColumnRenamed("node", "rep"), "rep", "left").join(weight, "rep", "left").join(near.withColumnRenamed("a", "rep"), "rep", "left")
        return out.select("id", F.coalesce("component", "rep").alias("group_id"), (F.coalesce("near", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("links"))
