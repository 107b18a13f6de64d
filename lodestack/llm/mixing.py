"""Mixing sources to target weights by proportionate-fair scheduling.

How much: with ``budget_share`` the total of a mix is that share of the tokens of its named sources;
each document repeats at most ``max_repeats`` times, and what a source lacks is reported and taken over
by the other sources by weight.  Without it the total is the largest at which every named source that
holds text can give exactly its share, so the scarcest source sets it.  A source's quota is filled with whole passes over
its documents in hashed order, then a prefix of one more pass, then up to three documents of different
length that fit the rest best.

In what order: each source's stream is cut into blocks of a fixed number of tokens, whatever the size of
the corpus.  Block j of a source with weight w is released at floor(j/w) and due at ceil((j+1)/w); at
each slot the released block with the earliest deadline runs.  Weights add up to 1, so no deadline is
missed, and at every slot each source is less than one block away from its share.

The slots are cut into epochs that are scheduled independently of each other, in as many tasks as there
are.  How many blocks of each source run before an epoch needs no simulation: all that are due by then
run before it, and of those that are released but due later (at most one of each source) the ones that
earliest deadline first has room for (:func:`done_before`).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.tokens import TOKENIZER, token_table
from lodestack.session import broadcast_if_small, materialize


def done_before(slot: int, blocks: dict, reach: int = 1 << 20) -> dict:
    """How many blocks of each source run before ``slot``.

    Sets of blocks that can run in the slots before T, given their releases, form a matroid; the blocks
    taken greedily by deadline are a basis of it, they grow with T, and they hold every block due by T.
    Blocks due by T always fit, so only those that straddle T are tried: among the d slots before T there
    must be room for all blocks released in them, for every d up to the longest straddling window.  Windows
    longer than ``reach`` slots (a source with less than a millionth of a mix) are looked at that far.
    """
    total = sum(blocks.values())
    due = {s: n * slot // total for s, n in blocks.items()}
    done, room = dict(due), slot - sum(due.values())
    straddling = [(-(-(due[s] + 1) * total // n), str(s), s, slot - due[s] * total // n) for s, n in blocks.items() if due[s] < n]
    straddling = sorted(x for x in straddling if x[3] > 0)
    d = np.arange(1, min(reach, max((x[3] for x in straddling), default=0)) + 1)
    free = d.copy()
    for n in blocks.values():
        free -= np.maximum(0, (n * d - n * slot % total) // total)
    for _, _, source, back in straddling:
        if room and (free[back - 1 :] > 0).all():
            free[back - 1 :] -= 1
            room -= 1
            done[source] += 1
    return done


def earliest_deadline_first(blocks: dict, first: int = 0, last: int | None = None) -> list[tuple[object, int]]:
    """The (source, block) of the slots from ``first`` up to ``last`` for sources with the given numbers of blocks."""
    blocks = {s: n for s, n in blocks.items() if n > 0}
    total = sum(blocks.values())
    last = total if last is None else min(last, total)
    begun, ended = (done_before(at, blocks) if total else {} for at in (first, last))
    # weight = count / total, all in whole numbers
    released = [(max(first, begun[s] * total // n), -(-(begun[s] + 1) * total // n), str(s), s, begun[s]) for s, n in blocks.items() if begun[s] < ended[s]]
    heapq.heapify(released)
    ready: list = []
    out = []
    for slot in range(first, last):
        while released and released[0][0] <= slot:
            _, due, name, source, j = heapq.heappop(released)
            heapq.heappush(ready, (min(due, last), name, source, j))
        if ready:
            _, name, source, j = heapq.heappop(ready)
        else:  # only where a window is longer than done_before() looks
            _, _, name, source, j = heapq.heappop(released)
        out.append((source, j))
        n = blocks[source]
        if j + 1 < ended[source]:
            heapq.heappush(released, ((j + 1) * total // n, -(-(j + 2) * total // n), name, source, j + 1))
    return out


class Mixture:
    """Selection, order and reached shares of every mix of ``targets``.

    ``documents`` holds id, text and source; ``targets`` holds ``mix_id, source, target_weight,
    max_repeats``.  Weights of a mix are relative.  Null texts, ids and sources take no part; targets
    with a null or non-positive weight or fewer than one repeat are reported with nothing selected;
    a source named twice in a mix counts once with the summed weight and the lesser repeats.  Empty
    tables give empty results.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, tokenizer: str = TOKENIZER, budget_share: float | None = None, block_tokens: int = 4096, epoch_slots: int = 16_384, bucket_rows: int = 5_000):
        self.block_tokens, self.epoch_slots = block_tokens, epoch_slots
        tokens = token_table(documents, id_col, text_col, {"source": F.col(source_col)}, tokenizer)
        usable = tokens.where("source is not null and n_tokens > 0").select("doc_id", "source", "n_tokens")
        # running totals without a window over a whole source: buckets first, then within buckets
        buckets = max(1, usable.count() // bucket_rows)
        hashed = usable.withColumn("h", F.xxhash64("doc_id")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
        sums = hashed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("sum"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.select("source", "bucket", F.coalesce(F.sum("sum").over(run), F.lit(0)).alias("offset"))
        within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        ordered = hashed.withColumn("inside", F.sum("n_tokens").over(within)).join(offsets, ["source", "bucket"])
        self.documents = materialize(ordered.select("source", "doc_id", "n_tokens", (F.col("offset") + F.col("inside")).alias("end")), "ordered")
        self.quotas = materialize(self._quotas(targets, budget_share), "quotas")
        self.selected = materialize(self._select(), "selected")

    def _quotas(self, targets: DataFrame, budget_share: float | None) -> DataFrame:
        """``(mix_id, source, target_share, max_repeats, available, wanted, quota)``; as many rows as targets."""
        named = targets.where("mix_id is not null and source is not null").withColumn("ok", (F.col("target_weight") > 0) & (F.col("max_repeats") >= 1))
        named = named.groupBy("mix_id", "source").agg(F.sum(F.when(F.col("ok"), F.col("target_weight")).otherwise(0.0)).alias("weight"), F.coalesce(F.min(F.when(F.col("ok"), F.col("max_repeats"))), F.lit(0)).cast("long").alias("max_repeats"))
        held = self.documents.groupBy("source").agg(F.sum("n_tokens").alias("available"))
        rows = named.join(held, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))

        def settle(mix: pd.DataFrame) -> pd.DataFrame:
            weight = mix["weight"] / max(mix["weight"].sum(), 1e-300)
            limit = (mix["available"] * mix["max_repeats"]).astype(float)
            live = (weight > 0) & (limit > 0)
            share = weight.where(live, 0.0)
            share = share / max(share.sum(), 1e-300)
            quota = share * 0.0
            total = 0.0
            if live.any() and budget_share is None:
                total = (limit[live] / share[live]).min()
                quota = share * total
            elif live.any():
                total = budget_share * float(mix["available"].sum())
                rest, open_ = total, live.copy()
                while rest > 0.5 and open_.any():
                    part = (share * open_) / (share * open_).sum() * rest
                    given = part.clip(upper=limit - quota)
                    quota, rest = quota + given, rest - given.sum()
                    open_ &= quota < limit - 0.5
            return mix.assign(target_share=weight, wanted=(weight * total).round().astype("int64"), quota=quota.clip(upper=limit).round().astype("int64"))[["mix_id", "source", "target_share", "max_repeats", "available", "wanted", "quota"]]

        return rows.groupBy("mix_id").applyInPandas(settle, "mix_id int, source string, target_share double, max_repeats long, available long, wanted long, quota long")

    def _select(self) -> DataFrame:
        """``(mix_id, source, doc_id, n_tokens, start, repeats, extra_at, ...)``; ``extra_at`` places a copy outside the prefix."""
        wanted = self.quotas.where("quota > 0 and available > 0").withColumn("passes", F.least(F.floor(F.col("quota") / F.col("available")), "max_repeats")).withColumn("rest", F.when(F.col("passes") < F.col("max_repeats"), F.col("quota") - F.col("passes") * F.col("available")).otherwise(0))
        rows = self.documents.join(broadcast_if_small(wanted.select("mix_id", "source", "available", "passes", "rest")), "source")
        rows = rows.withColumn("taken", F.col("end") <= F.col("rest"))
        # what the prefix leaves open, then up to three untaken documents, each nearest to the rest
        key = ["mix_id", "source"]
        gaps = rows.where("rest > 0").groupBy(*key, "passes", "available").agg(F.coalesce(F.max(F.when(F.col("taken"), F.col("end"))), F.lit(0)).alias("filled"), F.first("rest").alias("rest"))
        gaps = materialize(gaps.select(*key, (F.col("rest") - F.col("filled")).alias("gap"), (F.col("passes") * F.col("available") + F.col("filled")).alias("at")), "gaps")
        # one document of each length below twice the gap: no more rows than lengths
        fitting = rows.where("rest > 0 and not taken").join(broadcast_if_small(gaps), key).where(F.col("n_tokens") < 2 * F.col("gap")).groupBy(*key, "gap", "at", "n_tokens").agg(F.min("doc_id").alias("doc_id"))

        def pick(lengths: pd.DataFrame) -> pd.DataFrame:
            gap, at = int(lengths["gap"].iloc[0]), int(lengths["at"].iloc[0])
            open_ = dict(zip(lengths["n_tokens"].tolist(), lengths["doc_id"].tolist(), strict=True))
            out = []
            while gap > 0 and open_ and len(out) < 3:
                best = min(open_, key=lambda n: (abs(n - gap), open_[n]))
                if abs(best - gap) >= gap:
                    break
                out.append((lengths["mix_id"].iloc[0], lengths["source"].iloc[0], open_.pop(best), at))
                gap, at = gap - best, at + best
            return pd.DataFrame(out, columns=["mix_id", "source", "doc_id", "extra_at"])

        picks = materialize(fitting.groupBy(*key).applyInPandas(pick, "mix_id int, source string, doc_id long, extra_at long"), "picks")
        out = rows.join(broadcast_if_small(picks), [*key, "doc_id"], "left")
        repeats = F.col("passes") + F.when(F.col("taken") | F.col("extra_at").isNotNull(), 1).otherwise(0)
        out = out.withColumn("repeats", repeats.cast("long")).where("repeats > 0")
        return out.select(*key, "doc_id", "n_tokens", (F.col("end") - F.col("n_tokens")).alias("start"), "repeats", "extra_at", "available", "passes")

    def selection(self) -> DataFrame:
        """``(mix_id, source, doc_id, n_tokens, repeats)``."""
        return self.selected.select("mix_id", "source", "doc_id", "n_tokens", "repeats")

    def shares(self) -> DataFrame:
        """``(mix_id, source, target_share, share, tokens, documents, copies, shortfall)`` really reached, one row per target.

        ``shortfall`` is what the tokens lack of the target share of the mix's total.
        """
        got = self.selected.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.sum("repeats").alias("copies"))
        rows = self.quotas.join(got, ["mix_id", "source"], "left").fillna(0, ["tokens", "documents", "copies"])
        total = F.sum("tokens").over(Window.partitionBy("mix_id"))  # as many rows as targets
        return rows.select("mix_id", "source", F.round("target_share", 6).alias("target_share"), F.round(F.when(total > 0, F.col("tokens") / total).otherwise(0.0), 6).alias("share"), "tokens", "documents", "copies", F.greatest(F.col("wanted") - F.col("tokens"), F.lit(0)).alias("shortfall"))

    def schedule(self) -> DataFrame:
        """``(mix_id, slot, source, block)`` of every slot, by epochs of ``epoch_slots``."""
        size, epoch = self.block_tokens, self.epoch_slots
        totals = self.selected.groupBy("mix_id", "source").agg(F.ceil(F.sum(F.col("n_tokens") * F.col("repeats")) / size).alias("blocks"))
        mixes = totals.groupBy("mix_id").agg(F.sum("blocks").alias("slots"), F.collect_list(F.struct("source", "blocks")).alias("sources"))  # no longer than the targets
        epochs = mixes.select("mix_id", F.col("sources.source").alias("sources"), F.col("sources.blocks").alias("blocks"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / epoch))).alias("epoch"))

        def interleave(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples():
                    first = int(row.epoch) * epoch
                    order = earliest_deadline_first(dict(zip(row.sources, map(int, row.blocks), strict=True)), first, first + epoch)
                    yield pd.DataFrame(order, columns=["source", "block"]).assign(mix_id=row.mix_id, slot=range(first, first + len(order)))[["mix_id", "slot", "source", "block"]]

        return epochs.repartition("mix_id", "epoch").mapInPandas(interleave, "mix_id int, slot long, source string, block long")

    def interleaved(self) -> DataFrame:
        """``(mix_id, slot, source, pass, doc_id, n_tokens, position)``: every copy in its slot.

        ``position`` is the token offset of the copy in its source's stream; within a slot copies
        follow each other by it.  A text longer than a block runs on through its source's next slots.
        """
        copies = self.selected.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("repeats") - 1)))
        at = F.when(F.col("pass") == F.col("passes"), F.col("extra_at")).otherwise(F.lit(None))
        placed = copies.withColumn("position", F.coalesce(at, F.col("pass") * F.col("available") + F.col("start")))
        placed = placed.withColumn("block", F.floor(F.col("position") / self.block_tokens))
        return placed.join(self.schedule(), ["mix_id", "source", "block"]).select("mix_id", "slot", "source", "pass", "doc_id", "n_tokens", "position")
