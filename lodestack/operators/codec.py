"""Compact lossless payloads: vocabulary, token ids, runs, packing, verification.

The vocabulary is a table made from the collection (the ``size`` most widespread tokens).  A text is cut into
tokens whose concatenation is the text; a token outside the vocabulary is spelled: ASCII characters as
``N + code``, others as a marker and the code point.  As the vocabulary has a stated bound it is broadcast after
measuring, and tokens are looked up batch by batch where the text lies: encoding and decoding shuffle nothing.
A larger vocabulary is joined instead.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lodestack.functions.text import JAVA_TOKEN
from lodestack.session import BROADCAST_BYTES, broadcast_if_small, measured_bytes

MAGIC = b"LDST"
RUN = 0xFFFFFFFD
CODE_POINT = 0xFFFFFFFE
HEADER = ">4sHHIHH"
HEADER_BYTES = 16


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(JAVA_TOKEN), F.lit(0))


def vocabulary(texts: DataFrame, size: int = 20_000) -> DataFrame:
    """``(token, token_id, documents)``: the ``size`` tokens in most texts, ties by token; ids from 0."""
    counted = texts.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("documents"))
    best = counted.orderBy(F.desc("documents"), "token").limit(size)
    return best.select("token", (F.row_number().over(Window.orderBy(F.desc("documents"), "token")) - 1).cast("long").alias("token_id"), "documents")


def spelled(token: Column, base: int) -> Column:
    """Ids of the characters of a token outside the vocabulary."""
    return F.flatten(F.transform(F.split(token, ""), lambda c: F.when(F.ascii(c) < 128, F.array(F.ascii(c).cast("long") + base)).otherwise(F.array(F.lit(CODE_POINT), F.ascii(c).cast("long")))))


def _looked_up(words: DataFrame, size: int):  # noqa: ANN202
    """The vocabulary as a broadcast list of tokens by id, or None if it is too large to send."""
    rows = words.select("token", "token_id")
    if size > 1_000_000 or measured_bytes(rows) > BROADCAST_BYTES:
        return None
    table: list[str | None] = [None] * size
    for row in rows.toLocalIterator():
        table[row.token_id] = row.token
    return words.sparkSession.sparkContext.broadcast(pa.array(table, pa.string()))


def token_ids(texts: DataFrame, words: DataFrame, size: int) -> DataFrame:
    """``(id, ids ARRAY<BIGINT>)`` of ``texts(id, text)``; an empty text has no ids.

    ``size`` is the vocabulary's bound, which is also the first id of spelled characters.
    """
    shared = _looked_up(words, size)
    if shared is not None:

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                listed = batch.column(1)
                flat = listed.flatten()
                found = pc.index_in(flat, value_set=shared.value, skip_nulls=True)
                out = [[i] for i in found.to_pylist()]
                for at in pc.indices_nonzero(found.is_null()).to_pylist():
                    out[at] = [x for c in flat[at].as_py() for x in ((ord(c) + size,) if ord(c) < 128 else (CODE_POINT, ord(c)))]
                ends, at, rows = pc.list_value_length(listed).to_pylist(), 0, []
                for n in ends:
                    rows.append([x for ids in out[at : at + (n or 0)] for x in ids])
                    at += n or 0
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["id", "ids"])

        return texts.select(F.col("id").cast("long").alias("id"), tokens(F.coalesce("text", F.lit(""))).alias("tokens")).mapInArrow(look_up, "id long, ids array<long>")
    placed = texts.select("id", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))
    known = placed.join(broadcast_if_small(words.select("token", "token_id")), "token", "left")
    ids = F.when(F.col("token_id").isNotNull(), F.array("token_id")).otherwise(spelled(F.col("token"), size))
    listed = known.select("id", "pos", ids.alias("ids")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("p"))
    out = listed.select("id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
    return texts.select("id").join(out, "id", "left").select("id", F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))


def runs(texts: DataFrame, least: int = 3) -> DataFrame:
    """``(id, start, length, token)`` of at least ``least`` equal tokens in a row."""
    placed = texts.select("id", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))
    by_token = Window.partitionBy("id", "token").orderBy("pos")
    islands = placed.withColumn("island", F.col("pos") - F.row_number().over(by_token))
    return islands.groupBy("id", "token", "island").agg(F.min("pos").alias("start"), F.count("*").alias("length")).where(F.col("length") >= least).select("id", "start", "length", "token")


@F.pandas_udf(LongType())
def _byte_sum(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else int(np.frombuffer(d, np.uint8).sum(dtype=np.int64)) % 65536).astype("Int64")


def checksum16(data: Column) -> Column:
    """Sum of all bytes modulo 65536; by Arrow batches, since a lambda over every byte is far slower in the JVM."""
    return _byte_sum(data)


def varint_length(value: Column) -> Column:
    """Bytes of an unsigned number in groups of seven bits."""
    out = F.lit(9)
    for n in range(8, 0, -1):
        out = F.when(value < (1 << (7 * n)), n).otherwise(out)
    return out


def _shorten(ids: list[int]) -> list[int]:
    """Runs of three or more equal vocabulary ids as id, RUN, further repeats; markers and code points stay."""
    out: list[int] = []
    at = 0
    while at < len(ids):
        if ids[at] == CODE_POINT:
            out += ids[at : at + 2]
            at += 2
            continue
        end = at
        while end < len(ids) and ids[end] == ids[at]:
            end += 1
        out += [ids[at], RUN, end - at - 1] if end - at >= 3 else ids[at:end]
        at = end
    return out


#: How runs are shortened: never, always, or where it pays.
RUN_MODES = ("off", "auto", "force")


def run_mode(mode: bool | str) -> str:
    """A mode by name; True and False stand for ``force`` and ``off``."""
    name = ("force" if mode else "off") if isinstance(mode, bool) else mode.lower()
    if name not in RUN_MODES:
        raise ValueError(f"unknown run mode {mode!r}")
    return name


def shorten(ids: list[int], mode: bool | str = "force", least: float = 0.02, block: int = 65_536) -> list[int]:
    """``ids`` with runs shortened by ``mode``.

    ``auto`` first deflates the first block both ways and leaves all as it is unless that saves the share
    ``least``; then each block decides for itself by the number of its ids.  A block never ends inside a spelled
    character.
    """
    mode = run_mode(mode)
    if block <= 0:
        raise ValueError("a block holds at least one id")
    if mode != "auto" or not ids:
        return _shorten(ids) if mode == "force" else ids
    cuts = [0]
    while cuts[-1] < len(ids):
        end = min(cuts[-1] + block, len(ids))
        cuts.append(end + 1 if end < len(ids) and ids[end - 1] == CODE_POINT else end)
    deflated = lambda some: len(zlib.compress(struct.pack(f"<{len(some)}I", *some), 9))
    first = ids[: cuts[1]]
    if deflated(_shorten(first)) > (1 - least) * deflated(first):
        return ids
    out: list[int] = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        some = _shorten(ids[a:b])
        out += some if b - a - len(some) >= max(1, least * (b - a)) else ids[a:b]
    return out


def _expand(ids: list[int]) -> list[int]:
    out: list[int] = []
    at = 0
    while at < len(ids):
        if ids[at] == RUN:
            out += [out[-1]] * ids[at + 1]
            at += 2
        elif ids[at] == CODE_POINT:
            out += ids[at : at + 2]
            at += 2
        else:
            out.append(ids[at])
            at += 1
    return out


def payloads(listed: DataFrame, version: int = 1, runs: bool | str = "force") -> DataFrame:
    """``(id, payload BINARY)`` of ``(id, ids, bytes, language, checksum)``."""
    mode = run_mode(runs)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, ids, size, language, checksum = (c.to_pylist() for c in batch.columns)
            out = []
            for i, n, lang, total in zip(ids, size, language, checksum, strict=True):
                short = shorten(i, mode)
                out.append(struct.pack(HEADER, MAGIC, version, int(len(short) < len(i)), n, lang & 0xFFFF, total) + zlib.compress(struct.pack(f"<{len(short)}I", *short), 6))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(out, pa.binary())], names=["id", "payload"])

    return listed.select("id", "ids", "bytes", "language", "checksum").mapInArrow(pack, "id long, payload binary")


def encode(texts: DataFrame, words: DataFrame, size: int, version: int = 1, runs: bool | str = "force") -> DataFrame:
    """``(id, payload)`` of ``texts(id, text, language_id)``; null texts have no payload."""
    rows = texts.where("text is not null")
    data = F.col("text").cast("binary")
    facts = rows.select(F.col("id").cast("long").alias("id"), F.octet_length("text").alias("bytes"), F.coalesce("language_id", F.lit(-1)).alias("language"), checksum16(data).alias("checksum"))
    return payloads(token_ids(rows, words, size).join(facts, "id"), version, runs)


def prefix(words: DataFrame, size: int) -> DataFrame:
    """The vocabulary's first ``size`` ids: what an earlier, smaller version held."""
    return words.where(F.col("token_id") < size)


def migrate(packed: DataFrame, old: DataFrame, old_size: int, new: DataFrame, new_size: int, version: int) -> DataFrame:
    """``(id, payload)`` of all payloads in ``version``: those of another one are decoded by ``old`` and encoded by ``new``.

    Payloads that do not decode stay as they are.
    """
    seen = packed.select("id", "payload").join(headers(packed).select("id", F.col("version").alias("made"), "language"), "id")
    stale = seen.where(F.col("made") != version)
    texts = decode(stale.select("id", "payload"), old, old_size).where("text is not null").join(stale.select("id", F.when(F.col("language") < 0x8000, F.col("language")).alias("language_id")), "id")
    fresh = encode(texts, new, new_size, version)
    kept = packed.select(F.col("id").cast("long").alias("id"), "payload").join(fresh.select("id"), "id", "left_anti")
    return kept.union(fresh)


def headers(packed: DataFrame) -> DataFrame:
    """``(id, magic, version, runs, bytes, language, checksum)`` from the first 16 bytes, by built-in functions."""
    number = lambda at, n: F.conv(F.hex(F.substring("payload", at, n)), 16, 10).cast("long")
    return packed.select("id", F.substring("payload", 1, 4).cast("string").alias("magic"), number(5, 2).alias("version"), (number(7, 2) % 2 == 1).alias("runs"), number(9, 4).alias("bytes"), number(13, 2).alias("language"), number(15, 2).alias("checksum"))


def _text_of(ids: list[int], table: list[str | None], size: int) -> str:
    """Tokens and spelled characters of a list of ids, joined; unknown ids stand for nothing."""
    out, marked = [], False
    for i in ids:
        if marked:
            out.append(chr(i) if i < 0x110000 else "")
            marked = False
        elif i == CODE_POINT:
            marked = True
        elif i < size:
            out.append(table[i] or "")
        elif i < size + 128:
            out.append(chr(i - size))
    return "".join(out)


def decode(packed: DataFrame, words: DataFrame, size: int) -> DataFrame:
    """``(id, text)`` of ``(id, payload)``: ids by zlib, tokens by a join, text by position.

    Payloads that do not start with the magic or do not inflate give a null text.
    """

    def inflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(1).to_pylist():
                try:
                    if data[:4] != MAGIC:
                        raise ValueError
                    raw = zlib.decompress(data[HEADER_BYTES:])
                    out.append(_expand(list(struct.unpack(f"<{len(raw) // 4}I", raw))))
                except (zlib.error, struct.error, ValueError, IndexError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["id", "ids"])

    listed = packed.select(F.col("id").cast("long").alias("id"), "payload").mapInArrow(inflate, "id long, ids array<long>")
    shared = _looked_up(words, size)
    if shared is not None:

        def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = shared.value.to_pylist()
            for batch in batches:
                texts = [None if ids is None else _text_of(ids, table, size) for ids in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

        return listed.mapInArrow(spell, "id long, text string")
    placed = listed.where("ids is not null").select("id", F.posexplode_outer("ids").alias("pos", "token_id"), F.col("ids"))
    # a code point follows its marker; the marker itself stands for nothing
    placed = placed.withColumn("marked", F.when(F.col("pos") > 0, F.element_at("ids", F.col("pos")) == CODE_POINT).otherwise(False)).drop("ids")
    named = placed.join(broadcast_if_small(words.select("token", "token_id")), "token_id", "left")
    char = lambda c: F.when(c < 0x10000, F.decode(F.unhex(F.lpad(F.hex(c), 4, "0")), "UTF-16BE")).otherwise(F.decode(F.unhex(F.concat(F.lpad(F.hex(((c - 0x10000) / 1024).cast("long") + 0xD800), 4, "0"), F.lpad(F.hex((c - 0x10000) % 1024 + 0xDC00), 4, "0"))), "UTF-16BE"))
    piece = (
        F.when(F.col("marked"), char(F.col("token_id")))
        .when(F.col("token_id") == CODE_POINT, "")
        .when((F.col("token_id") >= size) & (F.col("token_id") < size + 128), F.decode(F.unhex(F.lpad(F.hex(F.col("token_id") - size), 2, "0")), "UTF-8"))
        .otherwise(F.coalesce("token", F.lit("")))
    )
    joined = named.select("id", "pos", piece.alias("piece")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    return listed.select("id", F.col("ids").isNull().alias("bad")).join(joined, "id", "left").select("id", F.when(~F.col("bad"), F.coalesce(F.array_join(F.transform("p", lambda x: x["piece"]), ""), F.lit(""))).alias("text"))


def verify(texts: DataFrame, packed: DataFrame, words: DataFrame, size: int) -> DataFrame:
    """``(id, length_ok, checksum_ok, lossless)`` of every payload against its text."""
    restored = decode(packed, words, size).withColumnRenamed("text", "restored")
    rows = texts.where("text is not null").select("id", "text").join(headers(packed), "id").join(restored, "id")
    data = F.col("restored").cast("binary")
    return rows.select("id", (F.octet_length("restored") == F.col("bytes")).alias("length_ok"), (checksum16(data) == F.col("checksum")).alias("checksum_ok"), F.coalesce(F.col("restored") == F.col("text"), F.lit(False)).alias("lossless"))
