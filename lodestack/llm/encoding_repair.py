"""Texts that were decoded with the wrong character encoding: find them, undo it.

A multinomial classifier over hashed byte bigrams (of the text's UTF-8 form, only bigrams with a
non-ASCII byte) tells the exact chain of encodings that a passage went through.  It is fitted on
synthetically garbled passages: a bounded sample of records is put through every chain.  Spark counts
the features of the sample and applies the model to every passage of every record.

A prediction alone changes nothing.  The chain is inverted, and only a passage that encodes and
decodes strictly, in every character, and that the model then finds likelier as clean text than it was
before, is replaced.  So a
text that shows garbled characters beside the right ones, to describe them, stays as it is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators.records import latest_records

#: Single-byte encodings with which UTF-8 is misread.
MISREADERS = ("cp1252", "cp1250", "cp1251", "cp1254", "cp1257", "iso8859_2", "iso8859_5", "iso8859_15", "koi8_r", "cp437", "cp850", "cp852", "cp866", "mac_roman", "mac_cyrillic")
#: Pairs of single-byte encodings (written in, read in) that stand for one another.
SWAPPED = (
    ("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("cp866", "cp1252"), ("iso8859_5", "cp1252"), ("mac_cyrillic", "cp1252"),
    ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("koi8_r", "cp866"), ("iso8859_5", "cp1251"),
    ("cp1250", "cp1252"), ("iso8859_2", "cp1252"), ("cp852", "cp1252"), ("cp1250", "iso8859_2"), ("iso8859_2", "cp1250"),
    ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp1251"), ("cp1252", "cp1250"), ("cp1252", "koi8_r"),
    ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"),
)
#: A chain is a tuple of (written in, read in) steps, the first mistake first.
CHAINS: tuple[tuple[tuple[str, str], ...], ...] = (
    *((("utf-8", e),) for e in MISREADERS),
    *((pair,) for pair in SWAPPED),
    (("utf-8", "cp1252"), ("utf-8", "cp1252")),
    (("utf-8", "cp1252"), ("utf-8", "cp1252"), ("utf-8", "cp1252")),
    (("utf-8", "cp437"), ("utf-8", "cp437")),
    (("utf-8", "cp850"), ("utf-8", "cp850")),
    (("utf-8", "mac_roman"), ("utf-8", "mac_roman")),
)
#: Class numbers: 0 is clean, then the chains.
CLEAN = 0
BUCKETS = 1 << 14
_PASSAGE = re.compile(r"((?:\r?\n)[ \t]*(?:\r?\n)\s*)")
_LINE = re.compile(r"(\r?\n)")
_FOREIGN = re.compile("[^\x00-\x7f]+")
_QUOTED = re.compile("(?:(?<=\")[^\x00-\x7f]{1,12}(?=\")|(?<=')[^\x00-\x7f]{1,12}(?=')|(?<=`)[^\x00-\x7f]{1,12}(?=`))")


def _table(encoding: str) -> dict[int, str]:
    """Byte to character; bytes that a Windows page leaves open become control characters, as browsers do."""
    out = {}
    for byte in range(256):
        try:
            out[byte] = bytes([byte]).decode(encoding)
        except UnicodeDecodeError:
            if encoding.startswith("cp125"):
                out[byte] = chr(byte)
    return out


_READ = {e: _table(e) for e in {*MISREADERS, *(e for pair in SWAPPED for e in pair)}}
_WRITE = {e: {c: b for b, c in table.items()} for e, table in _READ.items()}
# ISO 8859-1 text read by this name comes with C1 controls where Windows-1252 has letters
for _byte in range(0x80, 0xA0):
    _WRITE["cp1252"].setdefault(chr(_byte), _byte)


def _encode(text: str, encoding: str) -> bytes | None:
    if encoding == "utf-8":
        return text.encode("utf-8", "surrogatepass")
    try:
        return bytes(map(_WRITE[encoding].__getitem__, text))
    except KeyError:
        return None


def _decode(data: bytes, encoding: str) -> str | None:
    if encoding == "utf-8":
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            return None
    try:
        return "".join(map(_READ[encoding].__getitem__, data))
    except KeyError:
        return None


def _step(text: str, by: str, to: str) -> str | None:
    """Every non-ASCII run of ``text`` encoded ``by`` and decoded ``to``, strictly."""
    out, last = [], 0
    for run in _FOREIGN.finditer(text):
        data = _encode(run.group(), by)
        fixed = None if data is None else _decode(data, to)
        if fixed is None:
            return None
        out += [text[last : run.start()], fixed]
        last = run.end()
    return "".join([*out, text[last:]])


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """``text`` after the mistakes of ``chain``, or None where a character has no place in it."""
    for written, read in chain:
        if (text := _step(text, written, read)) is None:
            return None
    return text


def restore(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text before the mistakes of ``chain``, or None if it can't have gone through them."""
    for written, read in reversed(chain):
        if (text := _step(text, read, written)) is None:
            return None
    return text


def _bigrams(text: str) -> np.ndarray:
    """All byte bigrams with a non-ASCII byte, as 16-bit numbers."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    pair = (data[:-1] << 8) | data[1:]
    return pair[(data[:-1] | data[1:]) >= 0x80]


def _bucket(pair: np.ndarray) -> np.ndarray:
    return ((pair.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(18)) % BUCKETS


def features(text: str) -> np.ndarray:
    """Buckets of the text's bigrams."""
    return _bucket(_bigrams(text))


class Model:
    """Multinomial log-probabilities of buckets by class, and how usual clean bytes follow each other.

    ``prior`` is the log-odds that clean has over a chain, and the least gain of a repair.
    """

    def __init__(self, counts: np.ndarray, prior: float = 4.0):
        smooth = counts + 0.05
        self.weights = np.log(smooth / smooth.sum(axis=1, keepdims=True))
        self.weights[counts.sum(axis=1) == 0] = -40.0  # a chain that no passage of the sample fits
        self.prior = prior
        pair = np.arange(1 << 16, dtype=np.uint32)
        clean = np.where((pair & 0x8080) > 0, counts[CLEAN][_bucket(pair)], 0.0).reshape(256, 256) + 0.01
        self.follows = np.log(clean / clean.sum(axis=1, keepdims=True)).ravel().astype(np.float32)

    def scores(self, text: str) -> np.ndarray:
        """By class; adds the prior to clean."""
        score = self.weights[:, features(text)].sum(axis=1)
        score[CLEAN] += self.prior
        return score

    def cleanness(self, text: str) -> float:
        """Log-probability of each byte after the one before it, in clean text."""
        return float(self.follows[_bigrams(text)].sum())


def _passages(text: str) -> list[str]:
    """Paragraphs and what stands between them, in turn."""
    return _PASSAGE.split(text)


def fit(records: DataFrame, text_col: str = "text", sample_rows: int = 1500) -> Model:
    """The classifier, from about ``sample_rows`` records with non-ASCII characters, chosen by a hash of their text.

    Passages that some UTF-8 chain inverts strictly, or that hold U+FFFD or control characters, do not
    serve as clean examples.
    """
    foreign = records.where(F.col(text_col).rlike("[^\\x00-\\x7f]")).select(F.col(text_col).alias("text"))
    share = min(1.0, sample_rows / max(1, foreign.count()))
    sample = foreign.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(CHAINS) + 1, BUCKETS), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for passage in _passages(text)[::2]:
                    if not _FOREIGN.search(passage) or re.search("[�\x80-\x9f]", passage) or any(restore(passage, (("utf-8", e),)) is not None for e in MISREADERS):
                        continue
                    table[CLEAN] += np.bincount(features(passage), minlength=BUCKETS)
                    for number, chain in enumerate(CHAINS, 1):
                        wrong = garble(passage, chain)
                        if wrong is not None and wrong != passage:
                            table[number] += np.bincount(features(wrong), minlength=BUCKETS)
        kind, bucket = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(table[kind, bucket])], names=["kind", "bucket", "n"])

    counts = np.zeros((len(CHAINS) + 1, BUCKETS))
    summed = sample.mapInArrow(count, "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))
    for row in summed.collect():  # at most classes x buckets, whatever the input
        counts[row.kind, row.bucket] = row.n
    return Model(counts)


def _options(passage: str, model: Model, hints: list[int]) -> dict[int, tuple[float, str]]:
    """The chains that may have garbled a passage, each with the gain of undoing it and the restored passage."""
    runs = _FOREIGN.findall(passage)
    quoted = len(_QUOTED.findall(passage)) == len(runs)
    if not runs or (quoted and not hints):
        return {}  # no characters, or only quoted ones: a description, unless the record is garbled elsewhere
    score, clean = model.scores(passage), model.cleanness(passage)
    out = {}
    for kind in {*([] if quoted else np.argsort(score)[::-1][:8].tolist()), *hints} - {CLEAN}:
        if score[kind] <= score[CLEAN] and kind not in hints:
            continue
        fixed = restore(passage, CHAINS[kind - 1])
        if fixed is None or fixed == passage:
            continue
        # undoing a chain is one-to-one, so both texts are equally likely a priori: the cleaner one wins
        gain = model.cleanness(fixed) - clean
        if gain > model.prior:
            out[kind] = (float(gain), fixed)
    return out


def mend(text: str, model: Model) -> tuple[str | None, str]:
    """The whole original text and the chain; the text is None where characters are lost for good.

    The chain is '' for a text that is not garbled.  One chain is sought for the whole record: the one
    whose undoing gains most over all passages.  Passages that it does not fit may have another one.
    A paragraph that no chain fits as a whole is tried line by line.  Quoted characters alone prove no
    chain and no loss, as they may describe one, but they share in what the rest of the record proves.
    """
    if any("�" in _QUOTED.sub("", part) for part in _passages(text)[::2]):
        return None, "lost"
    parts = []
    for i, part in enumerate(_passages(text)):
        options = _options(part, model, []) if not i % 2 else {}
        parts += [part] if options or i % 2 or "\n" not in part else _LINE.split(part)
    options = [_options(part, model, []) for part in parts]
    used: list[int] = []
    while any(options):
        gains: dict[int, float] = {}
        for option in options:
            for kind, (gain, _) in option.items():
                gains[kind] = gains.get(kind, 0.0) + gain
        best = max(gains, key=lambda k: (round(gains[k], 6), -k))
        used.append(best)
        for i, part in enumerate(parts):
            # passages too short to tell by themselves follow the record's chain
            option = options[i] or _options(part, model, used)
            if best in option:
                parts[i], options[i] = option[best][1], {}
    chain = "|".join(">".join(f"{w}>{r}" for w, r in CHAINS[k - 1]) for k in used)
    whole = "".join(parts)
    return (None, "lost") if used and "�" in whole else (whole, chain)


def garbled_records(df: DataFrame, id_col: str, text_col: str, order_col: str | None = None, *, sample_rows: int = 1500) -> DataFrame:
    """``(id, chain, restored)`` of every garbled record; ``restored`` is null where characters are lost.

    Records repeated under one id count once (the latest copy).  Null ids and texts, blank and purely
    ASCII texts are never garbled; an empty table gives an empty result.  ``chain`` names the steps as
    written>read, several chains of one record are joined by ``|``.
    """
    from lodestack.session import materialize

    latest = materialize(latest_records(df, id_col, text_col, order_col).where(F.col("text").rlike("[^\\x00-\\x7f]")), "foreign")
    model = fit(latest, "text", sample_rows)

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out = [(i, chain, fixed) for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for fixed, chain in [mend(text, model)] if chain]
                ids, chains, texts = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(chains, pa.string()), pa.array(texts, pa.string())], names=["id", "chain", "restored"])

    return latest.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(repair, "id long, chain string, restored string")


def restored_digests(garbled: DataFrame) -> DataFrame:
    """``(id, restored_md5)``; the digest is '' where characters are lost."""
    return garbled.select("id", F.coalesce(F.md5(F.col("restored").cast("binary")), F.lit("")).alias("restored_md5"))


def text_digest(text: str) -> str:
    """The digest of one text, for tests."""
    return hashlib.md5(text.encode("utf-8")).hexdigest()
