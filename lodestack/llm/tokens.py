"""Text sizes in tokens of a public tokenizer, with a small hashed vector of each text."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.session import materialize

#: Default vocabulary file; any file of "base64-token rank" lines will do.  It is read on the driver and sent to the executors.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE vocabularies of this kind split a text before merging (a fixed value).
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODINGS: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of a vocabulary file that was sent to the executors, loaded once per Python worker."""
    import tiktoken
    from pyspark import SparkFiles

    if path not in _ENCODINGS:
        with open(SparkFiles.get(os.path.basename(path)), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        _ENCODINGS[path] = tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def token_table(documents: DataFrame, id_col: str, text_col: str, keep: dict[str, Column] | None = None, tokenizer: str = TOKENIZER, dims: int = 0) -> DataFrame:
    """``(doc_id, *keep, n_tokens, vector)``: one row per id, tokenized once and kept as a table.

    ``vector`` sums one pseudo-random direction per token, weighted by the logarithm of the token's
    rank (frequent tokens have low ranks), over the number of tokens; it is empty if ``dims`` is 0.
    Null ids and texts are left out, an empty text has 0 tokens.  Of rows repeated under one id one
    counts, the one with the most tokens.
    """
    keep = keep or {}
    documents.sparkSession.sparkContext.addFile(tokenizer)
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), *[c.cast("string").alias(k) for k, c in keep.items()], F.col(text_col).cast("string").alias("text"))
    rows = rows.where("doc_id is not null and text is not null")
    names, extra = list(keep), len(keep)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer)
        table = np.random.default_rng(7).standard_normal((enc.n_vocab + 1, dims), dtype=np.float32) * np.log1p(np.arange(enc.n_vocab + 1, dtype=np.float32))[:, None]
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                coded = [np.array(enc.encode_ordinary(t), np.int64) for t in batch.column(extra + 1).to_pylist()]
                sizes = np.array([len(c) for c in coded], np.int64)
                vectors = [table[c].mean(axis=0) if dims and len(c) else np.zeros(dims, np.float32) for c in coded]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(coded) * dims + 1, dims, dtype=np.int32) if dims else np.zeros(len(coded) + 1, np.int32)), pa.array(np.concatenate(vectors) if coded else np.zeros(0, np.float32)))
                yield pa.RecordBatch.from_arrays([*batch.columns[: extra + 1], pa.array(sizes), flat], names=["doc_id", *names, "n_tokens", "vector"])

    schema = ", ".join(["doc_id long", *[f"`{k}` string" for k in keep], "n_tokens long", "vector array<float>"])
    measured = rows.mapInArrow(measure, schema)
    best = measured.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "vector", *keep)).alias("r"))
    return materialize(best.select("doc_id", *[F.col(f"r.{k}").alias(k) for k in keep], "r.n_tokens", "r.vector"), "tokens")
