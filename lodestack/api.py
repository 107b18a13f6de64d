"""The store as one object: create, append, delete, index, search, read, verify, inspect.

A store is a folder of Parquet tables.  Queries are always a table ``(query_id, query)``; one query is
the case of one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.operators import codec, index, rank, store
from lodestack.session import broadcast_if_small, materialize

ENTRY = "doc_id long, title string, path string, text string, language_id int, stored_at timestamp"


class Store:
    """Documents with payloads, a vocabulary and an index below ``root``.

    ``append`` and ``delete`` only add rows, also to payloads and index, so what they write can be read and found
    at once.  ``create`` and ``reindex`` write tables anew and must not run beside readers of the same folder.
    """

    def __init__(self, spark: SparkSession, root: str, vocabulary_size: int = 20_000):
        self.spark, self.root, self.size = spark, root.rstrip("/"), vocabulary_size

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    @classmethod
    def create(cls, spark: SparkSession, root: str, documents: DataFrame, vocabulary_size: int = 20_000) -> Store:
        """A new store of ``doc_id, title, path, text``; paths must be safe, and the latest row of an id counts."""
        made = cls(spark, root, vocabulary_size)
        rows = materialize(made._checked(documents), "documents")
        rows.write.mode("overwrite").parquet(f"{made.root}/documents")
        rows.limit(0).select("doc_id", F.current_timestamp().alias("deleted_at")).write.mode("overwrite").parquet(f"{made.root}/tombstones")
        made.reindex()
        return made

    def documents(self) -> DataFrame:
        """Current documents: the latest row of every id that no later tombstone removes."""
        rows = index.latest(self._read("documents"), ["doc_id"], ["title", "path", "text", "language_id", "stored_at"], "stored_at")
        gone = self._read("tombstones").groupBy("doc_id").agg(F.max("deleted_at").alias("deleted_at"))
        return rows.join(gone, "doc_id", "left").where(F.col("deleted_at").isNull() | (F.col("deleted_at") < F.col("stored_at"))).drop("deleted_at")

    @staticmethod
    def _checked(documents: DataFrame) -> DataFrame:
        """Rows as the store keeps them; a path that leaves the store is an error."""
        rows = documents.withColumn("language_id", T.language_of(F.col("path"))).withColumn("stored_at", F.current_timestamp())
        if rows.where(F.col("path").isNotNull() & T.unsafe_path(F.col("path"))).limit(1).count():
            raise ValueError("a document's path leaves the store")
        return rows.select("doc_id", "title", "path", "text", "language_id", "stored_at")

    @property
    def index(self) -> index.TextIndex:
        return index.TextIndex(self.spark, f"{self.root}/index")

    def append(self, documents: DataFrame) -> None:
        """Add documents or replace those with the same id: as rows, as payloads and in the index."""
        rows = materialize(self._checked(documents), "appended")
        rows.write.mode("append").parquet(f"{self.root}/documents")
        fresh = index.latest(rows, ["doc_id"], ["title", "path", "text", "language_id"], "stored_at")
        self._pack(fresh, "append")
        self.index.append(fresh)

    def delete(self, ids: DataFrame) -> None:
        """Remove the documents of ``ids(doc_id)`` by tombstones; appended again, they are back."""
        ids.select("doc_id", F.current_timestamp().alias("deleted_at")).write.mode("append").parquet(f"{self.root}/tombstones")
        self.index.delete(ids)

    def _pack(self, docs: DataFrame, mode: str) -> None:
        texts = docs.where("text is not null").select(F.col("doc_id").alias("id"), "text", "language_id")
        packed = codec.encode(texts, self._read("vocabulary"), self.size).withColumn("packed_at", F.current_timestamp())
        packed.write.mode(mode).parquet(f"{self.root}/payloads")

    def _payloads(self) -> DataFrame:
        """The latest payload of every current document."""
        last = self._read("payloads").groupBy("id").agg(F.max(F.struct("packed_at", "payload")).alias("p")).select("id", "p.payload")
        return last.join(self.documents().where("text is not null").select(F.col("doc_id").alias("id")), "id", "left_semi")

    def reindex(self) -> None:
        """Write vocabulary, payloads and index of the current documents anew."""
        docs = materialize(self.documents(), "current")
        texts = docs.where("text is not null").select(F.col("doc_id").alias("id"), "text", "language_id")
        codec.vocabulary(texts, self.size).write.mode("overwrite").parquet(f"{self.root}/vocabulary")
        self._pack(docs, "overwrite")
        index.TextIndex.build(docs, f"{self.root}/index")

    def search(self, queries: DataFrame, k: int = 5, snippet: int = 240) -> DataFrame:
        """``(query_id, rank, doc_id, path, score, snippet)`` by the index; snippets come from the whole texts of the results."""
        found = materialize(rank.bm25(index.SearchSpace(self.index, queries), k=k, k1=1.2, title_boost=1.0), "found")
        texts = self.index.table("documents").select("doc_id", "path", "text").join(broadcast_if_small(found.select("doc_id").distinct()), "doc_id", "left_semi")
        rows = found.join(texts, "doc_id").join(queries.select("query_id", "query"), "query_id")
        return rows.select("query_id", "rank", "doc_id", "path", "score", T.windowed_snippet(F.col("text"), T.snippet_terms("query"), snippet).alias("snippet"))

    def read(self, ids: DataFrame) -> DataFrame:
        """``(doc_id, text)`` decoded from the payloads of ``ids(doc_id)`` only."""
        wanted = self._payloads().join(ids.select(F.col("doc_id").alias("id")), "id", "left_semi")
        return codec.decode(wanted, self._read("vocabulary"), self.size).withColumnRenamed("id", "doc_id")

    def verify(self) -> DataFrame:
        """One row ``(documents, perfect, failed)`` of all payloads against their texts."""
        texts = self.documents().select(F.col("doc_id").alias("id"), "text")
        checked = codec.verify(texts, self._payloads(), self._read("vocabulary"), self.size)
        ok = (F.col("length_ok") & F.col("checksum_ok") & F.col("lossless")).cast("int")
        return checked.agg(F.count("*").alias("documents"), F.coalesce(F.sum(ok), F.lit(0)).alias("perfect"), F.coalesce(F.sum(1 - ok), F.lit(0)).alias("failed"))

    def inspect(self) -> DataFrame:
        """One row ``(documents, original_bytes, payload_bytes, ratio)``."""
        sizes = self._payloads().select("id", F.octet_length("payload").alias("spec_size"), F.conv(F.hex(F.substring("payload", 9, 4)), 16, 10).cast("long").alias("original_size"), F.lit(0).alias("pack_id"))
        return store.inspect(sizes).select(F.col("entries").alias("documents"), "original_bytes", F.col("spec_bytes").alias("payload_bytes"), "ratio")


def encrypted(payloads: DataFrame, key: bytes, aad: str = "lodestack") -> DataFrame:
    """``(id, sealed BINARY)``: AES-GCM with the id's pack name as authenticated data; derive ``key`` with :func:`derive_key`."""
    return payloads.select("id", F.aes_encrypt("payload", F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.lit(aad)).alias("sealed"))


def decrypted(sealed: DataFrame, key: bytes, aad: str = "lodestack") -> DataFrame:
    """``(id, payload)``; null where key, data or authenticated text do not fit."""
    return sealed.select("id", F.try_aes_decrypt("sealed", F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(aad)).alias("payload"))


def derive_key(passphrase: str, salt: bytes, profile: str = "interactive") -> bytes:
    """A 256-bit key by scrypt; one call per pack, on the driver."""
    import hashlib

    cost = {"low-memory": 2**14, "interactive": 2**15, "strong": 2**17}[profile]
    return hashlib.scrypt(passphrase.encode(), salt=salt, n=cost, r=8, p=1, maxmem=256 * 1024 * 1024, dklen=32)
