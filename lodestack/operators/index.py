"""Inverted index tables: term frequencies, document lengths, document frequencies, postings.

Posting lists come in segments of ``SEGMENT`` document ids, since the list of a common term grows
with the collection and must not end up in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions.text import raw_terms
from lodestack.session import broadcast_if_small, materialize

SEGMENT = 4096


def latest(df: DataFrame, key: list[str], columns: list[str], order: str) -> DataFrame:
    """The copy of every record with the greatest ``order``; records delivered again count once."""
    best = df.groupBy(*key).agg(F.max(F.struct(F.col(order).alias("_at"), *[c for c in columns if c not in key])).alias("_r"))
    return best.select(*key, *[F.col(f"_r.{c}").alias(c) for c in columns if c not in key])


def latest_apart(df: DataFrame, key: list[str], columns: list[str], order: str) -> DataFrame:
    """:func:`latest` of rows without null keys, in which only records delivered again are shuffled; the others pass where they lie."""
    again = materialize(df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key), "again")
    once = df.join(broadcast_if_small(again), key, "left_anti").select(*key, *[c for c in columns if c not in key])
    return once.union(latest(df.join(broadcast_if_small(again), key, "left_semi"), key, columns, order))


def tokenized(docs: DataFrame, text: Column | str = "text") -> DataFrame:
    """``(doc_id, dl, terms)`` of documents; ``dl`` counts all terms."""
    terms = raw_terms(text)
    return docs.select("doc_id", terms.alias("terms")).withColumn("dl", F.size("terms"))


def term_freq(docs: DataFrame, text: Column | str = "text") -> DataFrame:
    """``(doc_id, term, tf)``."""
    return tokenized(docs, text).select("doc_id", F.explode("terms").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def doc_stats(docs: DataFrame, text: Column | str = "text") -> DataFrame:
    """``(doc_id, dl, distinct_terms)``, without a shuffle."""
    return tokenized(docs, text).select("doc_id", "dl", F.size(F.array_distinct("terms")).alias("distinct_terms"))


def corpus_stats(docs: DataFrame, text: Column | str = "text") -> DataFrame:
    """One row ``(n_docs, total_terms, avgdl)``."""
    return tokenized(docs, text).agg(F.count("*").alias("n_docs"), F.sum("dl").alias("total_terms"), F.round(F.avg("dl"), 2).alias("avgdl"))


def inverse_frequency(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1)


def idf_table(docs: DataFrame, n_docs: int, text: Column | str = "text") -> DataFrame:
    """``(term, df, df_ratio, idf)``: distinct terms of each document, counted with partial sums."""
    terms = docs.select(F.explode(F.array_distinct(raw_terms(text))).alias("term"))
    counted = terms.groupBy("term").agg(F.count("*").alias("df"))
    return counted.select("term", "df", (F.col("df") / n_docs).alias("df_ratio"), inverse_frequency(F.lit(float(n_docs)), F.col("df")).alias("idf"))


def postings_segments(tf: DataFrame) -> DataFrame:
    """``(term, segment, doc_ids, tfs)``: document ids ascending, at most ``SEGMENT`` a row."""
    rows = tf.withColumn("segment", F.expr(f"doc_id DIV {SEGMENT}"))
    listed = rows.groupBy("term", "segment").agg(F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("p"))
    return listed.select("term", "segment", F.col("p.doc_id").alias("doc_ids"), F.col("p.tf").alias("tfs"))


def postings_gaps(tf: DataFrame) -> DataFrame:
    """``(term, segment, doc_id, gap)``: distance to the segment's previous document, or its start."""
    rows = tf.withColumn("segment", F.expr(f"doc_id DIV {SEGMENT}"))
    order = Window.partitionBy("term", "segment").orderBy("doc_id")
    before = F.coalesce(F.lag("doc_id").over(order), F.col("segment") * SEGMENT)
    return rows.select("term", "segment", "doc_id", (F.col("doc_id") - before).alias("gap"))


#: Tables of a :class:`TextIndex` that hold something of every document.
_TABLES = ("documents", "postings", "titles", "paths", "fields", "positions")


class TextIndex:
    """The index tables of a collection below a folder, written once and read by every search.

    ``documents`` holds the documents with their number of terms, ``postings (term, doc_id, tf, dl)``, ``titles``
    and ``paths (term, doc_id)``, ``fields`` the word arrays that re-ranking compares, ``positions`` up to eight
    places of every code word.  Postings are sorted by term and the others by document, so that a search reads
    the row groups it needs.  Every row carries the ``version`` of the write that made it: :meth:`append` adds
    rows to all tables, and of a document only the rows of its latest version count, none after :meth:`delete`.
    Null ids are left out; null texts, titles and paths have no terms.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    @classmethod
    def build(cls, docs: DataFrame, root: str, text: Column | str = "text") -> TextIndex:
        """Index ``docs (doc_id, title, path, text, ...)``, one row per id."""
        made = cls(docs.sparkSession, root)
        made._write(docs, 0, text)
        made.spark.createDataFrame([], "doc_id long, version long").write.mode("overwrite").parquet(f"{made.root}/gone")
        return made

    def _write(self, docs: DataFrame, version: int, text: Column | str = "text") -> None:
        from lodestack.functions import fields as words

        text = F.col(text) if isinstance(text, str) else text
        mode, of = ("append" if version else "overwrite"), F.lit(version).cast("long").alias("version")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        save = lambda df, name, key: df.withColumn("version", of).sortWithinPartitions(*key).write.mode(mode).option("parquet.block.size", 16 << 20).parquet(f"{self.root}/{name}")
        ranged = lambda df, name, key: save(df.repartitionByRange(*key), name, key)
        # ranges are found by running what comes before them, so terms are counted after; the number of parts keeps small files from being one
        placed = docs.where("doc_id is not null").repartitionByRange(parts, "doc_id")
        save(placed.withColumn("dl", F.size(raw_terms(text))), "documents", ["doc_id"])
        kept = self._read("documents").where(F.col("version") == version).drop("version")
        tf = kept.select("doc_id", "dl", F.explode(raw_terms(text)).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
        ranged(tf, "postings", ["term", "doc_id"])
        ranged(kept.select("doc_id", F.explode(F.array_distinct(raw_terms("title"))).alias("term")), "titles", ["term", "doc_id"])
        ranged(kept.select("doc_id", F.explode(words.path_words(F.col("path"))).alias("term")), "paths", ["term", "doc_id"])
        # the documents lie in ranges already
        save(words.field_words(kept).drop("text"), "fields", ["doc_id"])
        save(words.placed_words(kept), "positions", ["doc_id", "word"])

    def _versions(self) -> int:
        return self._read("documents").agg(F.max("version")).first()[0] or 0

    def append(self, docs: DataFrame) -> None:
        """Index more documents; those with a known id replace it."""
        self._write(docs, self._versions() + 1)

    def delete(self, ids: DataFrame) -> None:
        """Leave the documents of ``ids(doc_id)`` out until they are appended again."""
        ids.select("doc_id", F.lit(self._versions()).cast("long").alias("version")).write.mode("append").parquet(f"{self.root}/gone")

    def table(self, name: str) -> DataFrame:
        """The current rows of a table."""
        rows = self._read(name)
        gone = self._read("gone")
        if gone.isEmpty() and not self._versions():
            return rows.drop("version")
        last = self._read("documents").groupBy("doc_id").agg(F.max("version").alias("version"))
        left = gone.groupBy("doc_id").agg(F.max("version").alias("until"))
        live = last.join(left, "doc_id", "left").where(F.col("until").isNull() | (F.col("until") < F.col("version"))).select("doc_id", "version")
        return rows.join(live, ["doc_id", "version"], "left_semi").drop("version")


class SearchSpace:
    """What a batch of queries needs of a collection: matching postings, lengths and frequencies.

    ``docs`` holds ``doc_id, title, text``, or is a :class:`TextIndex`; ``queries`` holds ``query_id, query``.
    Only terms that some query names leave the scan.  Null queries and texts have no terms and match nothing.
    """

    def __init__(self, docs: DataFrame | TextIndex, queries: DataFrame, text: Column | str = "text", query_terms: Column | None = None):
        self.queries = queries
        words = queries.select("query_id", F.explode(query_terms if query_terms is not None else raw_terms("query")).alias("term"))
        # sums are kept by a number for each query, which is cheaper to group by than its id
        self.numbers = materialize(queries.select("query_id").distinct().coalesce(1).withColumn("qn", F.monotonically_increasing_id()), "numbers")
        numbered = words.groupBy("query_id", "term").agg(F.count("*").alias("qtf")).join(broadcast_if_small(self.numbers), "query_id")
        self.query_terms = materialize(numbered.select("query_id", "qn", "term", "qtf"), "query-terms")
        wanted = broadcast_if_small(materialize(self.query_terms.select("term").distinct(), "terms"))
        if isinstance(docs, TextIndex):
            self.docs = docs.table("documents")
            sizes, postings, titles = self.docs, docs.table("postings"), docs.table("titles")
            self.postings = postings.join(wanted, "term", "left_semi").select("term", "doc_id", "dl", "tf")
        else:
            self.docs = docs
            sizes = tokenized(docs, text)
            matched = sizes.select("doc_id", "dl", F.explode("terms").alias("term")).join(wanted, "term").groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))
            self.postings = materialize(matched, "postings")
            titles = docs.select("doc_id", F.explode(F.array_distinct(raw_terms("title"))).alias("term")) if "title" in docs.columns else None
        row = sizes.agg(F.count("*"), F.avg("dl")).first()
        self.n_docs, self.avgdl = int(row[0]), float(row[1] or 0.0)
        counted = self.postings.groupBy("term").agg(F.count("*").alias("df"))
        self.idf = materialize(counted.select("term", "df", (F.col("df") / self.n_docs).alias("df_ratio"), inverse_frequency(F.lit(float(self.n_docs)), F.col("df")).alias("idf")), "idf")
        self.titles = titles.join(wanted, "term", "left_semi") if titles is not None else None
