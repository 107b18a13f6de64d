"""Words of a document's path, names and text that re-ranking compares with a query's."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import text as T

# What declares and what imports a name.
DECLARED = r"\b(?:def|function|func|fn|class|interface|type|struct|enum|const|let|var|export\s+(?:default\s+)?)\s+([A-Za-z_][A-Za-z0-9_]*)"
IMPORTED = r"""\b(?:import|from|require)\b[^"'\n]*["']([^"']+)["']"""


def path_words(path: Column) -> Column:
    """Code words of a path's parts and of its stem."""
    return T.code_words(F.concat_ws(" ", F.array_join(T.path_parts(path), " "), T.file_stem(path)))


def field_words(docs: DataFrame) -> DataFrame:
    """``(doc_id, path_words, name_words, identifier_words, structure_words)``, each sorted and distinct."""
    path = F.col("path")
    declared = F.regexp_extract_all("text", F.lit(DECLARED), F.lit(1))
    imported = F.regexp_extract_all("text", F.lit(IMPORTED), F.lit(1))
    return docs.select(
        "doc_id", "path", "text",
        path_words(path).alias("path_words"),
        T.code_words(T.file_stem(path)).alias("stem_words"),
        T.code_words(T.file_name(path)).alias("name_words"),
        T.code_words(F.col("text")).alias("identifier_words"),
        T.code_words(F.array_join(F.concat(declared, imported), " ")).alias("structure_words"),
    )


def word_positions(docs: DataFrame) -> DataFrame:
    """``(doc_id, word, pos)``: up to eight ordinals of the identifiers that hold a code word."""
    identifiers = docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(T.IDENTIFIER), F.lit(0))).alias("pos", "identifier"))
    words = identifiers.select("doc_id", "pos", F.explode(T.code_words(F.col("identifier"))).alias("word"))
    order = Window.partitionBy("doc_id", "word").orderBy("pos")
    return words.withColumn("rn", F.row_number().over(order)).where("rn <= 8").drop("rn")


_IDENTIFIER, _WORD = re.compile(T.IDENTIFIER), re.compile("[a-z0-9]+")
_BEFORE_CAPITAL, _BEFORE_LAST_CAPITAL = re.compile("([a-z0-9])([A-Z])"), re.compile("([A-Z])([A-Z][a-z])")


@lru_cache(1 << 17)
def _words(identifier: str) -> tuple[str, ...]:
    """:func:`lodestack.functions.text.code_words` of one identifier."""
    spaced = _BEFORE_LAST_CAPITAL.sub(r"\1 \2", _BEFORE_CAPITAL.sub(r"\1 \2", identifier))
    return tuple({w: None for w in _WORD.findall(spaced.lower()) if len(w) >= 2 and not w.isdigit()})


def placed_words(docs: DataFrame, places: int = 8) -> DataFrame:
    """:func:`word_positions` of documents with one row each, document by document: identifiers recur, so their words are kept."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows, words, at = [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    seen: dict[str, int] = {}
                    for pos, identifier in enumerate(_IDENTIFIER.findall(text or "")):
                        for word in _words(identifier):
                            n = seen.get(word, 0)
                            if n < places:
                                seen[word] = n + 1
                                rows.append(row)
                                words.append(word)
                                at.append(pos)
                ids = part.column(0).take(pa.array(rows, pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(words, pa.string()), pa.array(at, pa.int32())], names=["doc_id", "word", "pos"])

    return docs.select("doc_id", "text").mapInArrow(place, f"doc_id {kind}, word string, pos int")


# Java's and SQL's blanks and word boundaries in these patterns are ASCII
_DECLARED, _IMPORTED = re.compile(DECLARED, re.ASCII), re.compile(IMPORTED, re.ASCII)
_DOTS, _STEM = re.compile(r"(?:\./)+"), re.compile("([^\n\r\u0085\u2028\u2029]+)\\.[^./]+")


def _stem(name: str) -> str:
    """:func:`lodestack.functions.text.file_stem` of a file name."""
    found = _STEM.fullmatch(name)
    return found[1] if found else name


class _Kept(dict):
    """The words of identifiers that some query names; most have none."""

    def __init__(self, vocabulary: frozenset[str]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, identifier: str) -> tuple[str, ...]:
        found = tuple(w for w in _words(identifier) if w in self.vocabulary)
        if len(self) < 1 << 17:
            self[identifier] = found
        return found


ASKED = "doc_id long, path string, path_words array<string>, stem_words array<string>, name_words array<string>, identifier_words array<string>, structure_words array<string>, places map<string,array<int>>"


def asked_words(docs: DataFrame, vocabulary: Iterable[str], places: int | None = 8) -> DataFrame:
    """:func:`field_words` and, as a map, :func:`word_positions` of documents with one row each; of what stands in the text only words of ``vocabulary``.

    ``places`` is how many places of a word are kept, None for every one.
    """
    most = math.inf if places is None else places
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))
    kinds = pa.schema([("doc_id", pa.int64()), ("path", pa.string()), *[(name, pa.list_(pa.string())) for name in ("path_words", "stem_words", "name_words", "identifier_words", "structure_words")], ("places", pa.map_(pa.string(), pa.list_(pa.int32())))])

    def code_words(text: str) -> list[str]:
        return sorted({w for identifier in _IDENTIFIER.findall(text) for w in _words(identifier)})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Kept(sent.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows = []
                for doc, path, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    clean, text = (path or "").replace("\\", "/"), text or ""
                    if dots := _DOTS.match(clean):
                        clean = clean[dots.end() :]
                    name = clean.rpartition("/")[2]
                    stem = _stem(name)
                    at: dict[str, list[int]] = {}
                    for pos, words in enumerate(map(kept.__getitem__, _IDENTIFIER.findall(text))):
                        for word in words:
                            held = at.setdefault(word, [])
                            if len(held) < most:
                                held.append(pos)
                    bound = " ".join([*_DECLARED.findall(text), *_IMPORTED.findall(text)])
                    structure = {w for identifier in _IDENTIFIER.findall(bound) for w in kept[identifier]}
                    rows.append((doc, path, code_words(" ".join([*clean.split("/"), stem])), code_words(stem), code_words(name), [*at], [*structure], [*at.items()]))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return docs.select(F.col("doc_id").cast("long"), "path", "text").mapInArrow(read, ASKED)
