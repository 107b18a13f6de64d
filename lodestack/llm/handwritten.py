"""Files that nobody wrote by hand for this code base: generated, squeezed, vendored, data.

A character trigram model of identifiers is trained per language on all chunks, and with it how improbable
names and how diverse lines usually are in each language.  Texts are read once; what the model and the measures
need of them is written down (:func:`read_chunks`).  Every chunk is then measured:

* ``entropy``: its names cost half as much again under the model of their language as names of that
  language usually do: they were mangled, the file was squeezed for delivery;
* ``dense``: names with hardly any white space between them: squeezed, whatever the names;
* ``diversity``: the lines, each taken as the shapes of its names, have a third of the entropy that is
  usual in the language: they were emitted from a template;
* ``data``: digits or encoded runs fill the chunk: bulk data;
* ``style``: over a whole file, naming styles that its language's other files do not explain: taken over.

Origin marks (``mark``: a comment that says so) and folders for other projects' code (``folder``) are
further evidence for files that look like any other, copies of other projects above all.  They never keep
a measure from being taken.  Marks count only as comments: a generator that writes such a line is
hand-written.

Everything is summed per chunk and reduced per file, so no file is ever gathered; one chunk that shows
it is enough, but for naming styles, which are counted over all chunks of a file and of a language.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.session import materialize

#: Language by file ending; other files go by language_id.
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "js", "mjs": "js", "cjs": "js", "jsx": "js", "ts": "ts", "tsx": "ts", "java": "java", "kt": "java", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "cs", "go": "go", "rs": "rust", "php": "php", "sh": "shell", "sql": "sql", "css": "css", "html": "html", "xml": "xml",
    "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml", "ps1": "powershell",
}
_KINDS = ("generated", "squeezed", "vendored", "data")
#: What a chunk or file can show, and what it is a sign of.
SIGNALS = {
    "entropy": "squeezed", "dense": "squeezed", "diversity": "generated", "data": "data", "style": "vendored", "folder": "vendored",
    "mark_generated": "generated", "mark_vendored": "vendored", "mark_squeezed": "squeezed",
}
_NAMES_OF_SIGNALS = tuple(SIGNALS)
#: Names that cost so many times the usual cost are mangled; lines with less than so much of the usual diversity are a template.
MANGLED, TEMPLATE = 1.6, 0.35
#: Evidence that a measure needs: names, lines with names, digits, characters of encoded runs.
LEAST_NAMES, LEAST_LINES, LEAST_DIGITS, LEAST_ENCODED = 10, 6, 40, 90
#: Lines below which a template must be the clearer, the fewer they are.
WHOLE_LINES = 16
#: Chunks of a language below which the milder of its own and all languages' usual values hold.
LEAST_CHUNKS = 30
_COMMENT = r"^[ \t]*(?://+|#+|/\*+!?|\*+|--+|<!--|;+|%+|\"\"\"|''')[ \t]*"
_GENERATED = re.compile(
    _COMMENT + r"(?:[^\n]*?<?auto[- ]?generated\b|[^\n]*?@generated\b|[^\n]*?\bcode generated (?:by|from)\b|(?:this )?(?:file|code|module)?[ \t]*(?:is|was)?[ \t]*(?:automatically )?generated (?:by|from|with|using)\b"
    r"|(?:this )?(?:file|code|module)[ \t]+(?:is|was)[ \t]+(?:automatically )?(?:produced|created|emitted) by\b)",
    re.IGNORECASE | re.MULTILINE,
)
_GENERATED_WORDS = ("generated", "produced by", "created by", "emitted by")
_TAKEN_WORDS = ("vendored", "verbatim", "upstream:", "(c)", "copyright", "©")
_TAKEN = re.compile(_COMMENT + r"(?:vendored from\b|copied verbatim from\b|upstream:[ \t]|[^\n]{0,60}?v?\d+\.\d+(?:\.\d+)?[ \t]*\|[ \t]*(?:\(c\)|copyright|©))", re.IGNORECASE | re.MULTILINE)
_BUNDLED = re.compile(r"^/\*! [^\n*]{1,60} v?\d+\.\d+|[#@][ \t]*sourceMappingURL=", re.MULTILINE)
#: Folders that hold other projects' code.
_FOREIGN_FOLDER = re.compile(r"(?:^|/)(?:node_modules|bower_components|jspm_packages|vendor|vendored|third[_\-]?party|3rd[_\-]?party|extern|externals?|deps|Pods|Carthage|site-packages|contrib/upstream)/", re.IGNORECASE)
_IDENTIFIER = re.compile(r"[A-Za-z$][A-Za-z0-9_$]*|_[A-Za-z0-9$][A-Za-z0-9_$]*")
_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`")
#: Lines that are comments only; their words are no names.
_REMARK = re.compile(r"^[ \t]*(?://|#(?![A-Za-z])|/\*|\*|--|<!--)[^\n]*", re.MULTILINE)
_NAMES_BY_LINE = re.compile(_IDENTIFIER.pattern + r"|\n")
_ENCODED = re.compile(r"[A-Za-z0-9+/=]{60,}")
_STYLES = (("snake", re.compile(r"[a-z][a-z0-9]*(?:_[a-z0-9]+)+")), ("camel", re.compile(r"[a-z]+[0-9]*(?:[A-Z][a-z0-9]*)+")), ("pascal", re.compile(r"(?:[A-Z][a-z0-9]+){2,}")))
_STYLE_NAMES = tuple(style for style, _ in _STYLES)
#: Log-likelihood ratio from which a file's naming styles are foreign; under the model about 6 of a million own files reach it.
_FOREIGN_RATIO = 12.0
#: Alphabet of the trigram model: letters, one digit, one sign, and the two ends.
_CODE = {chr(97 + i): i for i in range(26)} | dict.fromkeys("0123456789", 26) | {"_": 27, "$": 28}
_START, _END, _LETTERS = 29, 30, 31
_BLANKS = b" \t\r\n"


def language(path: str, language_id: int | None) -> str:
    ending = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    return LANGUAGES.get(ending) or f"id{language_id if language_id is not None else -1}"


def clean_path(path: str | None) -> str:
    path = (path or "").replace("\\", "/")
    return path[2:] if path.startswith("./") else path


_GRAMS = _LETTERS**3
_CODES = np.full(256, 28)
for _letter, _number in _CODE.items():
    _CODES[[ord(_letter), ord(_letter.upper())]] = _number


def trigrams(names: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of all ``names`` one after the other, and how many each name has: one more than letters."""
    _, offsets, data = names.buffers()
    ends = np.frombuffer(offsets, np.int32)[names.offset : names.offset + len(names) + 1].astype(np.int64)
    sizes, at = np.diff(ends), np.arange(len(names))
    letters = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    codes = np.full(len(letters) + 3 * len(names), _START)
    codes[np.arange(len(letters)) + np.repeat(3 * at + 2, sizes)] = _CODES[letters]
    codes[ends[1:] - ends[0] + 3 * at + 2] = _END
    grams = (codes[:-2] * _LETTERS + codes[1:-1]) * _LETTERS + codes[2:]
    return grams[np.arange(len(letters) + len(names)) + np.repeat(2 * at, sizes + 1)], sizes + 1


class NameModel:
    """Bits of each trigram by language; the entry None is over all languages."""

    def __init__(self, counts: dict[str, dict[int, int]]):
        self.bits: dict[str | None, np.ndarray] = {}
        pooled: Counter = Counter()
        for grams in counts.values():
            pooled.update(grams)
        for lang, grams in {**counts, None: pooled}.items():
            table = np.full(_GRAMS, 0.05)
            table[list(grams)] += list(grams.values())
            table = table.reshape(-1, _LETTERS)
            self.bits[lang] = (-np.log2(table / table.sum(axis=1, keepdims=True))).ravel()

    def cross_entropy(self, langs: list[str], lang: np.ndarray, names: pa.StringArray) -> np.ndarray:
        """Bits per character of each name in ``langs[lang]``; a language without names in the model is judged by all others'."""
        if not len(names):
            return np.zeros(0)
        grams, sizes = trigrams(names)
        bits = np.concatenate([self.bits.get(x, self.bits[None]) for x in langs])[np.repeat(lang, sizes) * _GRAMS + grams]
        return np.add.reduceat(bits, np.cumsum(sizes) - sizes) / sizes


@lru_cache(1 << 17)
def _shape(name: str) -> str:
    """A name with every run of capitals or small letters as one letter, without digits."""
    return _SMALL.sub("a", _CAPITAL.sub("A", _DIGIT.sub("", name)))


_SMALL, _CAPITAL, _DIGIT = re.compile("[a-z]+"), re.compile("[A-Z]+"), re.compile("[0-9]+")


def line_diversity(bare: str) -> tuple[int, float]:
    """Lines of code with names, and the entropy in bits of these lines as sequences of name shapes."""
    lines: Counter = Counter()
    line: list[str] = []
    for name in (*_NAMES_BY_LINE.findall(_REMARK.sub("", bare)), "\n"):
        if name != "\n":
            line.append(_shape(name))
        elif line:
            lines[tuple(line)] += 1
            line = []
    total = sum(lines.values())
    return total, -sum(n / total * math.log2(n / total) for n in lines.values()) if total else 0.0


@lru_cache(1 << 17)
def _style(name: str) -> str:
    bare = name.lstrip("$")  # PHP and shell variables
    return next((style for style, pattern in _STYLES if pattern.fullmatch(bare)), "")


def _style_counts(names: list[str]) -> Counter:
    out = Counter(map(_style, names))
    del out[""]
    return out


class StyleModel:
    """How the files of each language are named, from sums over all its files.

    ``sums`` has by language the number of files with styled names, the names by style, and over the files
    the sums of squared names and of squared names by style over the file's names.  The share of the
    variance that lies between files (moment estimate, at least ``least`` and drawn to ``prior`` as by five
    more files) tells how far a file may stray from its language.
    """

    def __init__(self, sums: dict[str, tuple[int, list[int], float, float]], least: float = 0.02, prior: float = 0.3):
        self.sums, self.least, self.prior = sums, least, prior

    def ratio(self, lang: str, names: list[int], counted: bool) -> float:
        """Log-likelihood ratio of a file's names by style: any distribution against that of the language's other files.

        ``counted`` files are in the sums and taken out of them.  A language without other names explains everything.
        """
        files, counts, squares, ratios = self.sums.get(lang, (0, [0] * len(names), 0.0, 0.0))
        size = sum(names)
        if counted and size:
            files, counts, squares, ratios = files - 1, [c - n for c, n in zip(counts, names, strict=True)], squares - size * size, ratios - sum(n * n for n in names) / size
        total = sum(counts)
        if not total or not size:
            return 0.0
        between = (ratios - sum(c * c for c in counts) / total) / max(1, files - 1)
        within = max(0.0, total - ratios) / max(1, total - files)
        typical = (total - squares / total) / max(1, files - 1)
        # in a language of nearly one style a single mixed file would else count as all the variance there is
        spread = min(1.0, max(0.0, (between - within) / max(0.1 * typical, between + (typical - 1) * within, 1e-9)))
        spread = max(self.least, (files * spread + 5 * self.prior) / (files + 5))
        strength = min(1 / spread - 1, total + len(names))
        own = [max(1e-9, strength * (c + 1) / (total + len(names))) for c in counts]
        return _polya(names, [1.0] * len(names)) - _polya(names, own)


def _polya(counts: list[int], strengths: list[float]) -> float:
    """Log-probability of a sequence with these counts under a Dirichlet of these strengths."""
    total = sum(strengths)
    return lgamma(total) - lgamma(total + sum(counts)) + sum(lgamma(c + a) - lgamma(a) for c, a in zip(counts, strengths, strict=True) if c)


def _share(data: bytes, kept: bytes) -> float:
    """The share of the bytes ``kept`` in ``data``."""
    return (len(data) - len(data.translate(None, kept))) / max(1, len(data))


def declared(path: str, text: str) -> set[str]:
    """The marks and the folder that say where a chunk comes from."""
    out = set()
    lower = text.lower()
    if any(word in lower for word in _GENERATED_WORDS) and _GENERATED.search(text):
        out.add("mark_generated")
    if any(word in lower for word in _TAKEN_WORDS) and _TAKEN.search(text):
        out.add("mark_vendored")
    if ("/*!" in text or "sourceMappingURL" in text) and _BUNDLED.search(text):
        out.add("mark_squeezed")
    if _FOREIGN_FOLDER.search(path):
        out.add("folder")
    return out


def names_of(text: str) -> tuple[str, list[str]]:
    """The text without literals, and its names."""
    bare = _LITERAL.sub(" ", text)
    return bare, _IDENTIFIER.findall(bare)


def filled_by_data(text: str) -> bool:
    data = text.encode("utf-8", "surrogatepass")
    digits = _share(data, b"0123456789")
    if digits > 0.28 and digits * len(data) >= LEAST_DIGITS:
        return True
    if len(text) < LEAST_ENCODED or _share(data, _BLANKS) >= 0.15:
        return False
    encoded = sum(map(len, _ENCODED.findall(text)))
    return encoded >= LEAST_ENCODED and encoded > 0.6 * len(text)


#: Columns of :func:`read_chunks` besides the file.
_READ = "lang string, key long, bits int, plain boolean, lines int, diversity double, size int, names array<string>, counts array<int>, " + ", ".join(f"{s} long" for s in _STYLE_NAMES)


def _bit(signal: str) -> int:
    return 1 << _NAMES_OF_SIGNALS.index(signal)


def read_chunks(rows: DataFrame) -> DataFrame:
    """One row of measures for each of ``rows (page_index, path, language_id, text)``, its text read once.

    ``bits`` holds the signals that need no model, ``size`` the number of names, ``names`` and ``counts`` the different ones.
    Chunks that are not ``plain`` teach a model nothing: those with a mark, a folder for other code, bulk data or hardly any white space.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                out = []
                for p, number, text, key in zip(*(c.to_pylist() for c in part.columns[1:]), strict=True):
                    bare, names = names_of(text)
                    signals, data = declared(p, text), filled_by_data(text)
                    blanks = _share(text.encode("utf-8", "surrogatepass"), _BLANKS)
                    plain = not signals and not data and blanks >= 0.09
                    if data:
                        signals.add("data")
                    if blanks < 0.03 and len(names) >= LEAST_NAMES:
                        signals.add("dense")
                    lines, diversity = line_diversity(bare)
                    styles, counted = _style_counts(names), Counter(names)
                    out.append((language(p, number), key, sum(map(_bit, signals)), plain, lines, diversity, len(names), list(counted), list(counted.values()), *(styles[s] for s in _STYLE_NAMES)))
                columns = list(zip(*out, strict=True)) if out else [()] * (9 + len(_STYLE_NAMES))
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.float64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), *[pa.int64()] * len(_STYLE_NAMES))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["page_index", *(x.split()[0] for x in _READ.split(", "))])

    keyed = rows.select("page_index", "path", "language_id", "text", F.xxhash64("text").alias("key"))
    return keyed.mapInArrow(read, f"page_index {rows.schema['page_index'].dataType.simpleString()}, {_READ}")


def _names(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray, pa.StringArray]:
    """The row, the count and the pair of each name of a batch; the languages, and the language and name of each different pair."""
    at = {name: batch.schema.get_field_index(name) for name in ("lang", "names", "counts")}
    listed = batch.column(at["names"])
    langs, words = batch.column(at["lang"]).dictionary_encode(), listed.flatten().dictionary_encode()
    row = np.repeat(np.arange(batch.num_rows), np.asarray(listed.value_lengths()))
    width = max(1, len(words.dictionary))
    pairs, pair = np.unique(np.asarray(langs.indices, np.int64)[row] * width + np.asarray(words.indices, np.int64), return_inverse=True)
    return row, np.asarray(batch.column(at["counts"]).flatten()), pair, langs.dictionary.to_pylist(), pairs // width, words.dictionary.take(pa.array(pairs % width)).cast(pa.string())


def train(chunks: DataFrame) -> NameModel:
    """The name model of all plain rows of :func:`read_chunks`; at most languages x trigrams numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            row, n, pair, langs, lang, names = _names(batch)
            if not len(row):
                continue
            grams, sizes = trigrams(names)
            times = np.repeat(np.bincount(pair, n, len(names)), sizes)
            found = np.bincount(np.repeat(lang, sizes) * _GRAMS + grams, times, len(langs) * _GRAMS).astype(np.int64).reshape(-1, _GRAMS)
            for name, counted in zip(langs, found, strict=True):
                held[name] = held[name] + counted if name in held else counted.copy()
        for lang, counted in held.items():
            seen = np.flatnonzero(counted)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(counted[seen], pa.int64())], names=["lang", "gram", "n"])

    summed = chunks.where("plain").select("lang", "names", "counts").mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[int, int]] = {}
    for row in summed.toLocalIterator():
        counts.setdefault(row.lang, {})[row.gram] = row.n
    return NameModel(counts)


def priced(chunks: DataFrame, model: NameModel) -> DataFrame:
    """``chunks`` of :func:`read_chunks` with the ``cost`` of all their names together in place of the names."""
    shared = chunks.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in chunks.columns if c not in ("names", "counts")]

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, n, pair, langs, lang, names = _names(batch)
            each = shared.value.cross_entropy(langs, lang, names)
            cost = np.bincount(row, each[pair] * n, batch.num_rows) if len(row) else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(cost, pa.float64())], names=[*kept, "cost"])

    kinds = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in kept)
    return chunks.mapInArrow(price, f"{kinds}, cost double")


def usual(chunks: DataFrame) -> DataFrame:
    """``(lang, usual_cost, usual_diversity)`` of plain rows of :func:`priced`; the row without a language holds for languages that have none."""
    cost = F.when(F.col("size") >= LEAST_NAMES, F.col("cost") / F.col("size"))
    values = chunks.where("plain").select("lang", cost.alias("cost"), F.when(F.col("lines") >= LEAST_LINES, F.col("diversity")).alias("bits"))
    by_lang = values.rollup("lang").agg(F.count("*").alias("n"), F.percentile_approx("cost", 0.5, 10_000).alias("cost"), F.percentile_approx("bits", 0.5, 10_000).alias("bits"))
    medians = {r.lang: (r.n, math.inf if r.cost is None else r.cost, r.bits or 0.0) for r in by_lang.toLocalIterator()}
    _, all_cost, all_bits = medians.setdefault(None, (0, math.inf, 0.0))
    rows = [(lang, cost, bits) if n >= LEAST_CHUNKS or lang is None else (lang, max(cost, all_cost), min(bits, all_bits)) for lang, (n, cost, bits) in medians.items()]
    return chunks.sparkSession.createDataFrame(rows, "lang string, usual_cost double, usual_diversity double")


def judged(chunks: DataFrame) -> DataFrame:
    """Rows of :func:`priced` with all that they show in ``bits``."""
    known = usual(chunks)
    default = known.where("lang is null").select(F.col("usual_cost").alias("any_cost"), F.col("usual_diversity").alias("any_diversity"))
    rows = chunks.join(F.broadcast(known.where("lang is not null")), "lang", "left").crossJoin(F.broadcast(default))
    cost, diversity = F.coalesce("usual_cost", "any_cost"), F.coalesce("usual_diversity", "any_diversity")
    mangled = (F.col("size") >= LEAST_NAMES) & (F.col("cost") > MANGLED * cost * F.col("size"))
    template = (F.col("lines") >= LEAST_LINES) & (F.col("diversity") < TEMPLATE * diversity * F.least(F.lit(1.0), F.col("lines") / WHOLE_LINES))
    shown = F.col("bits").bitwiseOR(F.when(mangled, _bit("entropy")).otherwise(0)).bitwiseOR(F.when(template, _bit("diversity")).otherwise(0))
    return rows.select("page_index", "lang", "key", shown.alias("bits"), *_STYLE_NAMES)


def style_model(files: DataFrame) -> StyleModel:
    """The naming styles of each language over all files without a reason; as many rows as languages reach the driver."""
    names = sum((F.col(s) for s in _STYLE_NAMES), F.lit(0))
    own = files.where("bits = 0").withColumn("names", names).where("names > 0")
    square = sum((F.col(s) * F.col(s) for s in _STYLE_NAMES), F.lit(0))
    sums = own.groupBy("lang").agg(F.count("*").alias("files"), *[F.sum(s).alias(s) for s in _STYLE_NAMES], F.sum(F.col("names").cast("double") * F.col("names")).alias("squares"), F.sum(square / F.col("names")).alias("ratios"))
    return StyleModel({r.lang: (r.files, [r[s] for s in _STYLE_NAMES], r.squares, r.ratios) for r in sums.toLocalIterator()})


def file_reasons(chunks: DataFrame, file_col: str = "page_index", path_col: str = "source_path", text_col: str = "text", language_col: str = "language_id") -> DataFrame:
    """``(page_index, reasons ARRAY<STRING>)`` of every file; empty reasons for hand-written files.

    See :func:`file_signals` for what it rests on.
    """
    signals = file_signals(chunks, file_col, path_col, text_col, language_col)
    kinds = F.array(*[F.when(F.arrays_overlap("signals", F.array(*[F.lit(x) for x, k in SIGNALS.items() if k == kind])), F.lit(kind)) for kind in _KINDS])
    return signals.select("page_index", F.array_compact(kinds).alias("reasons"))


def file_signals(chunks: DataFrame, file_col: str = "page_index", path_col: str = "source_path", text_col: str = "text", language_col: str = "language_id") -> DataFrame:
    """``(page_index, signals ARRAY<STRING>)`` of every file: all that any of its chunks, or the whole file, shows.

    Chunks repeated under one id change nothing.  Null and blank texts show nothing, a null path is an
    empty one, rows with a null file are left out; an empty table gives an empty result.
    """
    rows = chunks.where(F.col(file_col).isNotNull()).select(F.col(file_col).alias("page_index"), F.col(path_col).alias("path"), F.col(language_col).cast("int").alias("language_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    path = F.regexp_replace(F.regexp_replace(F.coalesce("path", F.lit("")), r"\\", "/"), r"^\./", "")
    rows = rows.withColumn("path", path)
    chunks = materialize(read_chunks(rows), "chunks")
    shown = judged(materialize(priced(chunks, train(chunks)), "priced"))
    counts = [F.max(s).alias(s) for s in _STYLE_NAMES]
    once = shown.groupBy("page_index", "lang", "key").agg(F.bit_or("bits").alias("bits"), *counts)
    parts = once.groupBy("page_index", "lang").agg(F.bit_or("bits").alias("bits"), *[F.sum(s).alias(s) for s in _STYLE_NAMES])
    files = materialize(parts, "files")
    styles = chunks.sparkSession.sparkContext.broadcast(style_model(files))

    @F.pandas_udf("int")
    def foreign(langs, bits, *counts):  # noqa: ANN001, ANN002, ANN202
        import pandas as pd

        style = _bit("style")
        return pd.Series([style if styles.value.ratio(lang, list(names), not b) > _FOREIGN_RATIO else 0 for lang, b, *names in zip(langs, bits, *counts, strict=True)], dtype="int32")

    marked = files.select("page_index", F.col("bits").bitwiseOR(foreign("lang", "bits", *_STYLE_NAMES)).alias("bits"))
    merged = marked.groupBy("page_index").agg(F.bit_or("bits").alias("bits"))
    names = F.array(*[F.when(F.col("bits").bitwiseAND(1 << i) > 0, F.lit(signal)) for i, signal in enumerate(_NAMES_OF_SIGNALS)])
    return merged.select("page_index", F.array_compact(names).alias("signals"))
