"""Scalar text functions: terms, code words, paths, languages, snippets, normalisation.

All but :func:`text_variants` are Column expressions of built-in functions, so they stay in generated code
and push no Python into a plan.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RAW_TERM = "[A-Za-z][A-Za-z0-9']+"
SNIPPET_TERM = "[A-Za-z0-9_]{2,}"
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]{1,}"
JAVA_TOKEN = r"[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+|\s+|[^A-Za-z0-9_$\s]"

# Language ids by name and by file ending, and words of the ranking rules.
LANGUAGE_NAMES = ("Python", "HTML", "JavaScript", "CSS", "Text", "TypeScript", "SQL", "Rust", "PHP", "XML-compatible", "Java", "C", "C++", "Go", "C#", "Shell", "JSON", "YAML", "TOML", "PowerShell")
ENDINGS = {
    ".py": 0, ".html": 1, ".htm": 1, ".js": 2, ".mjs": 2, ".cjs": 2, ".css": 3, ".txt": 4, ".md": 4, ".ts": 5, ".tsx": 5, ".sql": 6, ".rs": 7, ".php": 8, ".phtml": 8, ".xml": 9,
    ".java": 10, ".c": 11, ".h": 11, ".cpp": 12, ".cc": 12, ".cxx": 12, ".hpp": 12, ".hh": 12, ".hxx": 12, ".go": 13, ".cs": 14, ".sh": 15, ".bash": 15, ".zsh": 15, ".json": 16,
    ".yaml": 17, ".yml": 17, ".toml": 18, ".ps1": 19,
}
STOPWORDS = ("a", "an", "and", "for", "how", "if", "in", "is", "it", "of", "one", "or", "the", "then", "there", "they", "where", "with")
ALIAS_GROUPS = (
    ("expire", "expires", "expired", "expiry", "links expire", "timed", "timestamp", "max_age", "age"),
    ("tampered", "messed with", "broken token", "bad signature", "bad data", "unsign", "signature"),
    ("setup entry point", "entry point", "cli", "command", "pyproject", "project.scripts", "entry_points", "console_scripts"),
    ("url", "urls", "link", "links", "safe", "base64", "url_safe", "urlsafe"),
)


def literals(values) -> Column:  # noqa: ANN001
    return F.array(*[F.lit(v) for v in values])


def lower_all(pattern: str, text: Column | str) -> Column:
    """All matches of ``pattern`` in ``text``, lower-cased; none in a null text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)), F.lower)


def raw_terms(text: Column | str) -> Column:
    return lower_all(RAW_TERM, text)


def snippet_terms(text: Column | str) -> Column:
    return F.array_distinct(lower_all(SNIPPET_TERM, text))


def split_identifiers(text: Column) -> Column:
    """Words of all identifiers in order: split at underscores and changes of case, two characters or more, no numbers."""
    joined = F.array_join(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(0)), " ")
    spaced = F.regexp_replace(F.regexp_replace(joined, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    words = F.regexp_extract_all(F.lower(spaced), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.rlike("^[0-9]+$"))


def code_words(text: Column) -> Column:
    """Distinct :func:`split_identifiers`, sorted."""
    return F.array_sort(F.array_distinct(split_identifiers(text)))


def clean_path(path: Column) -> Column:
    """Forward slashes, no leading ``./``; '' for null."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/"), r"^(\./)+", "")


def path_parts(path: Column) -> Column:
    return F.filter(F.split(clean_path(path), "/"), lambda p: p != "")


def file_name(path: Column) -> Column:
    return F.regexp_extract(clean_path(path), "([^/]*)$", 1)


def file_ending(path: Column) -> Column:
    """The lower-case ending with its dot; a leading dot starts no ending."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^./]+)$", 1))


def file_stem(path: Column) -> Column:
    name = file_name(path)
    return F.when(file_ending(path) != "", F.regexp_extract(name, r"^(.+)\.[^./]+$", 1)).otherwise(name)


def path_depth(path: Column) -> Column:
    return F.greatest(F.lit(0), F.size(path_parts(path)) - 1)


def language_of(path: Column) -> Column:
    """The language id of a file ending, or null."""
    table = F.create_map(*[F.lit(x) for pair in ENDINGS.items() for x in pair])
    return F.element_at(table, F.when(file_ending(path) != "", file_ending(path)).otherwise("?"))


def unsafe_path(path: Column) -> Column:
    """Whether a relative path may leave its folder: empty, absolute, or with an empty, ``.`` or ``..`` part."""
    forward = F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/")
    return (forward == "") | forward.startswith("/") | F.exists(F.split(forward, "/"), lambda p: p.isin("", ".", ".."))


def word_stems(word: Column) -> Column:
    """Candidate stems of an English inflection, in rule order; which ones are words the vocabulary decides."""
    size = F.length(word)
    cut = lambda n: F.substring(word, F.lit(1), size - n)
    none = F.lit(None).cast("string")
    ing, ed = cut(3), cut(2)
    doubled = F.length(ing) > 2
    return F.array_distinct(
        F.array_compact(
            F.array(
                F.when(word.endswith("ies") & (size > 4), F.concat(cut(3), F.lit("y"))).otherwise(none),
                F.when(word.endswith("ers") & (size > 4), cut(1)).otherwise(none),
                F.when(word.endswith("s") & ~word.endswith("ss") & (size > 3), cut(1)).otherwise(none),
                F.when(word.endswith("ing") & (size > 5), ing).otherwise(none),
                F.when(word.endswith("ing") & (size > 5) & doubled & (F.right(ing, F.lit(1)) == F.left(F.right(ing, F.lit(2)), F.lit(1))), cut(4)).otherwise(none),
                F.when(word.endswith("ing") & (size > 5), F.concat(ing, F.lit("e"))).otherwise(none),
                F.when(word.endswith("ed") & (size > 4), ed).otherwise(none),
                F.when(word.endswith("ed") & (size > 4), F.concat(ed, F.lit("e"))).otherwise(none),
            )
        )
    )


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def separated(text: Column) -> Column:
    """Separators, camel case, and letters beside digits set apart by blanks, lower-cased."""
    plain = F.regexp_replace(F.regexp_replace(text, "[’‘]", "'"), r"([A-Za-z]+)'s\b", "$1")
    plain = F.regexp_replace(plain, r"([A-Za-z])'([A-Za-z])", "$1$2")
    plain = F.regexp_replace(plain, r"[_\-./\\:]+", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, "([A-Z])([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")
    plain = F.regexp_replace(F.regexp_replace(plain, "([A-Za-z])([0-9])", "$1 $2"), "([0-9])([A-Za-z])", "$1 $2")
    return collapsed(F.lower(plain))


def _variants(text: str) -> list[str]:
    """``text`` unescaped, folded to ASCII, with plain apostrophes, without possessives, contractions joined, words set apart, lower-cased."""
    steps = [html.unescape(text)]
    steps.append(unicodedata.normalize("NFKD", steps[-1]).encode("ascii", "ignore").decode("ascii"))
    steps.append(re.sub("[’‘`´]", "'", steps[-1]))
    steps.append(re.sub(r"\b([A-Za-z]+)'s\b", r"\1", steps[-1]))
    steps.append(re.sub(r"(?<=[A-Za-z])'(?=[A-Za-z])", "", steps[-1]))
    apart = re.sub(r"[_\-./\\:]+", " ", steps[-1])
    for left, right in (("[A-Z]", "[A-Z][a-z]"), ("[a-z0-9]", "[A-Z]"), ("[A-Za-z]", "[0-9]"), ("[0-9]", "[A-Za-z]")):
        apart = re.sub(f"(?<={left})(?={right})", " ", apart)
    steps += [apart, apart.lower()]
    clean = [re.sub(r"\s+", " ", s).strip() for s in steps]
    return list(dict.fromkeys(s for s in clean if s and s != text))


def text_variants(text: Column) -> Column:
    """``ARRAY<STRING>``: up to seven spellings under which a text may be asked for, each once, without the text itself.

    Character references and compatibility forms have no built-in function, so this is Arrow-batched Python,
    meant for titles, paths and queries.  A null text has none.
    """

    @F.pandas_udf("array<string>")
    def spread(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else _variants(t))

    return spread(text)


def first_place(lowered: Column, terms: Column) -> Column:
    """The place from 1 of the first of ``terms`` in a lower-cased text; null if none is in it."""
    return F.array_min(F.filter(F.transform(terms, lambda t: F.instr(lowered, t)), lambda p: p > 0))


def windowed_snippet(text: Column, terms: Column, limit: int) -> Column:
    """About ``limit`` characters around the first of ``terms``, with ``...`` where text is left out."""
    body = F.trim(text)
    return snippet_around(body, first_place(F.lower(body), terms), limit)


def snippet_around(body: Column, at: Column, limit: int) -> Column:
    """About ``limit`` characters of a trimmed text around the place ``at``; both are named often, so they should be columns already."""
    size = F.length(body)
    begin = F.greatest(F.lit(0), F.coalesce(at - 1, F.lit(0)) - limit // 3)
    end = F.least(size, begin + limit)
    begin = F.when(end - begin < limit, F.greatest(F.lit(0), end - limit)).otherwise(begin)
    before = F.when(begin > 0, "...").otherwise("")
    after = F.when(end < size, "...").otherwise("")
    inner = F.trim(F.substring(body, begin + 1, end - begin))
    cut = F.substring(inner, F.lit(1), F.lit(limit) - F.length(before) - F.length(after))
    return F.when(size <= limit, body).otherwise(F.concat(before, cut, after))


def format_bytes(size: Column) -> Column:
    """Bytes as B, KB, MB or GB with two digits from KB on."""
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024**2, F.concat(F.format_number(size / 1024, 2), F.lit(" KB")))
        .when(size < 1024**3, F.concat(F.format_number(size / 1024**2, 2), F.lit(" MB")))
        .otherwise(F.concat(F.format_number(size / 1024**3, 2), F.lit(" GB")))
    )
