"""Lossless lexers by language family: Column expressions of one pattern each.

A family is a list of token kinds in order of preference; its pattern tries them in that order and ends
with any single character, so the tokens always join to the text.  Patterns use only what backtracking
and automaton engines read alike (no look-around, no back-references).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = ("blank", r"[ \t\r\n\f]+")
_REST = ("other", r"[\s\S]")
_WORD = ("word", "[A-Za-z_][A-Za-z0-9_]*")
_NUMBER = ("number", r"0[xXbBoO][0-9A-Fa-f_]+|[0-9][0-9_]*(?:\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9]+)?")
_DOUBLE, _SINGLE, _BACK = r'"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"', r"'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'", r"`[^`\\]*(?:\\[\s\S][^`\\]*)*`"
_BLOCK, _LINE, _HASH, _DASHES = r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/", r"//[^\n]*", r"#[^\n]*", r"--[^\n]*"
_MARK = ("mark", r">>>=|===|!==|\*\*=|<<=|>>=|\.\.\.|\?\?=|&&=|\|\|=|=>|->|<-|::|:=|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|//")

FAMILIES: dict[str, list[tuple[str, str]]] = {
    "python": [("string", r'[rRbBuUfF]{0,2}(?:"""[\s\S]*?"""|' + r"'''[\s\S]*?'''" + f"|{_DOUBLE}|{_SINGLE})"), ("comment", _HASH), ("decorator", r"@[A-Za-z_][A-Za-z0-9_.]*"), _NUMBER, _WORD, _MARK],
    "markup": [
        ("comment", r"<!--[\s\S]*?-->"), ("declaration", r"<!\[CDATA\[[\s\S]*?\]\]>|<!DOCTYPE[^>]*>|<\?[\s\S]*?\?>"), ("tag", "</?[A-Za-z_][A-Za-z0-9_:.-]*"), ("mark", "/?>"), ("entity", "&#?[A-Za-z0-9]+;"),
        ("string", r'"[^"<>]*"|' + r"'[^'<>]*'"), ("number", "[0-9]+"), ("word", "[A-Za-z_][A-Za-z0-9_:-]*"),
    ],
    "script": [("comment", f"{_LINE}|{_BLOCK}"), ("string", f"{_DOUBLE}|{_SINGLE}|{_BACK}"), ("decorator", "@[A-Za-z_][A-Za-z0-9_.]*"), _NUMBER, ("word", "[A-Za-z_$][A-Za-z0-9_$]*"), _MARK],
    "style": [
        ("comment", _BLOCK), ("string", f"{_DOUBLE}|{_SINGLE}"), ("rule", "@[A-Za-z-]+"), ("color", "#[0-9A-Fa-f]{3,8}"), ("selector", "[.#][A-Za-z_-][A-Za-z0-9_-]*"),
        ("number", r"-?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:%|[A-Za-z]+)?"), ("variable", "--[A-Za-z0-9_-]+"), ("word", "[A-Za-z_-][A-Za-z0-9_-]*"), ("mark", "::|[>~+]"),
    ],
    "prose": [("word", "[A-Za-z]+(?:'[A-Za-z]+)*"), ("number", "[0-9]"), ("mark", r"\.\.\.|---|===|```|--|\*\*|==|->|=>|::|&&|\|\|")],
    "query": [("comment", f"{_DASHES}|{_BLOCK}"), ("string", "'[^']*(?:''[^']*)*'"), ("name", '"[^"]*"|`[^`]*`'), _NUMBER, ("keyword", "[A-Z][A-Z_]+"), _WORD, ("mark", r"<>|<=|>=|!=|\|\||::")],
    "rust": [
        ("comment", f"{_LINE}|{_BLOCK}"), ("string", r'b?r"[^"]*"|b?' + _DOUBLE), ("character", r"b?'(?:[^'\\\n]|\\[^\n][A-Za-z0-9{}]*)'"), ("lifetime", "'[A-Za-z_][A-Za-z0-9_]*"), ("attribute", r"#!?\[[^\]\n]*\]"),
        ("macro", "[A-Za-z_][A-Za-z0-9_]*!"), _NUMBER, _WORD, ("mark", r"\.\.=|\.\."), _MARK,
    ],
    "php": [("tag", r"<\?(?:php|=)?|\?>"), ("comment", f"{_HASH}|{_LINE}|{_BLOCK}"), ("variable", r"\$[A-Za-z_][A-Za-z0-9_]*"), ("string", f"{_DOUBLE}|{_SINGLE}"), _NUMBER, _WORD, ("mark", r"<=>|\.="), _MARK],
    "clike": [
        ("comment", f"{_LINE}|{_BLOCK}"), ("directive", "#[ \\t]*[a-z]+"), ("string", f'@"[^"]*(?:""[^"]*)*"|{_DOUBLE}|{_BACK}'), ("character", _SINGLE), ("annotation", "@[A-Za-z_][A-Za-z0-9_.]*"), _NUMBER, _WORD, _MARK,
    ],
    "shell": [
        ("comment", _HASH), ("variable", r"\$\{[^}\n]*\}|\$[A-Za-z_][A-Za-z0-9_]*|\$[0-9@#?*!$-]"), ("string", f"{_DOUBLE}|'[^']*'|{_BACK}"), ("option", "--?[A-Za-z][A-Za-z0-9-]*"), _NUMBER, ("word", "[A-Za-z_][A-Za-z0-9_.-]*"),
        ("mark", r"&&|\|\||;;|<<|>>|\$\(|\[\[|\]\]|2>&1"),
    ],
    "powershell": [
        ("comment", r"<#[\s\S]*?#>|" + _HASH), ("string", r'@"[\s\S]*?"@|' + r"@'[\s\S]*?'@" + r'|"[^"`\n]*(?:`[\s\S][^"`\n]*)*"' + "|'[^']*'"), ("variable", r"\$\{[^}\n]*\}|\$[A-Za-z_][A-Za-z0-9_:]*|\$[_?$^]"),
        ("command", "[A-Za-z]+-[A-Za-z]+"), ("option", "-[A-Za-z]+"), ("type", r"\[[A-Za-z][A-Za-z0-9_.]*\]"), _NUMBER, _WORD, _MARK,
    ],
    "config": [
        ("comment", _HASH), ("string", r'"""[\s\S]*?"""|' + f"{_DOUBLE}|{_SINGLE}"), ("number", r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"), ("constant", "(?:true|false|null|yes|no)\\b"), ("word", "[A-Za-z_][A-Za-z0-9_.-]*"), ("mark", "---|[{}:,=|>]|\\[|\\]"),
    ],
}
#: Family by language id; text for all others.
FAMILY_OF = {
    0: "python", 1: "markup", 2: "script", 3: "style", 4: "prose", 5: "script", 6: "query", 7: "rust", 8: "php", 9: "markup", 10: "clike", 11: "clike", 12: "clike", 13: "clike", 14: "clike", 15: "shell",
    16: "config", 17: "config", 18: "config", 19: "powershell",
}


def kinds(family: str) -> list[tuple[str, str]]:
    return [*FAMILIES[family], _BLANK, _REST]


def pattern(family: str) -> str:
    """The one pattern of all tokens of a family."""
    return "|".join(f"(?:{p})" for _, p in kinds(family))


def tokens(text: Column, family: str) -> Column:
    """The tokens of a text in order; they join to the text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern(family)), F.lit(0))


def tokens_by_language(text: Column, language_id: Column) -> Column:
    """The tokens under the family of a language id; unknown and null ids are prose."""
    chosen = [F.when(language_id.isin(*[i for i, f in FAMILY_OF.items() if f == family]), tokens(text, family)) for family in FAMILIES if family != "prose"]
    return F.coalesce(*chosen, tokens(text, "prose"))


def kind_of(token: Column, family: str) -> Column:
    """The first kind whose pattern a whole token fits."""
    return reduce(lambda rest, k: F.when(token.rlike(f"^(?:{k[1]})$"), k[0]).otherwise(rest), reversed(kinds(family)[:-1]), F.lit("other"))
