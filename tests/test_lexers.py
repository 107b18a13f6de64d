import pytest
from pyspark.sql import functions as F

from lodestack.functions import lexers

CASES = {
    "python": ('@cached\nx = f"a\\"b" # n\ny = """two\nlines"""', ['@cached', '\n', 'x', ' ', '=', ' ', 'f"a\\"b"', ' ', '# n', '\n', 'y', ' ', '=', ' ', '"""two\nlines"""']),
    "markup": ('<!-- c --><a href="x">&amp;hi</a>', ["<!-- c -->", "<a", " ", "href", "=", '"x"', ">", "&amp;", "hi", "</a", ">"]),
    "script": ("let $a = `b\nc` ?? 0x1F; // d", ["let", " ", "$a", " ", "=", " ", "`b\nc`", " ", "??", " ", "0x1F", ";", " ", "// d"]),
    "style": (".a{color:#fff;top:-1.5em}", [".a", "{", "color", ":", "#fff", ";", "top", ":", "-1.5em", "}"]),
    "prose": ("It's 42...", ["It's", " ", "4", "2", "..."]),
    "query": ("SELECT 'it''s' -- c", ["SELECT", " ", "'it''s'", " ", "-- c"]),
    "rust": ("fn f<'a>() { p!('x'); }", ["fn", " ", "f", "<", "'a", ">", "(", ")", " ", "{", " ", "p!", "(", "'x'", ")", ";", " ", "}"]),
    "php": ("<?php $a .= 'b';", ["<?php", " ", "$a", " ", ".=", " ", "'b'", ";"]),
    "clike": ("#include <x>\nint a /* c */ = 1;", ["#include", " ", "<", "x", ">", "\n", "int", " ", "a", " ", "/* c */", " ", "=", " ", "1", ";"]),
    "shell": ('cp -r "$A" ${B:-x} && ls', ["cp", " ", "-r", " ", '"$A"', " ", "${B:-x}", " ", "&&", " ", "ls"]),
    "powershell": ("Get-Item -Path $x <# c #>", ["Get-Item", " ", "-Path", " ", "$x", " ", "<# c #>"]),
    "config": ('key: [1, "a"] # c', ["key", ":", " ", "[", "1", ",", " ", '"a"', "]", " ", "# c"]),
}


def test_tokens_of_each_family(spark):
    assert set(CASES) == set(lexers.FAMILIES)
    rows = spark.createDataFrame([(f, t) for f, (t, _) in CASES.items()], "family string, text string")
    for family, (_, wanted) in CASES.items():
        assert rows.where(F.col("family") == family).select(lexers.tokens(F.col("text"), family)).first()[0] == wanted


def test_dispatch_and_edge_cases(spark):
    rows = spark.createDataFrame([(1, 0, "x # y"), (2, -1, "x # y"), (3, None, "it's"), (4, 6, None), (5, 3, ""), (6, 13, "`a\u0000é🙏`")], "id int, language int, text string")
    got = {r.id: r.t for r in rows.select("id", lexers.tokens_by_language(F.col("text"), F.col("language")).alias("t")).collect()}
    assert got == {1: ["x", " ", "# y"], 2: ["x", " ", "#", " ", "y"], 3: ["it's"], 4: [], 5: [], 6: ["`a\u0000é🙏`"]}


@pytest.mark.parametrize("family", list(lexers.FAMILIES))
def test_every_text_comes_back(spark, family):
    import random

    pick = random.Random(family)
    texts = ["".join(pick.choice("abZ_09 \t\r\n\"'`#/*-<>!&;$@{}[]().=:\\é🙏ß") for _ in range(pick.randrange(0, 120))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert rows.where(F.array_join(lexers.tokens(F.col("text"), family), "") != F.col("text")).count() == 0
