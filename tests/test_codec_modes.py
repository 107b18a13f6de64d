import html
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.operators import codec


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.just(7)), max_size=80), st.sampled_from(codec.RUN_MODES), st.integers(1, 30))
def test_every_run_mode_expands_to_the_same(ids, mode, block):
    spelled = [x for i in ids for x in ((codec.CODE_POINT, 7) if i == 3 else (i,))]
    assert codec._expand(codec.shorten(spelled, mode, 0.02, block)) == spelled


def test_run_modes():
    runs, plain = [1] * 500, list(range(500))
    assert len(codec.shorten(runs, "auto")) == len(codec.shorten(runs, True)) == 3 and codec.shorten(runs, False) == runs
    assert codec.shorten(plain, "auto") == plain and codec.shorten([], "auto") == []
    for wrong in ("sometimes", "AUTO "):
        with pytest.raises(ValueError):
            codec.run_mode(wrong)
    with pytest.raises(ValueError):
        codec.shorten(runs, "auto", block=0)


def test_both_ways_to_ids_agree(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "a b  b b c é🙏 a\u0000"), (2, ""), (3, "a" * 50 + "\r\n"), (4, "ß ß ß ß")], "id long, text string").withColumn("language_id", F.lit(4))
    vocab = codec.vocabulary(texts, 3).cache()
    ways = []
    for limit in (codec.BROADCAST_BYTES, 0):
        monkeypatch.setattr(codec, "BROADCAST_BYTES", limit)
        ids = {r.id: r.ids for r in codec.token_ids(texts, vocab, 3).collect()}
        packed = codec.encode(texts, vocab, 3).cache()
        ways.append((ids, {r.id: r.text for r in codec.decode(packed, vocab, 3).collect()}))
    assert ways[0] == ways[1] and ways[0][1] == {r.id: r.text for r in texts.collect()}


def test_migration_keeps_current_and_broken_payloads(spark):
    texts = spark.createDataFrame([(i, f"word{i} word other{i % 3}") for i in range(12)], "id long, text string").withColumn("language_id", F.lit(None).cast("int"))
    vocab = codec.vocabulary(texts, 8).cache()
    small = codec.prefix(vocab, 3)
    old = codec.encode(texts.where("id < 6"), small, 3).union(codec.encode(texts.where("id >= 6"), vocab, 8, version=2))
    old = old.union(spark.createDataFrame([(99, bytearray(b"LDST\x00\x01broken.........."))], "id long, payload binary")).cache()
    moved = codec.migrate(old, small, 3, vocab, 8, 2).cache()
    assert {r.id: r.version for r in codec.headers(moved).collect()} == {**{i: 2 for i in range(12)}, 99: 1}
    assert {r.id: r.text for r in codec.decode(moved.where("id < 99"), vocab, 8).collect()} == {r.id: r.text for r in texts.collect()}


def test_spellings(spark):
    rows = spark.createDataFrame([("Caf&eacute;",), ("user’s getHTTPUrl2x",), ("don't",), ("plain",), ("",), (None,)], "t string")
    got = [r.v for r in rows.select(T.text_variants(F.col("t")).alias("v")).collect()]
    assert got[0] == ["Café", "Cafe", "cafe"] and got[2] == ["dont"] and got[3] == got[4] == got[5] == []
    assert got[1][-1].endswith("get http url 2 x") and html.unescape("&lt;") == "<" and unicodedata.normalize("NFKD", "ﬁ") == "fi"
