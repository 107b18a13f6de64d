import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestack.functions.fields import asked_words, field_words, word_positions
from lodestack.operators import direct, index, rank, rerank
from lodestack.plans import retrieval_queries
from tests.compare import difference, duck

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SMALL).exists(), reason="the given tables are not here")
@pytest.mark.parametrize("name", ["rerank_explain", "rerank_topk"])
def test_ranking_again_builds_no_index(spark, monkeypatch, name):
    def build(*args, **options):
        raise AssertionError("a batch of queries needs no index of all terms, words and positions")

    monkeypatch.setattr(index.TextIndex, "build", build)
    monkeypatch.setattr(retrieval_queries, "_INDEXES", {})
    assert difference(spark, duck(SMALL), name, entry.queries()[name], entry.oracle_sql()[name], SMALL) == ""


@pytest.mark.parametrize(("held", "per_block"), [(2_000_000, 16), (9, 1000)])
def test_direct_bm25_equals_the_index(spark, monkeypatch, held, per_block):
    pick = random.Random(3)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(7)]
    texts = [" ".join(pick.choices(words, range(1, 43), k=pick.randrange(1, 40))) for _ in range(90)] + ["", "other thing", "WAA Kelvin waa's İwaa \xe9waa wab\xe9", "waa\x00wab"]
    rows = [(i * 3, pick.choice([None, "", " ".join(pick.choices(words, k=2)).upper()]), t) for i, t in enumerate(texts + texts[:30])]
    docs = spark.createDataFrame(rows, "doc_id long, title string, text string")
    asked = spark.createDataFrame([(f"q{i}", " ".join(pick.choices(words, k=pick.randrange(1, 7)))) for i in range(20)] + [("kelvin", "Kelvin elvin waa's"), ("none", "absent"), ("null", None), ("twice", "waa WAA wab")], "query_id string, query string")
    monkeypatch.setattr(direct.blocks, "QUERY_TERMS", held)
    space = index.SearchSpace(docs, asked)
    for k, boost in ((4, 1.0), (7, 0.0)):
        got = {tuple(r) for r in direct.bm25(docs, asked, k=k, k1=1.2, title_boost=boost, per_block=per_block).collect()}
        assert got == {tuple(r) for r in rank.bm25(space, k=k, k1=1.2, title_boost=boost).collect()} and len(got) > 60
    assert direct.bm25(docs.limit(0), asked).count() == 0 and direct.bm25(docs, asked.limit(0)).count() == 0


def test_asked_words_equal_those_of_the_index(spark):
    texts = ["def parseJSONFile(x): pass\nimport foo from 'pkg/deepThing'\n", "class\tHTTP2Server\nclassy Thing; \xe9class Nope; export default  Main2", "a b 42 x1 parse parse_parse parse " * 9, "", None, "let aBCd = require(\"../Up\nDown\")"]
    paths = ["src/Main_test.PY", ".\\./.\\src\\..\\a.tar.gz", None, ".env", "a//b/", "./docs/README", "x/y.", "..."]
    docs = spark.createDataFrame([(i * 10 + j, p, t) for i, t in enumerate(texts) for j, p in enumerate(paths)], "doc_id long, path string, text string")
    every = {"parse", "json", "file", "foo", "pkg", "deep", "thing", "server", "http2", "main2", "x1", "up", "down", "cd", "bcd", "class"}
    got = {r.doc_id: r for r in asked_words(docs, every).collect()}
    places = {}
    for r in word_positions(docs).collect():
        if r.word in every:
            places.setdefault(r.doc_id, {}).setdefault(r.word, []).append(r.pos)
    wanted = field_words(docs).collect()
    for r in wanted:
        mine = got[r.doc_id]
        assert (mine.path, mine.path_words, mine.stem_words, mine.name_words) == (r.path, r.path_words, r.stem_words, r.name_words)
        assert {*mine.identifier_words} == {*r.identifier_words} & every
        if "\xe9" not in (dict(enumerate(texts))[r.doc_id // 10] or ""):  # there SQL has ASCII word boundaries
            assert {*mine.structure_words} == {*r.structure_words} & every
        assert mine.places == {w: sorted(p) for w, p in places.get(r.doc_id, {}).items()}
    assert len(got) == len(wanted) == 48


def test_asked_words_keep_every_place(spark):
    docs = spark.createDataFrame([(1, "a.py", "parse x1 " * 30 + "parseFile"), (2, None, None)], "doc_id long, path string, text string")
    got = {r.doc_id: r.places for r in asked_words(docs, {"parse", "file"}, places=None).collect()}
    assert got == {1: {"parse": [*range(0, 60, 2), 60], "file": [60]}, 2: {}}


@pytest.fixture(scope="module")
def met_late(spark, tmp_path_factory):
    """A folder whose queries' words come near each other only after their eighth place."""
    far = " ".join(["stuff"] * 15)
    apart = " ".join([f"alpha {far}"] * 8 + [f"beta {far}"] * 8)
    texts = [f"{apart} alpha beta", f"{apart} alpha {' '.join(['stuff'] * 11)} beta", f"{apart} alpha {far} beta", f"alpha {far} " * 8 + "alpha alpha", "beta alpha"]
    docs = [(i, None, t, 0, f"src/part{chr(97 + i)}.py", "all", None) for i, t in enumerate(texts)]
    at = str(tmp_path_factory.mktemp("met-late"))
    spark.createDataFrame(docs, "id long, title string, text string, language_id int, path string, collection string, harvested_at timestamp").write.parquet(f"{at}/bench_docs.parquet")
    spark.createDataFrame([("q", None, "alpha beta", [])], "id string, query_type string, query string, expected_paths array<string>").write.parquet(f"{at}/labelled_queries.parquet")
    return at


@pytest.mark.parametrize("name", ["proximity", "rerank_features"])
def test_words_that_meet_after_their_eighth_place(spark, met_late, name):
    got = {r.doc_id: r.proximity for r in entry.queries()[name](spark, met_late).collect()}
    assert got == {0: 0.6, 1: 0.3, 2: 0.0, 3: 0.6, 4: 0.6}
    assert difference(spark, duck(met_late), name, entry.queries()[name], entry.oracle_sql()[name], met_late) == ""


def test_gap_between(spark):
    row = spark.range(1).select(*[rerank.gap_between(F.array(*map(F.lit, q)), F.expr("map('a', array(9, 30), 'b', array(2, 14), 'c', array(9))")).alias(n) for n, q in (("ab", "ab"), ("ac", "ac"), ("c", "cx"), ("a", "a"), ("x", "x"))]).first()
    assert tuple(row) == (5, 0, None, 21, None)


def test_latest_apart(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, "c", 2), (2, "d", None), (3, "e", None), (3, "f", 1)], "id long, text string, at long")
    got = {tuple(r) for r in index.latest_apart(rows, ["id"], ["text"], "at").collect()}
    assert got == {tuple(r) for r in index.latest(rows, ["id"], ["text"], "at").collect()} == {(1, "b"), (2, "d"), (3, "f")}
