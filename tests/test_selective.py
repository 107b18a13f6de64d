"""Selective search by places where walks end, path fallback in one sum, positions document by document, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.functions.fields import placed_words, word_positions
from lodestack.operators import index, rank
from lodestack.plans.text_queries import title_fallback_frame


@pytest.fixture(scope="module")
def collection(spark):
    pick = random.Random(11)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    line = lambda n: " ".join(pick.choices(words, range(1, 37), k=n))
    docs = {i * 7 % 5000: (line(2), line(pick.randrange(1, 25)), f"{pick.choice(words)}/{pick.choice(words)}_{pick.choice(words)}.py") for i in range(150)}
    asked = {f"q{i}": line(pick.randrange(1, 8)) for i in range(25)} | {"none": "absent", "null": None}
    frame = spark.createDataFrame([(i, *v) for i, v in docs.items()], "doc_id long, title string, text string, path string")
    return frame, docs, spark.createDataFrame(list(asked.items()), "query_id string, query string"), asked


def walked(turns: list[tuple[str, list[int]]], cap: int) -> set[tuple[int, int]]:
    """The (turn, document) rows that a walk keeps: those before which fewer than ``cap`` different documents were met."""
    met, kept = set(), set()
    for turn, (_, ids) in enumerate(turns, 1):
        for i in sorted(ids):
            if len(met) >= cap:
                return kept
            kept.add((turn, i))
            met.add(i)
    return kept


@pytest.mark.parametrize("cap", [1, 13, 40, 2000])
def test_walks_end_where_rows_would(spark, collection, cap):
    frame, docs, queries, _ = collection
    space = index.SearchSpace(frame, queries)
    terms = space.query_terms.join(space.idf, "term").selectExpr("qn", "term", "df", "row_number() OVER (PARTITION BY qn ORDER BY df DESC, term) AS turn")
    got = {r.qn: (r.end_turn, r.end_doc) for r in rank.walk_ends(terms, space.postings, cap, queries=4).collect()}
    lists = {t: [i for i, v in docs.items() if t in v[1].split()] for t in {w for v in docs.values() for w in v[1].split()}}
    by_query: dict = {}
    for r in terms.orderBy("qn", "turn").collect():
        by_query.setdefault(r.qn, []).append((r.term, lists[r.term]))
    for qn, turns in by_query.items():
        every = {(n, i) for n, (_, ids) in enumerate(turns, 1) for i in ids}
        assert {x for x in every if qn not in got or x <= got[qn]} == walked(turns, cap)


@pytest.mark.parametrize(("cap", "k"), [(10, 3), (60, 5), (2000, 10)])
def test_selective_search_equals_brute_force(spark, collection, cap, k):
    frame, docs, queries, _ = collection
    space = index.SearchSpace(frame, queries)
    names = {r.qn: r.query_id for r in space.numbers.collect()}
    scale, rows = max(1.0, math.log(len(docs) + 1)), {}
    for r in rank.token_types(space).collect():
        w = 0.0 if r.df == 0 else max(0.35, r.idf / scale) if r.kind in ("rare", "identifier/path") else r.idf / scale
        if w >= 0.05:
            rows.setdefault(r.qn, []).append((-round(w, 9), r.df, -round(r.idf, 9), r.term, w, r.idf))
    want = set()
    avgdl = sum(len(v[1].split()) for v in docs.values()) / len(docs)
    for qn, terms in rows.items():
        terms.sort()
        kept = walked([(t[3], [i for i, v in docs.items() if t[3] in v[1].split()]) for t in terms], cap)
        scores = []
        for i, (title, text, _) in docs.items():
            if round(sum(t[4] for n, t in enumerate(terms, 1) if (n, i) in kept), 9) >= 0.35:
                dl = len(text.split())
                part = lambda t: t[4] * t[5] * (tf := text.split().count(t[3])) * 2.2 / (tf + (0.25 + 0.75 * dl / avgdl) * 1.2)  # noqa: B023, E731
                score = round(sum(part(t) for t in terms) + sum(t[3] in title.split() for t in terms), 6)
                scores.append((-score, i))
        want |= {(names[qn], n, i) for n, (_, i) in enumerate(sorted(scores)[:k], 1)}
    assert {(r.query_id, r.rank, r.doc_id) for r in rank.selective_search(space, k=k, cap=cap).collect()} == want and len(want) > 15


def test_path_fallback_equals_brute_force(spark, collection, tmp_path):
    frame, docs, queries, asked = collection
    found = index.TextIndex.build(frame, f"file://{tmp_path}/index")
    paths = {i: {*path[:-3].replace("_", "/").split("/")} for i, (_, _, path) in docs.items()}
    df = {w: sum(w in p for p in paths.values()) for p in paths.values() for w in p}
    want = set()
    for q, text in asked.items():
        scores = []
        for i, p in paths.items():
            if hit := p & {*(text or "").split()}:
                scores.append((-len(hit), -round(sum(1 + math.log((len(docs) - df[w] + 0.5) / (df[w] + 0.5) + 1) for w in hit), 6), i))
        want |= {(q, n, i, -m, -s) for n, (m, s, i) in enumerate(sorted(scores)[:6], 1)}
    assert {(r.query_id, r.rank, r.doc_id, r.matched, r.score) for r in title_fallback_frame(found, queries, 6).collect()} == want and len(want) > 60


def test_positions_by_document_equal_those_by_window(spark):
    texts = ["HTTPServer parse_jsonFile x 42 a1 HTTPServer", "", None, "aBC aBc ABc _x __ x_1 " * 12, "É Ünit naïveName\nfoo", "fooFoo foo_foo FOO9 9foo"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lambda df: sorted((r.doc_id, r.word, r.pos) for r in df.collect())
    assert rows(placed_words(frame)) == rows(word_positions(frame))


def test_snippets_in_steps(spark):
    rows = spark.createDataFrame([("x" * 300 + " Needle " + "y" * 300, ["none", "needle"]), ("short", ["z"]), (None, ["z"]), ("a" * 500, [])], "text string, terms array<string>")
    steps = rows.select("*", F.trim("text").alias("body")).select("*", T.first_place(F.lower("body"), F.col("terms")).alias("at"))
    assert all(r.a == r.b for r in steps.select(T.snippet_around(F.col("body"), F.col("at"), 60).alias("a"), T.windowed_snippet(F.col("text"), F.col("terms"), 60).alias("b")).collect())
