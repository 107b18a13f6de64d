import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.operators import chunking, codec, dense, evaluate, index, rank, rerank, store

DOCS = [(1, "auth", "bearer token middleware bearer", "src/auth.py"), (2, "billing", "invoice total", "src/billing.py"), (3, None, "", None), (4, "auth notes", "token token token", "docs/auth.md"), (5, "copy", "token token token", "docs/copy.md")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, title string, text string, path string").cache()


def queries(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, query string")


def test_a_floor_changes_no_result(spark):
    import random

    pick = random.Random(5)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(10)]
    docs = spark.createDataFrame([(i, "", f"p/{i}.py", " ".join(pick.choices(words, range(1, 81), k=pick.randrange(5, 60)))) for i in range(400)], "doc_id long, title string, path string, text string")
    asked = spark.createDataFrame([(f"q{i}", " ".join(pick.choices(words, range(1, 81), k=9))) for i in range(12)], "query_id string, query string")
    space = index.SearchSpace(docs, asked)
    parts = space.postings.join(space.idf, "term").select("term", "doc_id", rank.bm25_term(F.col("idf"), F.col("tf"), F.col("dl"), space.avgdl, 1.2, 0.75).alias("c"))
    wanted = space.query_terms.select("qn", "term", F.col("qtf").cast("double").alias("w"))
    for k, rows in ((3, 40), (10, 300), (500, 50)):
        got = [sorted(tuple(r) for r in rank.top_sums(space, wanted, parts, k, floor_pairs=pairs, first_rows=rows).collect()) for pairs in (0, 10**9)]
        assert got[0] == got[1] and len(got[0]) > 30


@pytest.mark.parametrize("held", [2_000_000, 7])
def test_blocks_of_documents_equal_brute_force(spark, monkeypatch, held):
    import random

    pick = random.Random(8)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(6)]
    made = [" ".join(pick.choices(words, range(1, 31), k=pick.randrange(1, 30))) for _ in range(80)]
    texts = dict(enumerate([*made, *made, "other"]))  # equal scores everywhere
    asked = {f"q{i}": " ".join(pick.choices(words, k=4)) for i in range(7)} | {"none": "absent"}
    docs = spark.createDataFrame([(i, t.split()[0], t) for i, t in texts.items()], "doc_id long, title string, text string")
    space = index.SearchSpace(docs, spark.createDataFrame(list(asked.items()), "query_id string, query string"))
    monkeypatch.setattr(rank.blocks, "QUERY_TERMS", held)
    shared = {(q, i): len({*asked[q].split()} & {*t.split()}) for q in asked for i, t in texts.items()}
    assert {(r.query_id, r.candidates) for r in rank.candidates(space).collect()} == {(q, sum(n > 0 for (p, _), n in shared.items() if p == q)) for q in asked if q != "none"}

    def best(scores, k):
        out = set()
        for q in asked:
            mine = sorted((-v, i) for (p, i), v in scores.items() if p == q and v > 0)
            out |= {(q, n, i, -v) for n, (v, i) in enumerate(mine[:k], 1)}
        return out

    cosines = {(q, i): math.floor(n / math.sqrt(len({*asked[q].split()}) * len({*texts[i].split()})) * 1e6 + 0.5) / 1e6 for (q, i), n in shared.items()}
    assert {tuple(r) for r in rank.binary_cosine(space, index.doc_stats(docs), k=5).collect()} == best(cosines, 5)
    owners = spark.createDataFrame([(i, i // 3 if i > 8 else None) for i in texts], "doc_id long, owner long")
    pooled: dict = {}
    for (q, i), n in shared.items():
        key = (q, i // 3 if i > 8 else rank.blocks.NO_OWNER)
        pooled[key] = max(n, pooled.get(key, 0))
    assert {(r.query_id, r.rank, rank.blocks.NO_OWNER if r.owner is None else r.owner, r.score) for r in rank.best_owners(space, owners, k=4).collect()} == best(pooled, 4)

    monkeypatch.setattr(rank.top_sums, "__defaults__", (10**9, 16))
    plain = {tuple(r) for r in rank.bm25(space, k=6, title_boost=1.0).collect()}
    monkeypatch.setattr(rank.top_sums, "__defaults__", (0, 16))
    ranked = rank.bm25(space, k=6, title_boost=1.0)
    assert {tuple(r) for r in ranked.collect()} == plain and len(plain) > 30
    for r in rank.matched_terms(space, ranked).collect():
        assert r.matched is None or set(r.matched) == {*asked[r.query_id].split()} & {*texts[r.doc_id].split()}


def test_list_heads_cross_segments(spark):
    rows = spark.createDataFrame([("a", i * 3) for i in range(100)] + [("b", 7)], "term string, doc_id long")
    got = sorted((r.term, r.doc_id) for r in rank.list_heads(rows, 30, segment=16).collect())
    assert got == [("a", i * 3) for i in range(30)] + [("b", 7)]


def test_bm25_by_hand(spark, docs):
    space = index.SearchSpace(docs, queries(spark, "bearer token", None, "", "unknown"))
    got = [(r.query_id, r.rank, r.doc_id, r.score) for r in rank.bm25(space).orderBy("query_id", "rank").collect()]
    n, avgdl = 5, (4 + 2 + 0 + 3 + 3) / 5
    idf = lambda df: math.log((n - df + 0.5) / (df + 0.5) + 1)
    part = lambda i, tf, dl: i * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))
    first = round(part(idf(1), 2, 4) + part(idf(3), 1, 4), 6)
    tied = round(part(idf(3), 3, 3), 6)
    assert got == [("q0", 1, 1, first), ("q0", 2, 4, tied), ("q0", 3, 5, tied)]


def test_title_boost_brings_in_documents(spark, docs):
    space = index.SearchSpace(docs, queries(spark, "billing auth"))
    assert {r.doc_id for r in rank.bm25(space, title_boost=1.0).collect()} == {1, 2, 4}


def test_selective_cap_stops_the_walk(spark, docs):
    space = index.SearchSpace(docs, queries(spark, "bearer invoice"))
    assert [r.doc_id for r in rank.selective_search(space, cap=1).collect()] == [1]
    assert {r.doc_id for r in rank.selective_search(space, cap=100).collect()} == {1, 2}


def test_fusion_and_merge(spark):
    a = spark.createDataFrame([("q", 1, 10), ("q", 2, 20)], "query_id string, rank int, doc_id long")
    b = spark.createDataFrame([("q", 1, 20), ("q", 2, 30)], "query_id string, rank int, doc_id long")
    assert [r.doc_id for r in rank.reciprocal_rank_fusion([a, b]).orderBy("rank").collect()] == [20, 10, 30]
    assert [(r.doc_id, r.source) for r in rank.merge_first(a, b).orderBy("rank").collect()] == [(10, 0), (20, 0), (30, 1)]


def test_postings_segments_are_bounded(spark):
    tf = spark.range(0, 10_000).select(F.col("id").alias("doc_id"), F.lit("the").alias("term"), F.lit(1).alias("tf"))
    rows = index.postings_segments(tf).collect()
    assert len(rows) == 3 and max(len(r.doc_ids) for r in rows) == index.SEGMENT
    assert index.postings_gaps(tf).agg(F.max("gap")).first()[0] == 1


def test_code_words_and_paths(spark):
    row = spark.range(1).select(
        T.code_words(F.lit("HTTPServer parse_jsonFile x 42 a1")).alias("w"), T.file_stem(F.lit(".\\src\\my.test.py")).alias("stem"), T.file_ending(F.lit("a/.env")).alias("dot"), T.language_of(F.lit("X.TSX")).alias("lang"),
        T.unsafe_path(F.lit("a/../b")).alias("up"), T.unsafe_path(F.lit("a/b")).alias("fine"), T.windowed_snippet(F.lit("x" * 300 + " needle " + "y" * 300), F.array(F.lit("needle")), 60).alias("snip"), T.word_stems(F.lit("running")).alias("stems"),
    ).first()
    assert row.w == ["a1", "file", "http", "json", "parse", "server"]
    assert (row.stem, row.dot, row.lang, row.up, row.fine) == ("my.test", "", 5, True, False)
    assert "needle" in row.snip and len(row.snip) <= 60 and row.snip.startswith("...") and row.snip.endswith("...")
    assert row.stems == ["runn", "run", "runne"]


def test_fixed_chunks_cover_the_text(spark):
    frame = spark.createDataFrame([(1, "x" * 4000), (2, ""), (3, None), (4, "y" * 1800), (5, "z" * 1801)], "doc_id long, text string")
    got = {r.doc_id: r.n for r in chunking.fixed_chunks(frame, F.col("text")).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 1 + math.ceil((4000 - 1800) / 1620), 2: 1, 3: 1, 4: 1, 5: 2}


def test_rerank_prefers_the_named_file(spark, docs):
    from lodestack.functions.fields import field_words, word_positions

    ranked = spark.createDataFrame([("q0", 1, 4), ("q0", 2, 1)], "query_id string, rank int, doc_id long")
    asked = spark.createDataFrame([("q0", "code of auth in src")], "query_id string, expanded string")
    rows = rerank.features(ranked, asked, field_words(docs), word_positions(docs))
    assert [r.doc_id for r in rerank.rerank(rows).orderBy("rank").collect()][0] == 1
    assert {r.feature for r in rerank.explain(rows).where("doc_id = 1").collect()} >= {"src_path_intent", "explicit_src_path", "exact_stem"}


def test_metrics_by_hand(spark, docs):
    asked = spark.createDataFrame([("a", "t", ["src/auth.py"]), ("b", None, ["docs/copy.md", "gone.md"]), ("c", "t", [])], "query_id string, query_type string, expected_paths array<string>")
    ranked = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("b", 2, 5), ("c", 1, 1)], "query_id string, rank int, doc_id long")
    first = evaluate.first_hits(ranked, evaluate.resolve_judgements(asked, docs), asked)
    row = evaluate.metrics(first).first()
    assert (row.queries, row.hit_at_1, row.mrr, row.recall_at_k) == (3, 0.3333, 0.5, 0.6667)
    assert {r.kind for r in evaluate.metrics(first, by="query_type").collect()} == {"t", "unlabelled", "(all)"}
    assert [r.seen for r in evaluate.running_metrics(first).orderBy("query_id").collect()] == [1, 2, 3]


def test_nearest_rank(spark):
    frame = spark.createDataFrame([("g", v) for v in range(1, 21)] + [("g", None)], "g string, v long")
    assert evaluate.nearest_rank(frame, "v", 95, ["g"]).first().value == 19


ODD = ["", "ß İ é́ \U0001f64f\x00 end", "a\r\nb\r\n", "1234567 00", "    x", "�", "αααα", "if if if if", "\U0001f600" * 5, "tab\t\t\tx"]


def test_codec_round_trip(spark):
    texts = spark.createDataFrame([(i, t, None if i % 2 else 4) for i, t in enumerate(ODD)] + [(99, None, 4)], "id long, text string, language_id int")
    words = codec.vocabulary(texts.where("text is not null"), 6).cache()
    packed = codec.encode(texts, words, 6).cache()
    assert packed.count() == len(ODD)
    assert all(r.length_ok and r.checksum_ok and r.lossless for r in codec.verify(texts, packed, words, 6).collect())
    broken = spark.createDataFrame([(1, bytearray(b"nothing")), (2, None)], "id long, payload binary")
    assert {r.text for r in codec.decode(broken.where("payload is not null"), words, 6).collect()} == {None}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40))
def test_runs_shorten_and_expand(ids):
    assert codec._expand(codec._shorten(ids)) == ids  # noqa: SLF001


def test_dense_blocks(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)] + [(50, None), (51, []), (52, [1.0])], "doc_id long, embedding array<double>")
    asked = rows.where("doc_id < 4").select(F.col("doc_id").alias("query_id"), "embedding")
    got = dense.dense_topk(rows, asked, 2, block_bytes=32).where("query_id = 3").orderBy("rank").collect()
    assert [r.doc_id for r in got] == [19, 18]
    assert {r.doc_id for r in dense.dense_topk(rows, asked, 2, block_bytes=32).where("query_id = 0").collect()} == {0, 1}


def test_upsert_and_tombstones(spark):
    old = spark.createDataFrame([(1, "a", 1, "2024-01-01"), (1, "b", 2, "2024-01-01")], "pack_id long, source string, v int, packed_at string")
    new = spark.createDataFrame([(1, "a", 3, "2024-02-01"), (1, "a", 4, "2024-03-01"), (1, "c", 5, "2024-03-01")], old.schema)
    merged = store.upsert(old, new, ["pack_id", "source"], "packed_at")
    assert {(r.source, r.v) for r in merged.collect()} == {("a", 4), ("b", 2), ("c", 5)}
    gone = spark.createDataFrame([(1, "a", "2024-02-15"), (1, "b", "2024-02-15"), (1, "b", "2024-01-15")], "pack_id long, source_path string, deleted_at string")
    assert {r.source for r in store.without_deleted(merged, gone).collect()} == {"a", "c"}
    with pytest.raises(ValueError):
        store.decode_policy(merged, "sometimes")
