import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestack.llm.term_frequency import TERM_PATTERN, interval_counts, marked_terms, ngram_counts, term_codes

TEXTS = ["the cat the cat the dog", "the dog the cat", "Ångström ÅNGSTRÖM a x×y naïve", "", "zz zz zz zz", "the cat the cat the dog"]


def brute(texts, max_n=None):
    total, docs = Counter(), Counter()
    deepest = max_n or max((len(re.findall(TERM_PATTERN, t)) for t in texts), default=0)
    for text in texts:
        words = [w.lower() for w in re.findall(TERM_PATTERN, text)]
        grams = [" ".join(words[i : i + n]) for n in range(1, deepest + 1) for i in range(len(words) - n + 1)]
        total.update(grams)
        docs.update(set(grams))
    return {g: (total[g], docs[g]) for g in total}


def test_counts_equal_brute_force(spark):
    frame = spark.createDataFrame([(t, "n") for t in [*TEXTS, None]], "text string, term string")
    got = {r.term: (r.n_total, r.n_docs) for r in ngram_counts(frame, "text", 4).collect()}
    assert got == brute(TEXTS, 4)
    got = {r.term: (r.n_total, r.n_docs) for r in ngram_counts(frame, "text", None).collect()}
    assert got == brute(TEXTS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab ", max_size=30), max_size=8), st.one_of(st.none(), st.integers(1, 5)))
def test_suffix_intervals(texts, max_n):
    texts = [re.sub("([ab])", r"\1\1", t) for t in texts]
    codes, record, terms = term_codes(texts, re.compile(TERM_PATTERN))
    words = terms.to_pylist()
    got = {}
    for n, at, total, docs in interval_counts(codes, record, max_n):
        for p, t, d in zip(at.tolist(), total.tolist(), docs.tolist(), strict=True):
            got[" ".join(words[c] for c in codes[p : p + n])] = (t, d)
    assert got == brute(texts, max_n)


def test_records_count_once_and_marks(spark):
    rows = [(i, f"shared word{chr(97 + i)}x" if i else "shared alpha beta", None if i % 2 else "2024-01-01") for i in range(10)] + [(1, "shared wordbx", "2024-02-01"), (50, None, None), (None, "lost words", None)]
    frame = spark.createDataFrame(rows, "id long, text string, at string")
    got = {r.term: (r.n_total, r.n_docs, r.mark) for r in marked_terms(frame, "id", "text", "at").collect()}
    assert got["shared"] == (10, 10, "common") and got["alpha"] == (1, 1, "rare") and "lost" not in got
    assert marked_terms(spark.createDataFrame([], "id long, text string, at string"), "id", "text", "at").count() == 0


def test_one_term_in_every_record_and_a_very_long_text(spark):
    frame = spark.createDataFrame([(i, "hot") for i in range(3000)] + [(5000, "hot cold " * 100_000)], "id long, text string")
    got = {r.term: (r.n_total, r.n_docs) for r in marked_terms(frame, "id", "text").collect()}
    assert got == {"hot": (103_000, 3001), "cold": (100_000, 1)}


def test_all_phrases_keep_the_rare_ones(spark, tmp_path):
    from lodestack.llm.corpus_queries import QUERIES

    spark.createDataFrame([(1, "red lamp on", 1), (2, "red lamp off", 1), (3, "red lamp", 1)], "id long, text string, harvested_at long").write.parquet(f"{tmp_path}/bench_docs.parquet")
    got = {(r.n, r.term): (r.n_total, r.n_docs) for r in QUERIES["p4_all_phrases"](spark, str(tmp_path)).collect()}
    assert got == {(1, "red"): (3, 3), (1, "lamp"): (3, 3), (1, "on"): (1, 1), (1, "off"): (1, 1), (2, "red lamp"): (3, 3), (2, "lamp on"): (1, 1), (2, "lamp off"): (1, 1), (3, "red lamp on"): (1, 1), (3, "red lamp off"): (1, 1)}
