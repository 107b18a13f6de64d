import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestack.llm.components import connected_components
from lodestack.llm.near_duplicates import NearDuplicates, band_keys, shingle_sets, super_min_hash


def brute_pairs(texts: dict[int, str], size: int, threshold: float, least: int) -> set[tuple[int, int]]:
    sets = {}
    for i, text in texts.items():
        words = [w.lower() for w in re.findall("[A-Za-z0-9_]+", text)]
        if len(words) >= max(size, least):
            sets[i] = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def corpus(seed: int, families: int, members: int) -> dict[int, str]:
    pick = random.Random(seed)
    texts, key = {}, 0
    for _ in range(families):
        base = [f"w{pick.randrange(400)}" for _ in range(60)]
        for _ in range(members):
            words = list(base)
            for _ in range(pick.randrange(6)):
                words[pick.randrange(len(words))] = f"edit{pick.randrange(1000)}"
            texts[key] = " ".join(words)
            key += 1
    texts[key] = texts[0].upper() + "!"  # the same words in another spelling
    return texts


ROWS = "id long, text string, path string, n long, rep long, band long"


def frame(spark, texts):
    rows = [(i, t, "p", 1, 2, 3) for i, t in texts.items()]
    rows += rows[:3] + [(None, "a b c d e f g", None, None, None, None), (9001, None, None, None, None, None), (9002, "", None, None, None, None), (9003, "too short", None, None, None, None)]
    return spark.createDataFrame(rows, ROWS)


@pytest.mark.parametrize("hot", [200, 2])
def test_pairs_equal_brute_force(spark, hot):
    texts = corpus(3, 12, 5)
    found = NearDuplicates(frame(spark, texts), "id", "text", shingle_words=4, threshold=0.6, least_words=40, hot_bucket=hot)
    pairs = [tuple(r) for r in found.all_pairs().collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == brute_pairs(texts, 4, 0.6, 40)


def test_groups_and_links(spark):
    texts = corpus(4, 6, 4)
    found = NearDuplicates(frame(spark, texts), "id", "text", shingle_words=4, threshold=0.6, least_words=40)
    rows = {r.id: (r.group_id, r.links) for r in found.groups().collect()}
    pairs = brute_pairs(texts, 4, 0.6, 40)
    assert set(rows) == set(texts)
    for a, b in pairs:
        assert rows[a][0] == rows[b][0] <= min(a, b)
    for i in texts:
        assert rows[i][1] == sum(i in p for p in pairs)


def test_a_third_of_the_rows_are_copies(spark):
    texts = {i: "one two three four five six seven eight nine ten" for i in range(40)} | {100 + i: " ".join(f"u{i}_{k}" for k in range(12)) for i in range(80)}
    found = NearDuplicates(frame(spark, texts), "id", "text")
    assert found.all_pairs().count() == 40 * 39 // 2
    assert {r.group_id for r in found.groups().where("id < 40").collect()} == {0}


def test_empty_table(spark):
    found = NearDuplicates(spark.createDataFrame([], ROWS), "id", "text")
    assert found.all_pairs().count() == 0 and found.groups().count() == 0


def test_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    found = NearDuplicates(spark.createDataFrame([(1, long), (2, long + " end")], "id long, text string"), "id", "text")
    assert [tuple(r) for r in found.all_pairs().collect()] == [(1, 2)]


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 60), st.integers(0, 40), st.integers(0, 10**6))
def test_signatures_estimate_similarity(common, own, seed):
    rng = np.random.default_rng(seed)
    shared = rng.integers(0, 2**63, common).astype(np.uint64)
    a = np.unique(np.concatenate([shared, rng.integers(0, 2**63, own).astype(np.uint64)]))
    b = np.unique(np.concatenate([shared, rng.integers(0, 2**63, own).astype(np.uint64)]))
    signed = super_min_hash(np.concatenate([a, b]), np.array([len(a), len(b)]), 512)
    assert abs((signed[0] == signed[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.13


def test_signatures_do_not_depend_on_the_batch():
    shingles, sizes = shingle_sets(["a b c d e f g h", "x y z w v u t s r"], 5, 0)
    whole = band_keys(super_min_hash(shingles, sizes, 12), 4, 3)
    alone, n = shingle_sets(["x y z w v u t s r"], 5, 0)
    assert (band_keys(super_min_hash(alone, n, 12), 4, 3)[0] == whole[1]).all()


def test_a_large_set_is_signed_in_parts():
    elements = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    sizes = np.array([10, 4000, 990])
    assert (super_min_hash(elements, sizes, 24, block=300) == super_min_hash(elements, sizes, 24, block=10**6)).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (3, 2), (None, 5)]
    rows = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(rows[i] == 0 for i in range(51)) and all(rows[100 + i] == 100 for i in range(30))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
