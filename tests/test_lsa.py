import math
import random
from collections import Counter

import numpy as np
import pytest

from lodestack.operators import lsa


def test_directions_equal_a_dense_decomposition(spark):
    pick = random.Random(2)
    words = [f"w{chr(97 + i)}" for i in range(12)]
    docs = [pick.choices(words[(i % 3) * 4 : (i % 3) * 4 + 6], k=15) for i in range(90)]
    rows = [(i, w, n) for i, d in enumerate(docs) for w, n in Counter(d).items()]
    counts = spark.createDataFrame(rows, "doc_id long, term string, tf long")
    latent = lsa.fit(counts, 90, dims=3, rounds=25)
    df = Counter(w for d in docs for w in set(d))
    place = {r.term: r.place for r in latent.features.collect()}
    matrix = np.zeros((90, len(place)))
    for i, w, n in rows:
        matrix[i, place[w]] = n * (math.log(91 / (df[w] + 1)) + 1)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    _, values, axes = np.linalg.svd(matrix)
    assert latent.singular == pytest.approx(values[:3], rel=1e-6)
    assert np.abs(np.linalg.svd(axes[:3] @ latent.basis)[1] - 1).max() < 1e-4
    got = {r.doc_id: r.embedding for r in latent.vectors(counts, "doc_id").collect()}
    wanted = matrix @ latent.basis
    wanted /= np.linalg.norm(wanted, axis=1, keepdims=True)
    assert np.abs(np.array([got[i] for i in range(90)]) - wanted).max() < 1e-5


def test_no_terms_give_no_directions(spark):
    empty = spark.createDataFrame([], "doc_id long, term string, tf long")
    latent = lsa.fit(empty, 0)
    assert latent.basis.shape == (0, 0) and latent.vectors(empty, "doc_id").count() == 0
    stop = spark.createDataFrame([(1, "the", 2)], "doc_id long, term string, tf long")
    assert lsa.fit(stop, 1).vectors(stop, "doc_id").count() == 0
