"""The name model of problem 2 rests on all chunks."""

import math
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("lodestack.llm")

from lodestack.llm import handwritten as h  # noqa: E402

OWN = "def measure_signal(left_value, right_value):\n    total_value = left_value + right_value\n    return open_window(total_value, {})\n"
MANGLED = "\n".join(f"qx{a}zk = vj{b}wq ( xq{b}kz , zv{a}jx )" for a, b in zip("bcdfg", "hjklm", strict=True)) + "\n"


def test_chunks_beyond_any_sample_teach_the_model(spark):
    """Of 31,000 chunks a sample of 30,000 by the hash of the text left out all copies of a text of high hash."""
    names = spark.range(4000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("n"))
    text = F.format_string(OWN.replace("{}", "%s"), "n")
    skipped = names.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) > int(30_000 / 31_000 * (1 << 20)) + 1).first().text
    own = spark.range(31_000).select((F.col("id") % 50).cast("int").alias("page_index"), F.lit("src/a.py").alias("source_path"), F.lit(skipped).alias("text"), F.lit(0).alias("language_id"))
    frame = own.union(spark.createDataFrame([(100, "src/b.py", MANGLED, 0)], own.schema))
    got = {r.page_index: set(r.signals) for r in h.file_signals(frame).collect()}
    assert got.pop(100) == {"entropy"} and set(map(frozenset, got.values())) == {frozenset()} and len(got) == 50


def trigrams(name: str) -> list[int]:
    letters = {**{chr(97 + i): i for i in range(26)}, **dict.fromkeys("0123456789", 26), "_": 27, "$": 28}
    codes = [29, 29, *(letters[c] for c in name.lower()), 30]
    return [(a * 31 + b) * 31 + c for a, b, c in zip(codes, codes[1:], codes[2:], strict=False)]


def entropy(model: h.NameModel, lang: str, name: str) -> float:
    grams = trigrams(name)
    return sum(model.bits[lang][g] for g in grams) / len(grams)


def test_trigrams_of_many_names():
    names = ["a", "Zz_9$", "_x", "", "HTTPServer2"]
    for array in (pa.array(names), pa.array(["left out", *names])[1:], pa.array([], pa.string())):
        grams, sizes = h.trigrams(array)
        assert grams.tolist() == [g for n in array.to_pylist() for g in trigrams(n)] and sizes.tolist() == [len(n) + 1 for n in array.to_pylist()]


def test_model_and_usual_values_equal_brute_force(spark):
    texts = [OWN.format(f"part_{chr(97 + i % 26)}" * (1 + i % 3)) * 3 for i in range(40)] + ["", "# Code generated by maker.\n" + OWN, "x = 1\n"]
    rows = [(i, "a.py" if i % 4 else "b.rs", 0, t) for i, t in enumerate(texts)] + [(len(texts), "c", None, texts[3])]
    chunks = h.read_chunks(spark.createDataFrame(rows, "page_index long, path string, language_id int, text string")).cache()
    counts: dict = {}
    plain = [(h.language(p, n), *h.names_of(t)) for _, p, n, t in rows if t and not h.declared(p, t)]
    for lang, _, names in plain:
        counts.setdefault(lang, Counter()).update(g for name in names for g in trigrams(name))
    model, brute = h.train(chunks), h.NameModel(counts)
    assert model.bits.keys() == brute.bits.keys() == {"python", "rust", "id-1", None} and all((model.bits[k] == brute.bits[k]).all() for k in brute.bits)
    priced = h.priced(chunks, model)
    for r in priced.collect():
        names = h.names_of(rows[r.page_index][3])[1]
        assert r.size == len(names) and math.isclose(r.cost, sum(entropy(brute, r.lang, n) for n in names), abs_tol=1e-9)
    costs = sorted(sum(entropy(brute, lang, n) for n in names) / len(names) for lang, _, names in plain if len(names) >= h.LEAST_NAMES and lang == "python")
    usual = {r.lang: r for r in h.usual(priced).collect()}
    everything = sorted(sum(entropy(brute, lang, n) for n in names) / len(names) for lang, _, names in plain if len(names) >= h.LEAST_NAMES)
    python, every = costs[(len(costs) - 1) // 2], everything[(len(everything) - 1) // 2]
    enough = sum(lang == "python" for lang, _, _ in plain) >= h.LEAST_CHUNKS
    assert enough and math.isclose(usual["python"].usual_cost, python) and math.isclose(usual[None].usual_cost, every)
    assert math.isclose(usual["rust"].usual_cost, max(every, usual["rust"].usual_cost))
