import pytest
from pyspark.sql import functions as F

from lodestack import api

SCHEMA = "doc_id long, title string, path string, text string"


def test_store_life_cycle(spark, tmp_path):
    docs = spark.createDataFrame([(1, "auth", "src/auth.py", "bearer token middleware"), (2, "billing", "src/billing.py", "invoice total"), (3, None, None, None)], SCHEMA)
    opened = api.Store.create(spark, str(tmp_path / "s"), docs, vocabulary_size=4)
    asked = spark.createDataFrame([("a", "bearer middleware")], "query_id string, query string")
    assert [(r.doc_id, r.path) for r in opened.search(asked).collect()] == [(1, "src/auth.py")]
    assert tuple(opened.verify().first()) == (2, 2, 0)
    assert opened.inspect().first().documents == 2
    opened.append(spark.createDataFrame([(1, "auth", "src/auth.py", "replaced by cookies"), (4, "n", "n.md", "new")], SCHEMA))
    opened.delete(spark.createDataFrame([(2,)], "doc_id long"))
    assert {(r.doc_id, r.text) for r in opened.documents().collect()} == {(1, "replaced by cookies"), (3, None), (4, "new")}
    # what was appended is found, read and verified at once; what was replaced or deleted is gone
    asked = spark.createDataFrame([("a", "cookies"), ("b", "bearer"), ("c", "invoice"), ("d", "new")], "query_id string, query string")
    assert {(r.query_id, r.doc_id) for r in opened.search(asked).collect()} == {("a", 1), ("d", 4)}
    assert {tuple(r) for r in opened.read(spark.createDataFrame([(1,), (2,), (4,)], "doc_id long")).collect()} == {(1, "replaced by cookies"), (4, "new")}
    assert tuple(opened.verify().first()) == (2, 2, 0)
    with pytest.raises(ValueError):
        opened.append(docs.withColumn("path", F.lit("../up.py")))
    opened.append(spark.createDataFrame([(2, "billing", "src/billing.py", "invoice again")], SCHEMA))
    assert {(r.query_id, r.doc_id) for r in opened.search(asked).collect()} == {("a", 1), ("c", 2), ("d", 4)}
    opened.reindex()
    assert {(r.query_id, r.doc_id) for r in opened.search(asked).collect()} == {("a", 1), ("c", 2), ("d", 4)}
    assert {tuple(r) for r in opened.read(spark.createDataFrame([(4,)], "doc_id long")).collect()} == {(4, "new")}
    with pytest.raises(ValueError):
        api.Store.create(spark, str(tmp_path / "t"), docs.withColumn("path", F.lit("../up.py")))


def test_encryption_detects_tampering(spark):
    key = api.derive_key("pass phrase", b"salt", "low-memory")
    rows = spark.createDataFrame([(1, bytearray(b"payload"))], "id long, payload binary")
    sealed = api.encrypted(rows, key)
    assert bytes(api.decrypted(sealed, key).first().payload) == b"payload"
    assert api.decrypted(sealed, api.derive_key("other", b"salt", "low-memory")).first().payload is None
    assert api.decrypted(sealed.withColumn("sealed", F.concat("sealed", F.lit(b"x"))), key).first().payload is None
    assert api.decrypted(sealed, key, aad="another").first().payload is None
