import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.compare import difference, duck

SMALL = "/root/testdata/sf0.001"
CHEAP = ["bm25_search", "rerank_topk", "token_ids", "stream_event_windows", "serving_search", "append_upsert"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path(SMALL).exists(), reason="the given tables are not here")
@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, name):
    assert difference(spark, duck(SMALL), name, entry.queries()[name], entry.oracle_sql()[name], SMALL) == ""


def test_the_core_does_not_import_the_subpackage():
    root = Path(__file__).resolve().parents[1]
    code = "import sys; import lodestack.plans.store_queries, lodestack.plans.evaluation_queries; assert not any(m.startswith('lodestack.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_sources(spark, tmp_path):
    from lodestack.sources import corpus

    for name, body in {"a.py": "x = 1", "b.bin": "?", "node_modules/c.js": "y", "d.md": "z" * 50}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    rows = {Path(r.path).name: r.reason for r in corpus.source_files(spark, str(tmp_path), max_bytes=20).collect()}
    assert rows == {"a.py": None, "b.bin": "unsupported_ext", "c.js": "excluded_dir", "d.md": "too_large"}
    (tmp_path / "rows.jsonl").write_text('{"content": "hello", "path": "p"}\n{"text": "  "}\n')
    assert [tuple(r) for r in corpus.json_lines(spark, str(tmp_path / "rows.jsonl")).collect()] == [("p", "hello")]
    corpus.write_table(spark.range(100), str(tmp_path / "t"), "id")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 100


def test_scratch_tables_can_be_cleared(spark):
    from lodestack.session import clear_scratch, materialize

    kept = materialize(spark.range(5), "t")
    assert kept.count() == 5 and clear_scratch(spark) >= 1 and clear_scratch(spark) == 0
