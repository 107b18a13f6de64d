"""Run registered queries beside their SQL and print what differs: python tests/compare.py SF NAME..."""

from __future__ import annotations

import datetime
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def plain(value):
    """A value that compares alike from Spark and from DuckDB."""
    if isinstance(value, float):
        return float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None) if value.tzinfo is None else value.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return float(value) if value.__class__.__name__ == "Decimal" else value


def duck(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    connection.sql("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{source}'")
    return connection


def rows_of(names: list[str], data) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def difference(spark, connection, name: str, query, sql: str, sf_dir: str) -> str:
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = connection.sql(sql)
    theirs = rows_of(result.columns, result.fetchall())
    if sorted(df.columns) != sorted(result.columns):
        return f"columns {sorted(df.columns)} against {sorted(result.columns)}"
    if ours != theirs:
        a, b = set(ours) - set(theirs), set(theirs) - set(ours)
        return f"{len(ours)} against {len(theirs)} rows; only ours {len(a)}: {sorted(a, key=repr)[:3]}; only SQL {len(b)}: {sorted(b, key=repr)[:3]}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from lodestack.session import build_session

    sf = f"/root/testdata/{sys.argv[1]}"
    spark = build_session(master=f"local[{os.environ.get('CPUS', '8')}]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle, connection = entry.queries(), entry.oracle_sql(), duck(sf)
    names = [n for a in sys.argv[2:] for n in queries if n == a or a == "all" or (a.endswith("*") and n.startswith(a[:-1]))]
    for name in names:
        began = time.time()
        try:
            if name in oracle:
                said = difference(spark, connection, name, queries[name], oracle[name], sf) or "equal"
            else:
                said = f"{queries[name](spark, sf).count()} rows, no SQL"
        except Exception as error:  # noqa: BLE001
            said = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
