"""Session defaults, table reading and the shared scratch folder.

Multi-pass operators cut their lineage by writing a Parquet table below the folder that the
cluster names in ``spark.checkpoint.dir``; every executor can read it, so losing one costs no
recomputation of earlier passes.  Where the setting is absent (tests, a laptop) a private folder is
made, but only on a ``local`` master.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()
_WRITTEN: dict[str, list[str]] = {}

#: Bytes that may be broadcast after they have been measured.
BROADCAST_BYTES = 32 << 20


def build_session(app: str = "lodestack", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the library expects; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    return builder.config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-lodestack-")) / "lodestack.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The Parquet table ``table`` of the data folder ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-lodestack-")
    return _LOCAL_DIRS[context.applicationId]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestack-{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> int:
    """Delete the tables that :func:`materialize` wrote in this application; results still unread are lost."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)  # noqa: SLF001
    return len(paths)


def measured_bytes(df: DataFrame) -> int:
    """The bytes that the rows of ``df`` take in memory, by one aggregate over it."""
    total = F.lit(16 + 8 * len(df.columns)).cast("long")
    for field in df.schema.fields:
        kind, column = field.dataType.simpleString(), F.col(f"`{field.name}`")
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(column), F.lit(0))
        elif kind.startswith("array<") and kind[6:-1] in ("int", "bigint", "float", "double"):
            total = total + 8 * F.coalesce(F.size(column), F.lit(0))
        elif kind.startswith(("array<", "map<", "struct<")):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
    return df.agg(F.coalesce(F.sum(total), F.lit(0))).first()[0]


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of ``df`` only after measuring at most ``limit`` bytes; larger ones keep the shuffle join.

    ``df`` is read twice, so it should be a table that is written already (:func:`materialize`) or a small one.
    """
    return F.broadcast(df) if measured_bytes(df) <= limit else df
