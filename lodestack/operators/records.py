"""Records that were delivered more than once: one row per id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_records(df: DataFrame, id_col: str, text_col: str, order_col: str | None = None) -> DataFrame:
    """One row ``(id, text)`` per id with a text: the copy with the greatest ``order_col``.

    Copies without a time come before all others; ties go to the greater text, so the result does
    not depend on row order.  Rows with a null id or null text are left out.
    """
    columns = [F.col(id_col).alias("id"), F.col(text_col).alias("text")]
    if order_col is None:
        return df.select(*columns).where("id is not null and text is not null").groupBy("id").agg(F.max("text").alias("text"))
    rows = df.select(*columns, F.col(order_col).alias("at")).where("id is not null and text is not null")
    return rows.groupBy("id").agg(F.max(F.struct(F.col("at"), F.col("text"))).alias("best")).select("id", F.col("best.text").alias("text"))
