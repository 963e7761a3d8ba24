"""Loads into file tables whose integer key counts up by itself."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.numbering import fill_keys


def largest_key(spark, path: str, key: str) -> int | None:
    """The largest key of the table at ``path``; None if there is no table, no row or no key."""
    try:
        target = spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return target.agg(F.max(F.col(f"`{key}`").cast("long"))).first()[0] if key in target.columns else None


def append_keyed(df: DataFrame, path: str, key: str, order_by) -> dict:
    """Appends ``df`` to the Parquet table at ``path``; rows without a key get the next numbers.

    The numbers are dense and in the order of ``order_by``, and go on from the
    target's largest key.  One load at a time may append to a table.
    """
    largest = largest_key(df.sparkSession, path, key)
    seen = Observation()
    filled = fill_keys(df, key, order_by, largest).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.min(f"`{key}`").alias("first"), F.max(f"`{key}`").alias("last"))
    filled.write.mode("append").parquet(path)
    return {"rows_written": seen.get["rows"], "first_key": seen.get["first"], "last_key": seen.get["last"]}
