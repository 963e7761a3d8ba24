"""File sinks (CSV with header, Parquet), the quarantine
file, job-log lines, and a write report from the written files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..specs import FileDestination


def written_bytes(spark: SparkSession, path: str) -> int:
    """Total size of the data files under ``path`` (metadata only: the
    binary source prunes the content column)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    return int(total)


def write_file(df: DataFrame, dest: FileDestination, mode: str = "overwrite") -> dict:
    """Write a frame as a directory of part files; returns path, rows
    written (counted while writing) and bytes written."""
    obs = Observation("write")
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    fmt = dest.format
    path = dest.output_path
    if fmt == "csv":
        observed.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    elif fmt == "parquet":
        observed.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"Unsupported output format: {fmt}")
    rows = int(obs.get.get("rows", 0))
    return {"output_path": path, "rows_written": rows, "file_size_bytes": written_bytes(df.sparkSession, path)}


def write_quarantine(invalid_with_reasons: DataFrame, path: str) -> dict:
    """Invalid rows plus their ``_validation_errors`` text, as CSV."""
    return write_file(invalid_with_reasons, FileDestination("csv", path))


LOG_SCHEMA = "timestamp string, level string, job_id string, message string, extra string"


def write_log(spark: SparkSession, events: list[dict], path: str) -> None:
    """Append job-log events as JSON lines (one small file per job).

    Events are a handful of stage messages per job, built on the driver.
    """
    if not events:
        return
    rows = []
    for e in events:
        extra = {k: v for k, v in e.items() if k not in ("timestamp", "level", "job_id", "message")}
        rows.append((e.get("timestamp"), e.get("level"), e.get("job_id"), e.get("message"),
                     json.dumps(extra, default=str) if extra else None))
    spark.createDataFrame(rows, LOG_SCHEMA).coalesce(1).write.mode("append").json(path)
