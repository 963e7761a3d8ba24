"""File metadata report: the profile of an uploaded file in one dictionary.

The work runs as the distributed profile operators; only their small
results (one row per column, five samples per column, five preview rows)
reach the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..operators import profile as P
from ..sources.files import scan


def file_metadata(spark: SparkSession, path: str, order_by: str | None = None) -> dict:
    """table_name, row_count, column_count, columns{dtype, missing_count,
    unique_count, sample_values, suggested_type, is_numeric, is_datetime},
    preview, has_missing_values, total_missing_values."""
    df = scan(spark, path)
    summary = P.table_summary(df).first()
    columns = {}
    for r in P.column_profile(df, order_by=order_by).collect():
        columns[r["column_name"]] = {
            "dtype": r["dtype"],
            "missing_count": int(r["missing_count"]),
            "unique_count": int(r["unique_count"]),
            "sample_values": [],
            "suggested_type": r["suggested_type"],
            "is_numeric": bool(r["is_numeric"]),
            "is_datetime": bool(r["is_datetime"]),
        }
    for r in P.first_values(df, df.columns, 5, order_by).orderBy("column_name", "rank").collect():
        columns[r["column_name"]]["sample_values"].append(r["value"])
    preview = [json.loads(r["row"]) for r in P.preview_json(df, order_by, 5).collect()]
    return {
        "table_name": P.table_name_from_path(path),
        "row_count": int(summary["row_count"]),
        "column_count": int(summary["column_count"]),
        "columns": {name: columns[name] for name in df.columns},
        "preview": preview,
        "has_missing_values": bool(summary["has_missing"]),
        "total_missing_values": int(summary["total_missing"]),
    }


def column_report(spark: SparkSession, path: str, column: str, top: int = 10) -> dict:
    """Statistics of one column plus its top values with counts."""
    df = scan(spark, path)
    stats = P.column_stats(df, column).first().asDict()
    stats["top_values"] = [{"value": r["value"], "count": int(r["count"])}
                           for r in P.top_values(df, column, top).collect()]
    return stats
