"""REST sink: rows are sent as JSON batches by the tasks that hold them.

Rows are turned into JSON text JVM-side (``to_json``); each task groups its
rows into batches of ``batch_size`` and sends them through a transport, with
retries.  The result is one report row per batch (a DataFrame), summarised
into sent / failed counts without collecting rows.  Batches are formed per
partition, so batch boundaries follow the data layout, not a global order.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..specs import ApiDestination
from ..sources.rest import default_transport

#: Error texts that a summary shows, the most frequent first; the report has those of all batches.
ERRORS = 20
REPORT_SCHEMA = "batch_id string, records long, ok boolean, error string"


def send_batches(
    df: DataFrame,
    dest: ApiDestination,
    transport=None,
    max_retries: int = 3,
    retry_delay: float = 0.0,
) -> DataFrame:
    """One report row per batch sent (lazy; runs when acted on)."""
    transport = transport or default_transport
    headers = dict(dest.headers or {})
    headers["Content-Type"] = "application/json"
    url, method, size, key = dest.url, dest.method, dest.batch_size, dest.records_key
    attempts = max(1, max_retries)

    def send(batches):
        import uuid

        import pandas as pd

        task = uuid.uuid4().hex[:12]
        pending: list[str] = []
        seq = 0

        def flush(records):
            nonlocal seq
            body = "[" + ",".join(records) + "]"
            if key:
                body = '{"' + key + '":' + body + "}"
            error = None
            for attempt in range(1, attempts + 1):
                try:
                    status = transport(method, url, body, headers)
                    if status is None or 200 <= int(status) < 300:
                        error = None
                        break
                    error = f"HTTP {status}"
                except Exception as exc:  # a failed batch is reported, not raised
                    error = str(exc)
                if attempt < attempts and retry_delay:
                    time.sleep(retry_delay * attempt)
            seq += 1
            return (f"{task}-{seq}", len(records), error is None, error)

        for pdf in batches:
            out = []
            for rec in pdf["rec"]:
                pending.append(rec)
                if len(pending) == size:
                    out.append(flush(pending))
                    pending = []
            if out:
                yield pd.DataFrame(out, columns=["batch_id", "records", "ok", "error"])
        if pending:
            yield pd.DataFrame([flush(pending)], columns=["batch_id", "records", "ok", "error"])

    # every record carries all its keys; missing values are JSON null
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    records = df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("rec"))
    return records.mapInPandas(send, REPORT_SCHEMA)


def send_summary(report: DataFrame) -> dict:
    """total_records, sent, failed, failed batch count and the most frequent error texts.

    The report is acted on once: a lazy one sends its batches by that.
    """
    by_error = materialize(report.groupBy("ok", "error").agg(F.sum("records").alias("records"), F.count(F.lit(1)).alias("batches")))
    row = by_error.agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("records"))), F.lit(0)).alias("sent"),
        F.coalesce(F.sum(F.when(~F.col("ok"), F.col("batches"))), F.lit(0)).alias("failed_batches"),
    ).first()
    texts = by_error.filter(~F.col("ok") & F.col("error").isNotNull()).orderBy(F.desc("batches"), "error").limit(ERRORS)
    return {
        "total_records": int(row["total"]),
        "sent": int(row["sent"]),
        "failed": int(row["total"]) - int(row["sent"]),
        "failed_batches": int(row["failed_batches"]),
        "errors": [r["error"] for r in texts.collect()],
    }
