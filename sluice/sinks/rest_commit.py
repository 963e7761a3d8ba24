"""Transactional REST loads: every batch is delivered once, also when tasks or the whole load are run again.

Rows are numbered densely in an explicit order and cut into batches by their
numbers, so batch k holds the same rows whatever the data layout.  Batches are
sent by a Python data source writer.  A task keeps a ledger of the batches that
the endpoint has acknowledged, in a folder that all executors share, and skips
them when it is tried again; the same goes for a second run under the same load
id.  Each request also carries a key made of load id and batch, for the one
case no client can decide: a task lost between sending a batch and noting it.
Tasks report counts in their commit messages, and the load is complete when
the writer's commit has written the summary.
"""

from __future__ import annotations

import json
import time
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.numbering import number_rows
from ..session import checkpoint_dir
from ..sources.rest import _load_transport, _transport_option
from ..specs import ApiDestination

#: Batches whose acknowledgements are one ledger entry, and that one task sends.
UNIT = 64
#: Different error texts of a task that travel to the driver; the ledger holds all.
TOLD = 5


class AckFolder:
    """Ledger entries in a folder of any store that pyarrow reaches.

    An entry is written to two files in turn and read from the one that says
    more, so a writer that dies half-way leaves the entry before it.
    """

    def __init__(self, folder: str):
        from pyarrow import fs

        parts = urlsplit(folder)
        if parts.scheme in ("", "file"):
            self.fs, self.root = fs.LocalFileSystem(), parts.path
        else:
            self.fs, self.root = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
        self.fs.create_dir(self.root, recursive=True)

    def _path(self, name: str, slot: int) -> str:
        return f"{self.root.rstrip('/')}/{name}-{slot}.json"

    def read(self, name: str) -> dict | None:
        found = []
        for slot in (0, 1):
            try:
                with self.fs.open_input_stream(self._path(name, slot)) as f:
                    found.append(json.loads(f.read()))
            except (FileNotFoundError, ValueError):
                continue
        return max(found, key=lambda e: e["version"], default=None)

    def write(self, name: str, entry: dict) -> None:
        entry["version"] = entry.get("version", 0) + 1
        with self.fs.open_output_stream(self._path(name, entry["version"] % 2)) as f:
            f.write(json.dumps(entry).encode())


class Sent(WriterCommitMessage):
    """What a task says of its batches."""

    def __init__(self, counts: dict, errors: list[str]):
        self.counts, self.errors = counts, errors


class BatchWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.url, self.method = options["url"], options["method"]
        self.headers = json.loads(options["headers"])
        self.transport = options.get("transport")
        self.folder, self.load_id = options["folder"], options["load_id"]
        self.attempts, self.delay = int(options["attempts"]), float(options["delay"])

    def _send(self, transport, batch: int, body: str) -> str | None:
        """The error of a batch that was not taken, None if it was."""
        headers = self.headers | {"Idempotency-Key": f"{self.load_id}-{batch}"}
        error = None
        for attempt in range(1, self.attempts + 1):
            try:
                status = transport(self.method, self.url, body, headers)
                if status is None or 200 <= int(status) < 300:
                    return None
                error = f"HTTP {status}"
            except Exception as exc:  # a batch that fails is reported, not raised
                error = str(exc) or type(exc).__name__
            if attempt < self.attempts and self.delay:
                time.sleep(self.delay * attempt)
        return error

    def write(self, iterator):
        acks, transport = AckFolder(self.folder), _load_transport(self.transport)
        counts = {"batches": 0, "records": 0, "sent": 0, "skipped": 0, "failed_batches": 0}
        errors: dict[str, None] = {}
        unit, entry = None, None
        for row in iterator:
            batch, records = row["batch"], row["records"]
            if batch // UNIT != unit:
                unit = batch // UNIT
                entry = acks.read(f"unit-{unit}") or {"acked": [], "failed": {}}
            counts["batches"] += 1
            counts["records"] += records
            if batch in entry["acked"]:
                counts["skipped"] += 1
                counts["sent"] += records
                continue
            error = self._send(transport, batch, row["body"])
            if error is None:
                entry["acked"].append(batch)
                entry["failed"].pop(str(batch), None)
                counts["sent"] += records
            else:
                entry["failed"][str(batch)] = {"records": records, "error": error}
                counts["failed_batches"] += 1
                if len(errors) < TOLD:
                    errors[error] = None
            acks.write(f"unit-{unit}", entry)
        return Sent(counts, list(errors))

    def commit(self, messages) -> None:
        told = [m for m in messages if m is not None]
        total = {k: sum(m.counts[k] for m in told) for k in ("batches", "records", "sent", "skipped", "failed_batches")}
        errors = sorted({e for m in told for e in m.errors})[:TOLD]
        acks = AckFolder(self.folder)
        acks.write("committed", (acks.read("committed") or {}) | total | {"errors": errors})

    def abort(self, messages) -> None:
        """What was acknowledged stays in the ledger: the next run goes on from there."""


class RestBatches(DataSource):
    @classmethod
    def name(cls):
        return "sluice_rest_batches"

    def schema(self):
        return "batch long, records long, body string"

    def writer(self, schema, overwrite):
        return BatchWriter(self.options)


def batches(df: DataFrame, dest: ApiDestination, order_by) -> DataFrame:
    """(batch, records, body): JSON bodies of ``batch_size`` consecutive rows in the order of ``order_by``."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    number = "_n"
    while number in df.columns:
        number += "_"
    numbered = number_rows(df, order_by, number, 0)
    each = numbered.select(F.col(number).alias("n"), F.to_json(row, {"ignoreNullFields": "false"}).alias("rec"))
    # a batch is bounded by its size; batches are spread evenly by their numbers
    grouped = each.groupBy(F.floor(F.col("n") / dest.batch_size).alias("batch")).agg(
        F.sort_array(F.collect_list(F.struct("n", "rec"))).alias("r"))
    body = F.concat(F.lit("["), F.array_join("r.rec", ","), F.lit("]"))
    if dest.records_key:
        body = F.concat(F.lit("{" + json.dumps(dest.records_key) + ":"), body, F.lit("}"))
    return grouped.select("batch", F.size("r").cast("long").alias("records"), body.alias("body"))


def ledger_folder(spark, load_id: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/sluice-rest-{load_id}"


def load_batches(df: DataFrame, dest: ApiDestination, load_id: str, order_by=(), transport=None, max_retries: int = 3,
                 retry_delay: float = 0.0, ledger: str | None = None) -> dict:
    """Sends ``df`` in batches and returns the summary of the load.

    ``load_id`` names the load: run again with the same rows, order and batch
    size, it sends only what was not acknowledged.  ``skipped`` counts batches
    that an earlier attempt had delivered.
    """
    spark = df.sparkSession
    spark.dataSource.register(RestBatches)
    folder = ledger or ledger_folder(spark, load_id)
    made = batches(df, dest, order_by).withColumn("unit", F.floor(F.col("batch") / UNIT))
    made = made.repartition("unit").sortWithinPartitions("batch").drop("unit")
    writer = made.write.format("sluice_rest_batches").mode("append")
    options = {"url": dest.url, "method": dest.method, "transport": _transport_option(transport), "folder": folder,
               "headers": json.dumps({**(dest.headers or {}), "Content-Type": "application/json"}), "load_id": load_id,
               "attempts": str(max(1, max_retries)), "delay": str(retry_delay)}
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.save()
    total = AckFolder(folder).read("committed")
    return {"total_records": total["records"], "sent": total["sent"], "failed": total["records"] - total["sent"],
            "failed_batches": total["failed_batches"], "skipped": total["skipped"], "batches": total["batches"],
            "errors": total["errors"]}


def failed_batches(spark, load_id: str, ledger: str | None = None) -> DataFrame:
    """(batch, records, error) of every batch that the endpoint did not take, from the load's ledger."""
    folder = ledger or ledger_folder(spark, load_id)
    entries = spark.read.schema("version long, acked array<long>, failed map<string,struct<records:long,error:string>>").json(
        f"{folder}/unit-*.json").select("version", F.regexp_extract("_metadata.file_path", r"unit-(\d+)-", 1).alias("unit"), "failed")
    last = entries.groupBy("unit").agg(F.max_by("failed", "version").alias("failed"))
    return last.select(F.explode("failed").alias("batch", "f")).select(F.col("batch").cast("long").alias("batch"), "f.records", "f.error")
