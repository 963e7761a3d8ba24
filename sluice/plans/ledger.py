"""Job ledger and logs as append-only tables.

Every state change of a job is one appended row (job_id, request_hash,
state, ts, result).  The latest state per job is ``max_by`` over ts - a
per-job aggregate with map-side partial aggregation - and entries older than
the retention window are ignored.  An identical request (same SHA-256 of its
canonical JSON) within the window returns the earlier job.

Of equal requests at the same moment one is run: each submitter tries to put a
claim under the request's hash, which succeeds for the first one only.  As
every entry is a small file, :func:`compact` writes the entries into a snapshot;
a manifest that is put in place in one step names the snapshot and the files
that it covers, so a reader sees each entry once, before and after.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import json
import os
import uuid
from urllib.parse import urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C

LEDGER_SCHEMA = "job_id string, request_hash string, state string, ts timestamp, result string"
# Entries are partitioned by the day of their time.
DAY = "day"
LOG_SCHEMA = "timestamp string, level string, job_id string, message string, extra string"


# --- fixed value: what names a request, the SHA-256 of its JSON text with sorted keys ---
def request_hash(request) -> str:
    fields = request.to_dict() if hasattr(request, "to_dict") else dict(request)
    return hashlib.sha256(json.dumps(fields, sort_keys=True, default=str).encode()).hexdigest()


def record(spark: SparkSession, path: str, job_id: str, req_hash: str, state: str, result: dict | None = None,
           ts: _dt.datetime | None = None) -> None:
    ts = ts or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    row = [(job_id, req_hash, state, ts, json.dumps(result, default=str) if result is not None else None)]
    entry = spark.createDataFrame(row, LEDGER_SCHEMA).coalesce(1).withColumn(DAY, F.to_date("ts"))
    entry.write.mode("append").partitionBy(DAY).parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All entries: those of the snapshot in force and those that came after it."""
    schema = f"{LEDGER_SCHEMA}, {DAY} date"
    entries = spark.read.schema(schema).parquet(path)
    manifest = _manifest(spark, path)
    if manifest is None:
        return entries
    tail = [f for f in entries.inputFiles() if f not in set(manifest["covered"])]
    snapshot = spark.read.schema(schema).parquet(f"{path}/{manifest['snapshot']}")
    if not tail:
        return snapshot
    return snapshot.unionByName(spark.read.schema(schema).option("basePath", path).parquet(*tail))


def latest_states(spark: SparkSession, path: str, ttl_hours: int = C.LEDGER_TTL_HOURS,
                  now: _dt.datetime | None = None) -> DataFrame:
    """job_id, request_hash, state, ts, result of each job's last entry
    within the retention window."""
    now = now or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    cutoff = now - _dt.timedelta(hours=ttl_hours)
    # the days before the cutoff are pruned, so the cost follows the window, not the ledger's age
    led = read_ledger(spark, path).filter((F.col("ts") >= F.lit(cutoff)) & (F.col(DAY) >= F.lit(cutoff.date())))
    last = led.groupBy("job_id").agg(
        F.max_by(F.struct("request_hash", "state", "ts", "result"), F.col("ts")).alias("s")
    )
    return last.select("job_id", "s.request_hash", "s.state", "s.ts", "s.result")


def find_job(spark: SparkSession, path: str, req_hash: str, ttl_hours: int = C.LEDGER_TTL_HOURS,
             now: _dt.datetime | None = None):
    """(job_id, state, result) of the newest job for this request, or None."""
    try:
        states = latest_states(spark, path, ttl_hours, now)
        hit = states.filter(F.col("request_hash") == req_hash).orderBy(F.desc("ts")).limit(1).collect()
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None  # no ledger yet
    if not hit:
        return None
    r = hit[0]
    return r["job_id"], r["state"], json.loads(r["result"]) if r["result"] else None


def pending_requests(requests: DataFrame, spark: SparkSession, path: str, hash_col: str = "request_hash",
                     ttl_hours: int = C.LEDGER_TTL_HOURS, now: _dt.datetime | None = None) -> DataFrame:
    """Requests with no job in the ledger window (anti-join on the hash)."""
    seen = latest_states(spark, path, ttl_hours, now).select(F.col("request_hash").alias(hash_col)).distinct()
    return requests.join(seen, hash_col, "left_anti")


# names that begin with an underscore are no data to Spark's readers
CLAIMS, MANIFESTS = "_claims", "_manifests"


def _file_system(spark: SparkSession, path: str):
    """(Hadoop path maker, its file system) for a path."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make, make(path).getFileSystem(spark._jsc.hadoopConfiguration())


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Whether the file ``path`` was put with ``text``; false if there is one already.  Never seen half-written.

    A file is written aside and then linked (local folders) or renamed to its
    name, which fails where the name is taken.
    """
    make, fs = _file_system(spark, path)
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    out = fs.create(make(aside))
    out.write(bytearray(text.encode()))
    out.close()
    if fs.getScheme() == "file":
        local, target = (urlsplit(p).path if p.startswith("file:") else p for p in (aside, path))
        try:
            os.link(local, target)
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(make(aside), False)
    if not fs.exists(make(path)) and fs.rename(make(aside), make(path)):
        return True
    fs.delete(make(aside), False)
    return False


def _numbered(spark: SparkSession, folder: str, prefix: str) -> list[tuple[int, dict]]:
    """(number, content) of the files ``prefix-<number>`` of a folder, in order."""
    make, fs = _file_system(spark, folder)
    out = []
    for status in fs.globStatus(make(f"{folder}/{prefix}-*")) or []:
        name = status.getPath().getName()
        if not name.endswith(".tmp"):
            stream = fs.open(status.getPath())
            text = bytes(stream.readAllBytes()).decode()
            stream.close()
            out.append((int(name.rpartition("-")[2]), json.loads(text)))
    return sorted(out, key=lambda x: x[0])


def claim(spark: SparkSession, path: str, req_hash: str, job_id: str, ttl_hours: int = C.LEDGER_TTL_HOURS,
          now: _dt.datetime | None = None) -> str:
    """The job that holds the request: ``job_id`` if the claim was free or had expired, else the earlier job."""
    now = now or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    folder = f"{path}/{CLAIMS}"
    while True:
        held = _numbered(spark, folder, req_hash)
        if held and _dt.datetime.fromisoformat(held[-1][1]["ts"]) >= now - _dt.timedelta(hours=ttl_hours):
            return held[-1][1]["job_id"]
        after = held[-1][0] + 1 if held else 0
        if put_if_absent(spark, f"{folder}/{req_hash}-{after}", json.dumps({"job_id": job_id, "ts": now.isoformat()})):
            return job_id


def _manifest(spark: SparkSession, path: str) -> dict | None:
    found = _numbered(spark, f"{path}/{MANIFESTS}", "manifest")
    return found[-1][1] if found else None


def compact(spark: SparkSession, path: str, ttl_hours: int | None = None, now: _dt.datetime | None = None) -> bool:
    """Puts all entries of this moment into a snapshot; false if another compaction was first.

    With ``ttl_hours``, entries older than the window are left out.  Files that
    the snapshot before covered are removed: no reader that started since then needs them.
    """
    schema = f"{LEDGER_SCHEMA}, {DAY} date"
    found = _numbered(spark, f"{path}/{MANIFESTS}", "manifest")
    number, before = (found[-1][0] + 1, found[-1][1]) if found else (0, None)
    files = list(spark.read.schema(schema).parquet(path).inputFiles())
    old = set(before["covered"]) if before else set()
    entries = spark.read.schema(schema).option("basePath", path).parquet(*[f for f in files if f not in old]) if set(files) - old else None
    if before:
        snapshot = spark.read.schema(schema).parquet(f"{path}/{before['snapshot']}")
        entries = snapshot if entries is None else snapshot.unionByName(entries)
    if entries is None:
        return False
    if ttl_hours is not None:
        now = now or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
        entries = entries.filter(F.col("ts") >= F.lit(now - _dt.timedelta(hours=ttl_hours)))
    name = f"_snapshot-{number}-{uuid.uuid4().hex[:8]}"
    entries.repartition(DAY).write.partitionBy(DAY).parquet(f"{path}/{name}")
    if not put_if_absent(spark, f"{path}/{MANIFESTS}/manifest-{number}", json.dumps({"snapshot": name, "covered": files})):
        return False
    make, fs = _file_system(spark, path)
    for file in old:
        fs.delete(make(file), False)
    return True


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Job-log lines (JSON); malformed lines are skipped."""
    return spark.read.schema(LOG_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def log_summary(logs: DataFrame) -> DataFrame:
    """Per job: total events, errors, warnings."""
    return logs.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("level") == "ERROR").alias("errors"),
        F.count_if(F.col("level") == "WARNING").alias("warnings"),
    )
