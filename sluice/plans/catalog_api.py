"""Registered queries of the REST source and sink, whole jobs with several destinations, and job logs.

No port is opened: the transports read and write files in the checkpoint
folder, as an endpoint would.
"""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from ..operators.validation import validate
from ..session import scratch_path
from ..sinks.rest_commit import load_batches
from ..sources.files import read_parquet
from ..sources.rest import read_api
from ..specs import ApiDestination, ApiSource, FileDestination, JobSpec
from ..streaming.pages import resume_api
from . import ledger
from .catalog import register, table

#: Records of a page and of a batch.
PAGE, BATCH = 500, 250
API = "http://api/"


def _served_events(spark, sf_dir, linked: bool):
    """A transport that serves the events as pages of ``PAGE`` records, which Spark wrote as one folder a page."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    numbered = number_rows(events, "event_id", "n", 0).withColumn("page", F.floor(F.col("n") / PAGE) + 1)
    record = F.to_json(F.struct("event_id", "user_id", "event_type", "value"), {"ignoreNullFields": "false"})
    made = numbered.groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", record.alias("r")))),
                                                                 lambda x: x["r"]), ",").alias("items"))
    after = F.concat(F.lit(f', "next": "{API}?page='), F.col("page") + 1, F.lit('"')) if linked else F.lit("")
    folder = scratch_path(spark)
    made.select("page", F.concat(F.lit('{"items": ['), F.col("items"), F.lit("]"), after, F.lit("}")).alias("body")).write.partitionBy(
        "page").text(folder)
    local = urlsplit(folder).path

    def get(method, url, body, headers):
        import glob
        import re

        page = re.search(r"[?&]page=(\d+)", url)[1]
        found = glob.glob(f"{local}/page={page}/part-*")
        return open(found[0], encoding="utf-8").read() if found else '{"items": []}'

    return get


_EVENTS = "SELECT event_id, user_id, event_type, value FROM events"


@register("api_pages_numbered", _EVENTS)
def api_pages_numbered(spark, sf_dir):
    return read_api(spark, ApiSource(url=API, records_key="items"), _served_events(spark, sf_dir, False))


@register("api_pages_linked", _EVENTS)
def api_pages_linked(spark, sf_dir):
    source = ApiSource(url=API, records_key="items", next_url_key="next")
    return resume_api(spark, source, scratch_path(spark), _served_events(spark, sf_dir, True))


@register("api_pages_resumed", _EVENTS)
def api_pages_resumed(spark, sf_dir):
    # the second call finds every round complete and fetches nothing
    source, folder, get = ApiSource(url=API, records_key="items"), scratch_path(spark), _served_events(spark, sf_dir, False)
    resume_api(spark, source, folder, get)

    def closed(method, url, body, headers):
        raise OSError("nothing may be fetched again")

    return resume_api(spark, source, folder, closed)


def _inbox(spark):
    """(folder, transport that writes each request's body to a file of its own)."""
    folder = scratch_path(spark)
    local = urlsplit(folder).path

    def put(method, url, body, headers):
        import os

        os.makedirs(local, exist_ok=True)
        batch = headers["Idempotency-Key"].rpartition("-")[2]
        with open(f"{local}/batch-{batch}.json", "a", encoding="utf-8") as f:
            f.write(body + "\n")
        return 201

    return folder, put


def _received(spark, folder: str, fields: str) -> DataFrame:
    """The records that arrived, with the number of their batch; a batch sent twice shows twice."""
    lines = spark.read.text(f"{folder}/batch-*.json").select(
        F.regexp_extract("_metadata.file_path", r"batch-(\d+)", 1).cast("long").alias("batch"),
        F.explode(F.from_json(F.get_json_object("value", "$.rows"), f"array<struct<{fields}>>")).alias("r"))
    return lines.select("batch", "r.*")


@register(
    "api_sink_batches",
    f"""SELECT CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // {BATCH} AS BIGINT) AS batch, o_orderkey, o_orderstatus
        FROM orders""",
)
def api_sink_batches(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    folder, put = _inbox(spark)
    dest = ApiDestination(url=API, batch_size=BATCH, records_key="rows")
    result = load_batches(orders, dest, "orders", "o_orderkey", put, ledger=scratch_path(spark))
    if result["failed"]:
        raise RuntimeError(str(result["errors"]))
    return _received(spark, folder, "o_orderkey:bigint,o_orderstatus:string")


@register(
    "job_fan_out",
    """WITH kept AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P')
       SELECT 'file' AS destination, * FROM kept UNION ALL SELECT 'api', * FROM kept""",
)
def job_fan_out(spark, sf_dir):
    from .jobs import run_job

    src, out = scratch_path(spark) + ".parquet", scratch_path(spark)
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").write.parquet(src)
    folder, put = _inbox(spark)
    result = run_job(spark, JobSpec(
        file_source={"path": src}, filters=[{"column": "o_orderstatus", "operator": "neq", "value": "P"}], order_by="o_orderkey",
        file_destination=FileDestination("parquet", out),
        api_destination=ApiDestination(url=API, batch_size=BATCH, records_key="rows", exactly_once=True)), transport=put)
    if not result["success"] or result["details"]["api"]["failed"]:
        raise RuntimeError(result["message"])
    files = read_parquet(spark, out).select(F.lit("file").alias("destination"), "o_orderkey", "o_orderstatus")
    sent = _received(spark, folder, "o_orderkey:bigint,o_orderstatus:string")
    return files.unionByName(sent.select(F.lit("api").alias("destination"), "o_orderkey", "o_orderstatus"))


@register(
    "job_log_lines",
    """WITH v AS (SELECT count(*) FILTER (o_totalprice <= 300000) AS valid, count(*) FILTER (o_totalprice > 300000) AS invalid
                  FROM orders)
       SELECT 'INFO' AS level, 'Validation: ' || valid || ' valid, ' || invalid || ' invalid' AS message, invalid AS invalid_count,
              valid AS processed FROM v""",
)
def job_log_lines(spark, sf_dir):
    from .jobs import run_job

    src, logs = scratch_path(spark) + ".parquet", scratch_path(spark)
    table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").write.parquet(src)
    result = run_job(spark, JobSpec(
        file_source={"path": src}, order_by="o_orderkey", file_destination=FileDestination("parquet", scratch_path(spark)),
        validation_rules=[{"column": "o_totalprice", "rule_type": "max_value", "params": {"max": 300000}}]), log_dir=logs)
    lines = ledger.read_logs(spark, logs).filter(F.col("message").startswith("Validation"))
    return lines.select("level", "message", F.get_json_object("extra", "$.invalid_count").cast("long").alias("invalid_count"),
                        F.lit(int(result["processed_rows"])).cast("long").alias("processed"))


register("validate_unknown_column", "SELECT s_suppkey, s_name FROM supplier")(
    lambda spark, d: validate(table(spark, d, "supplier").select("s_suppkey", "s_name"), [
        {"column": "no_such_column", "rule_type": "not_null"}], order_by="s_suppkey").valid.select("s_suppkey", "s_name"))
