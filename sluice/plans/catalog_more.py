"""More registered queries: plain-column filters, hot keys, guessed dates, error tables, mixed CSV folders,
keys, clustered tables, logs, ledger and job counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import profile as P
from ..operators.filters import apply_filters
from ..operators.mapping import apply_mappings
from ..operators.validation import validate
from ..session import scratch_path
from ..sinks.jdbc import key_violations, write_clustered_table
from ..sources.files import list_files, nan_to_null, output_of, read_csv
from ..specs import ColumnMapping, FileDestination, FilterRule, JobSpec
from . import ledger
from .catalog import _agg_query, _err_sql, _map, register, table
from .catalog_files import write_csv

# ---------------------------------------------------------------------------
# filters on columns as they are stored, so that they reach the Parquet scan

_PLAIN = {
    "filter_plain_eq": ({"column": "l_returnflag", "operator": "eq", "value": "R"}, "l_returnflag = 'R'"),
    "filter_plain_gt": ({"column": "l_quantity", "operator": "gt", "value": 45}, "l_quantity > 45"),
    "filter_plain_lte": ({"column": "l_discount", "operator": "lte", "value": 0.02}, "l_discount <= 0.02"),
    "filter_plain_in": ({"column": "l_linestatus", "operator": "in", "values": ["O", "X"]}, "l_linestatus IN ('O', 'X')"),
}
_PLAIN_COLUMNS = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"]


def _plain(rule):
    def run(spark, sf_dir):
        return apply_filters(table(spark, sf_dir, "lineitem"), [FilterRule(**rule)])[0].select(*_PLAIN_COLUMNS)

    return run


for _name, (_rule, _where) in _PLAIN.items():
    register(_name, f"SELECT {', '.join(_PLAIN_COLUMNS)} FROM lineitem WHERE {_where}")(_plain(_rule))

register("filter_no_rules", "SELECT * FROM supplier")(lambda spark, d: apply_filters(table(spark, d, "supplier"), [])[0])

# ---------------------------------------------------------------------------
# one value or key in a third of all rows

_HOT_SQL = "CASE WHEN l_orderkey % 3 = 0 THEN 7.0 ELSE l_extendedprice END"


def hot_lineitem(spark, sf_dir):
    price = F.when(F.col("l_orderkey") % 3 == 0, F.lit(7.0)).otherwise(F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", price.alias("price"))


register(
    "agg_median_hot_value",
    f"""SELECT l_returnflag, l_linestatus, round(quantile_cont({_HOT_SQL}, 0.5), 4) AS median_price
        FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY l_returnflag, l_linestatus""",
)(_agg_query(hot_lineitem, ["l_returnflag", "l_linestatus"],
             [{"column": "price", "function": "median", "alias": "median_price"}], {"median_price": 4}))

_HOT_KEY_SQL = "CASE WHEN o_orderkey % 3 = 0 THEN -1 WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_custkey END"


def _hot_keys(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k == 0, -1).when(k == 1, None).otherwise(F.col("o_custkey")).alias("cust"))


register(
    "validate_unique_hot_key",
    f"WITH src AS (SELECT o_orderkey, {_HOT_KEY_SQL} AS cust FROM orders), ranked AS (SELECT *, row_number() OVER "
    "(PARTITION BY cust ORDER BY o_orderkey) AS rn FROM src) "
    + _err_sql("ranked", "o_orderkey", "cust", "unique", "rn > 1", "CAST(cust AS VARCHAR)"),
)(lambda spark, d: validate(_hot_keys(spark, d), [{"column": "cust", "rule_type": "unique"}], order_by="o_orderkey").errors)

# ---------------------------------------------------------------------------
# dates without a format

_DATE_GUESSES = {
    "us_slash": ("M/d/yyyy", "%-m/%-d/%Y", "%m/%d/%Y"),
    "dots": ("d.M.yyyy", "%-d.%-m.%Y", "%d.%m.%Y"),
    "year_dots": ("yyyy.M.d", "%Y.%-m.%-d", "%Y.%m.%d"),
    "words": ("MMM d, yyyy", "%b %-d, %Y", "%b %d, %Y"),
}


def _guessed(target, pattern, source="orders", key="o_orderkey", ts="o_orderdate"):
    def run(spark, sf_dir):
        src = table(spark, sf_dir, source).select(key, F.date_format(ts, pattern).alias("t"))
        return _map(src, [{"column_name": "t", "target_dtype": target}], [key, "t"])

    return run


for _key, (_java, _out, _back) in _DATE_GUESSES.items():
    register(
        f"map_date_guess_{_key}",
        f"SELECT o_orderkey, CAST(strptime(strftime(o_orderdate, '{_out}'), '{_back}') AS DATE) AS t FROM orders",
    )(_guessed("date", _java))

_TIME_GUESSES = {
    "map_datetime_guess_space": ("datetime", "yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
    "map_datetime_guess_slash": ("datetime", "yyyy/M/d HH:mm", "%Y/%m/%d %H:%M"),
    "map_timestamp_iso": ("timestamp", "yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"),
}
for _name, (_target, _java, _strf) in _TIME_GUESSES.items():
    register(_name, f"SELECT event_id, strptime(strftime(ts, '{_strf}'), '{_strf}') AS t FROM events")(
        _guessed(_target, _java, "events", "event_id", "ts"))

# ---------------------------------------------------------------------------
# column errors as a table (M15-M17)


def _fraction_text(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_quantity").alias("whole"), F.col("l_tax").alias("part"),
        F.when(F.col("l_returnflag") == "R", None).otherwise(F.col("l_linenumber")).alias("line"))


@register(
    "map_column_errors",
    """SELECT 'part' AS column_name, count(*) || ' value(s) have a fraction or do not fit an integer' AS error
       FROM lineitem WHERE l_tax <> floor(l_tax)
       UNION ALL SELECT 'line', count(*) || ' NULL value(s) in a NOT NULL column without a default'
       FROM lineitem WHERE l_returnflag = 'R'
       UNION ALL SELECT 'absent', 'no such column in the input'""",
)
def map_column_errors(spark, sf_dir):
    found = apply_mappings(_fraction_text(spark, sf_dir), [
        ColumnMapping("whole", "integer"), ColumnMapping("part", "integer"),
        ColumnMapping("line", "bigint", is_nullable=False), ColumnMapping("absent", "text")], on_error="report")
    return spark.createDataFrame([(e["column"], e["error"]) for e in found.errors], "column_name string, error string")


# ---------------------------------------------------------------------------
# CSV folders whose files differ


def _mixed_folder(spark, sf_dir, first, second):
    """One folder with the documents of even ids written by ``first`` and those of odd ids by ``second``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    path = scratch_path(spark) + ".csv"
    even = F.col("doc_id") % 2 == 0
    for rows, (columns, encoding) in ((docs.filter(even), first), (docs.filter(~even), second)):
        (rows.select(*columns).write.mode("append").option("header", True).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .option("encoding", encoding).csv(path))
    return path


_COLUMNS = ("doc_id", "source", "text")
register("scan_csv_mixed_encodings", "SELECT doc_id, source, text FROM documents")(
    lambda spark, d: read_csv(spark, _mixed_folder(spark, d, (_COLUMNS, "UTF-8"), (_COLUMNS, "ISO-8859-1"))))
register("scan_csv_reordered_headers", "SELECT doc_id, source, text FROM documents")(
    lambda spark, d: read_csv(spark, _mixed_folder(spark, d, (_COLUMNS, "UTF-8"), (_COLUMNS[::-1], "UTF-8")))
    .select(*_COLUMNS))


@register("scan_csv_replacement_char", "SELECT doc_id, chr(65533) || ' ' || source || ' é' AS source FROM documents")
def scan_csv_replacement_char(spark, sf_dir):
    src = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("� "), F.col("source"), F.lit(" é")).alias("source"))
    return read_csv(spark, write_csv(src, scratch_path(spark) + ".csv"))


# ---------------------------------------------------------------------------
# keys, clustered tables, missing numbers


@register(
    "key_check_composite",
    """SELECT 'l_orderkey' AS column_name, 'null value(s) in a NOT NULL column' AS problem, count(*) - count(l_orderkey) AS rows
       FROM lineitem
       UNION ALL SELECT 'l_linenumber', 'null value(s) in a NOT NULL column', count(*) - count(l_linenumber) FROM lineitem
       UNION ALL SELECT 'l_orderkey, l_linenumber', 'duplicate value(s) in a PRIMARY KEY',
                        count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
                 FROM lineitem""",
)
def key_check_composite(spark, sf_dir):
    keys = [ColumnMapping(c, "bigint", is_primary_key=True) for c in ("l_orderkey", "l_linenumber")]
    return key_violations(table(spark, sf_dir, "lineitem"), keys)


@register(
    "clustered_join",
    """SELECT o_orderkey, o_orderpriority, count(*) AS n_lines, round(sum(l_quantity), 2) AS quantity
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderpriority""",
)
def clustered_join(spark, sf_dir):
    names = {}
    for source, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        path = scratch_path(spark)
        names[source] = "clustered_" + path.rsplit("-", 1)[1]
        write_clustered_table(table(spark, sf_dir, source), names[source], [key], buckets=8, path=path)
    joined = spark.table(names["orders"]).join(spark.table(names["lineitem"]), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderkey", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


register(
    "sink_nan_to_null",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN l_extendedprice END AS price FROM lineitem",
)(lambda spark, d: nan_to_null(table(spark, d, "lineitem").select(
    "l_orderkey", "l_linenumber",
    F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_extendedprice")).alias("price"))))

# ---------------------------------------------------------------------------
# profiling of flags, date texts and file names


def _like(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", " Yes").when(F.col("o_orderstatus") == "P", None).otherwise("no").alias("flag"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("day"),
        F.when(F.col("o_orderkey") >= 0, F.lit(C.INT32_MAX) + F.col("o_orderkey") + 1).alias("big"))


register(
    "profile_flags_and_days",
    f"""SELECT 'flag' AS column_name, CASE WHEN bool_and(lower(trim(v)) IN ('yes', 'no')) THEN 'boolean' ELSE 'string' END
               AS suggested_type, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS missing_count
        FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN ' Yes' ELSE 'no' END AS v FROM orders WHERE o_orderstatus <> 'P'
              ORDER BY o_orderkey LIMIT {P.SAMPLE_SIZE})
        UNION ALL SELECT 'day', CASE WHEN bool_and(try_strptime(v, '%m/%d/%Y') IS NOT NULL) THEN 'date' ELSE 'string' END, 0
        FROM (SELECT strftime(o_orderdate, '%m/%d/%Y') AS v FROM orders ORDER BY o_orderkey LIMIT {P.SAMPLE_SIZE})
        UNION ALL SELECT 'big', CASE WHEN max({C.INT32_MAX} + o_orderkey + 1) <= {C.INT32_MAX} THEN 'integer' ELSE 'bigint' END, 0
        FROM orders""",
)(lambda spark, d: P.column_profile(_like(spark, d), order_by="o_orderkey").filter("column_name <> 'o_orderkey'").select(
    "column_name", "suggested_type", "missing_count"))

register(
    "profile_table_names",
    """SELECT c_custkey, lower(replace(replace(c_mktsegment || ' ' || c_nationkey || '-x', ' ', '_'), '-', '_')) AS table_name
       FROM customer""",
)(lambda spark, d: table(spark, d, "customer").select("c_custkey", P.table_name_column(F.concat(
    F.lit("in/20240101_name"), F.col("c_mktsegment"), F.lit(" "), F.col("c_nationkey"), F.lit("-x.csv"))).alias("table_name")))

register(
    "profile_preview_json",
    """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS row
       FROM nation ORDER BY n_nationkey LIMIT 5""",
)(lambda spark, d: P.preview_json(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey"))

# ---------------------------------------------------------------------------
# files, logs and ledger derived from the tables


@register("list_written_files", "SELECT '.csv' AS extension, CAST(3 AS BIGINT) AS files, true AS filled, count(*) AS rows FROM lineitem")
def list_written_files(spark, sf_dir):
    path = scratch_path(spark)
    lineitem = table(spark, sf_dir, "lineitem")
    share = F.pmod(F.xxhash64(*lineitem.columns), F.lit(3))
    for k in range(3):  # three CSV outputs, each in as many parts as the table has splits: no task holds a third of it
        lineitem.filter(share == k).write.option("header", True).csv(f"{path}/lineitem-{k}.csv")
    listed = list_files(spark, path, outputs=True)
    # the listed paths must lead to the rows: each part's lines below its header
    parts = spark.read.option("recursiveFileLookup", "true").text(path).groupBy(F.col("_metadata.file_path").alias("part")).agg(
        (F.count(F.lit(1)) - 1).alias("rows"))
    lines = parts.groupBy(output_of(F.col("part")).alias("file")).agg(F.sum("rows").alias("rows"))
    return listed.join(lines, F.col("path") == F.col("file")).groupBy("extension").agg(
        F.count(F.lit(1)).alias("files"), F.bool_and(F.col("size_bytes") > 0).alias("filled"), F.sum("rows").alias("rows"))


@register(
    "log_scan_summary",
    """SELECT 'user-' || user_id AS job_id, count(*) AS total_events,
              count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'signup') AS warnings
       FROM events GROUP BY user_id""",
)
def log_scan_summary(spark, sf_dir):
    path = scratch_path(spark)
    event_log_lines(spark, sf_dir).write.text(path)
    return ledger.log_summary(ledger.read_logs(spark, path))


def event_log_lines(spark, sf_dir):
    """The events as lines of job logs, each with a malformed copy."""
    kind = F.col("event_type")
    level = F.when(kind == "error", "ERROR").when(kind == "signup", "WARNING").otherwise("INFO")
    lines = table(spark, sf_dir, "events").select(
        F.to_json(F.struct(F.col("ts").cast("string").alias("timestamp"), level.alias("level"),
                           F.concat(F.lit("user-"), F.col("user_id")).alias("job_id"), kind.alias("message"))).alias("value"))
    return lines.unionByName(lines.select(F.lit("{ not a line").alias("value")))


_LEDGER_NOW = "2024-01-10 00:00:00"


def _event_ledger(spark, sf_dir):
    path = scratch_path(spark)
    table(spark, sf_dir, "events").select(
        F.concat(F.lit("job-"), F.col("user_id")).alias("job_id"), F.sha2(F.col("user_id").cast("string"), 256).alias("request_hash"),
        F.col("event_type").alias("state"), F.col("ts").cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("result"),
        F.to_date("ts").alias(ledger.DAY)).write.partitionBy(ledger.DAY).parquet(path)
    return path


def _now():
    import datetime

    return datetime.datetime.fromisoformat(_LEDGER_NOW)


register(
    "ledger_latest_states",
    f"""SELECT 'job-' || user_id AS job_id, sha256(CAST(user_id AS VARCHAR)) AS request_hash, arg_max(event_type, ts) AS state
        FROM events WHERE ts >= TIMESTAMP '{_LEDGER_NOW}' - INTERVAL 240 HOUR GROUP BY user_id""",
)(lambda spark, d: ledger.latest_states(spark, _event_ledger(spark, d), ttl_hours=240, now=_now()).select(
    "job_id", "request_hash", "state"))

register(
    "ledger_pending",
    f"""SELECT c_custkey, sha256(CAST(c_custkey AS VARCHAR)) AS request_hash FROM customer WHERE c_custkey NOT IN
        (SELECT user_id FROM events WHERE ts >= TIMESTAMP '{_LEDGER_NOW}' - INTERVAL 240 HOUR AND user_id IS NOT NULL)""",
)(lambda spark, d: ledger.pending_requests(
    table(spark, d, "customer").select("c_custkey", F.sha2(F.col("c_custkey").cast("string"), 256).alias("request_hash")),
    spark, _event_ledger(spark, d), ttl_hours=240, now=_now()).select("c_custkey", "request_hash"))

# ---------------------------------------------------------------------------
# whole jobs


@register(
    "job_result_counts",
    """WITH m AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn
                  FROM orders WHERE o_totalprice > 50000)
       SELECT (SELECT count(*) FROM orders) AS extracted, (SELECT count(*) FROM m) AS filtered,
              (SELECT count(*) FROM m WHERE rn = 1) AS processed, (SELECT count(*) FROM m WHERE rn > 1) AS failed""",
)
def job_result_counts(spark, sf_dir):
    from .jobs import run_job

    src, out = scratch_path(spark) + ".parquet", scratch_path(spark)
    table(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "M/d/yyyy")).write.parquet(src)
    result = run_job(spark, JobSpec(
        file_source={"path": src}, filters=[{"column": "o_totalprice", "operator": "gt", "value": 50000}],
        column_mappings=[ColumnMapping("day", "date"), ColumnMapping("o_custkey", "integer")],
        validation_rules=[{"column": "o_custkey", "rule_type": "unique"}], order_by="o_orderkey",
        file_destination=FileDestination("parquet", out)))
    if not result["success"]:
        raise RuntimeError(result["message"])
    stages = result["stage_rows"]
    row = (stages["extracted"], stages["filtered"], result["processed_rows"], result["failed_rows"])
    return spark.createDataFrame([row], "extracted bigint, filtered bigint, processed bigint, failed bigint")
