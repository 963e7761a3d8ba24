"""File source and sink queries: Spark writes a frame derived from the
given tables into a scratch folder under the shared checkpoint folder, and
the library's own scanners read it back.  The oracle is the same frame in
SQL with the types the scanner infers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.validation import quarantine_rows, validate
from ..session import checkpoint_dir
from ..sinks.files import write_file, write_quarantine
from ..sources.files import read_csv, read_parquet
from ..specs import FileDestination
from .catalog import CUSTOMER_N, ORDERS_N, _MULTI_BAD, _MULTI_RULES, customer_n, orders_n, register, table


def scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/sluice-scratch-{uuid.uuid4().hex}/{name}"


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> str:
    (
        df.write.mode("error")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("encoding", encoding)
        .csv(path)
    )
    return path


@register(
    "scan_csv_infer",
    f"""WITH {CUSTOMER_N}
    SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer_n""",
)
def scan_csv_infer(spark, sf_dir):
    path = write_csv(customer_n(spark, sf_dir), scratch(spark, "customer.csv"))
    return read_csv(spark, path)


_TOKENS_SQL = """CASE o_orderpriority WHEN '1-URGENT' THEN 'NA' WHEN '2-HIGH' THEN 'null'
                 WHEN '3-MEDIUM' THEN 'N/A' WHEN '4-NOT SPECIFIED' THEN '#N/A' ELSE o_orderpriority END"""


@register(
    "scan_csv_null_tokens",
    f"""WITH {ORDERS_N}
    SELECT o_orderkey,
           CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') THEN NULL
                ELSE o_orderpriority END AS prio,
           o_orderstatus = 'F' AS finished,
           CAST(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS DOUBLE) AS cust
    FROM orders_n""",
)
def scan_csv_null_tokens(spark, sf_dir):
    o = orders_n(spark, sf_dir)
    p = F.col("o_orderpriority")
    prio = (
        F.when(p == "1-URGENT", "NA").when(p == "2-HIGH", "null").when(p == "3-MEDIUM", "N/A")
        .when(p == "4-NOT SPECIFIED", "#N/A").otherwise(p)
    )
    src = o.select(
        "o_orderkey",
        prio.alias("prio"),
        F.when(F.col("o_orderstatus") == "F", "True").otherwise("False").alias("finished"),
        F.when(F.col("o_orderstatus") == "P", None).otherwise(F.col("o_custkey")).alias("cust"),
    )
    return read_csv(spark, write_csv(src, scratch(spark, "tokens.csv")))


@register("scan_csv_quoted_newlines", "SELECT doc_id, lang, text FROM documents")
def scan_csv_quoted_newlines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return read_csv(spark, write_csv(d, scratch(spark, "documents.csv")))


@register("scan_csv_latin1_fallback", "SELECT doc_id, source, text FROM documents")
def scan_csv_latin1_fallback(spark, sf_dir):
    # every character of the documents fits ISO-8859-1; the file carries no
    # encoding mark, so the scanner must notice the bad UTF-8 and re-read it
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return read_csv(spark, write_csv(d, scratch(spark, "documents-latin1.csv"), encoding="ISO-8859-1"))


@register("sink_parquet_roundtrip", f"WITH {ORDERS_N} SELECT * FROM orders_n")
def sink_parquet_roundtrip(spark, sf_dir):
    rep = write_file(orders_n(spark, sf_dir), FileDestination("parquet", scratch(spark, "orders.parquet")))
    return read_parquet(spark, rep["output_path"])


@register("sink_csv_roundtrip", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem")
def sink_csv_roundtrip(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"
    )
    rep = write_file(li, FileDestination("csv", scratch(spark, "lineitem.csv")))
    out = read_csv(spark, rep["output_path"])
    # integral quantities come back as integers, as a CSV reader infers them
    return out.select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"),
                      F.col("l_quantity").cast("double").alias("l_quantity"), "l_extendedprice", "l_returnflag")


@register(
    "sink_quarantine_file",
    f"""WITH {CUSTOMER_N}
    SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment,
           concat_ws('; ',
             CASE WHEN {_MULTI_BAD['not_null']} THEN 'c_acctbal: Failed rule ''not_null'' on column ''c_acctbal''' END,
             CASE WHEN {_MULTI_BAD['min_value']} THEN 'c_acctbal: Failed rule ''min_value'' on column ''c_acctbal''' END,
             CASE WHEN {_MULTI_BAD['allowed_values']}
                  THEN 'c_mktsegment: Failed rule ''allowed_values'' on column ''c_mktsegment''' END,
             CASE WHEN {_MULTI_BAD['regex']} THEN 'c_name: Failed rule ''regex'' on column ''c_name''' END
           ) AS _validation_errors
    FROM customer_n WHERE {' OR '.join(_MULTI_BAD.values())}""",
)
def sink_quarantine_file(spark, sf_dir):
    bad = quarantine_rows(validate(customer_n(spark, sf_dir), _MULTI_RULES, order_by="c_custkey"))
    rep = write_quarantine(bad, scratch(spark, "quarantine"))
    return read_csv(spark, rep["output_path"])


# ---------------------------------------------------------------------------
# whole jobs (J1) and the streaming folder job over files derived from orders

_JOB_SQL = f"""WITH {ORDERS_N},
f AS (SELECT * FROM orders_n WHERE coalesce(o_totalprice > 100000, false)),
m AS (SELECT o_orderkey, round_even(o_totalprice * 100, 0) / 100 AS amount, o_orderpriority FROM f)
SELECT o_orderkey, amount, o_orderpriority FROM m WHERE NOT coalesce(amount > 400000, false)"""

_JOB_MAPPINGS = [
    {"column_name": "o_orderkey", "target_dtype": "bigint"},
    {"column_name": "o_totalprice", "target_dtype": "decimal", "rename_to": "amount"},
    {"column_name": "o_orderpriority", "target_dtype": "string"},
]
_JOB_FILTERS = [{"column": "o_totalprice", "operator": "gt", "value": 100000}]
_JOB_RULES = [{"column": "amount", "rule_type": "max_value", "params": {"max": 400000}}]


def _orders_csv(spark, sf_dir, name, records_per_file=None):
    src = orders_n(spark, sf_dir).select("o_orderkey", "o_totalprice", "o_orderpriority")
    w = src.write.mode("error").option("header", True).option("escape", '"')
    if records_per_file:
        w = w.option("maxRecordsPerFile", records_per_file)
    path = scratch(spark, name)
    w.csv(path)
    return path


@register("job_file_run", _JOB_SQL)
def job_file_run(spark, sf_dir):
    from ..specs import JobSpec
    from .jobs import run_job

    src = _orders_csv(spark, sf_dir, "orders-in.csv")
    out = scratch(spark, "orders-out")
    spec = JobSpec(
        file_source={"path": src},
        filters=_JOB_FILTERS,
        column_mappings=_JOB_MAPPINGS,
        validation_rules=_JOB_RULES,
        order_by="o_orderkey",
        file_destination={"format": "parquet", "output_path": out},
        quarantine_path=scratch(spark, "orders-rejected"),
    )
    result = run_job(spark, spec)
    if not result["success"]:
        raise RuntimeError(result["message"])
    return read_parquet(spark, out).select("o_orderkey", "amount", "o_orderpriority")


@register("stream_folder_run", _JOB_SQL)
def stream_folder_run(spark, sf_dir):
    from ..specs import JobSpec
    from ..streaming.folder import read_outputs, watch_folder

    # a fixed number of files, all in one job; the stages are row-local,
    # so the output equals the whole-table result
    src = orders_n(spark, sf_dir).select("o_orderkey", "o_totalprice", "o_orderpriority")
    inbox = write_csv(src.repartition(8), scratch(spark, "orders-inbox.csv"))
    out = scratch(spark, "orders-stream-out")
    spec = JobSpec(
        table_source="inbox",
        filters=_JOB_FILTERS,
        column_mappings=_JOB_MAPPINGS,
        validation_rules=_JOB_RULES,
        order_by="o_orderkey",
        file_destination={"format": "parquet", "output_path": out},
    )
    query = watch_folder(spark, inbox, ["o_orderkey", "o_totalprice", "o_orderpriority"], spec, out,
                         scratch(spark, "orders-stream-ckpt"), files_per_trigger=8)
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return read_outputs(spark, out).select("o_orderkey", "amount", "o_orderpriority")


@register("sink_write_report", "SELECT count(*) AS rows_written, count(*) > 0 AS has_bytes FROM lineitem")
def sink_write_report(spark, sf_dir):
    # the whole table is written; the row count comes from the write itself
    rep = write_file(table(spark, sf_dir, "lineitem"), FileDestination("parquet", scratch(spark, "lineitem-out")))
    return spark.createDataFrame(
        [(rep["rows_written"], rep["file_size_bytes"] > 0)], "rows_written bigint, has_bytes boolean"
    )
