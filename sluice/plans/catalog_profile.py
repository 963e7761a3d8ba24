"""Profiling queries (P1-P15) with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions.dates import PROFILE_PATTERNS
from ..operators import profile as P
from ..operators.aggregate import aggregate
from .catalog import CUSTOMER_N, customer_n, register, table

# Java guess patterns in strftime form for the oracle (same order).
_GUESS_STRF = {
    "yyyy-M-d": "%Y-%m-%d",
    "yyyy-M-d H:m:s": "%Y-%m-%d %H:%M:%S",
    "yyyy-M-d'T'H:m:s": "%Y-%m-%dT%H:%M:%S",
    "yyyy-M-d H:m:s.SSSSSS": "%Y-%m-%d %H:%M:%S.%f",
    "yyyy-M-d'T'H:m:s.SSSSSS": "%Y-%m-%dT%H:%M:%S.%f",
    "yyyy-M-d'T'H:m:s'Z'": "%Y-%m-%dT%H:%M:%SZ",
    "M/d/yyyy": "%m/%d/%Y",
    "yyyy/M/d": "%Y/%m/%d",
    "d.M.yyyy": "%d.%m.%Y",
    "MMM d, yyyy": "%b %d, %Y",
    "MMMM d, yyyy": "%B %d, %Y",
    "d MMM yyyy": "%d %b %Y",
    "yyyyMMdd": "%Y%m%d",
}
_ALL_DATE_FORMATS = list(C.SUGGEST_DATE_FORMATS) + [_GUESS_STRF[p] for p in PROFILE_PATTERNS]


def _profile_sql(src: str, key: str, cols) -> str:
    """Oracle for column_profile over ``src`` with (name, spark dtype, kind)."""
    parts = []
    bools = ", ".join(f"'{t}'" for t in C.BOOLEAN_LIKE_TOKENS)
    for name, dtype, kind in cols:
        if kind == "string":
            sample = f"(SELECT {name} AS v FROM {src} WHERE {name} IS NOT NULL ORDER BY {key} LIMIT {P.SAMPLE_SIZE})"
            date_like = " OR ".join(
                f"coalesce((SELECT bool_and(try_strptime(v, '{f}') IS NOT NULL) FROM {sample}), false)"
                for f in _ALL_DATE_FORMATS
            )
            suggest = f"""CASE WHEN count({name}) = 0 THEN 'string'
                WHEN (SELECT bool_and(lower(trim(v)) IN ({bools})) FROM {sample}) THEN 'boolean'
                WHEN {date_like} THEN 'date'
                WHEN max(length({name})) > {C.TEXT_LENGTH_LIMIT} THEN 'text' ELSE 'string' END"""
            numeric, dt = "false", "false"
        elif kind == "int":
            suggest = (f"CASE WHEN count({name}) = 0 THEN 'string' WHEN max({name}) <= {C.INT32_MAX} "
                       f"THEN 'integer' ELSE 'bigint' END")
            numeric, dt = "true", "false"
        elif kind == "double":
            suggest = f"CASE WHEN count({name}) = 0 THEN 'string' ELSE 'float' END"
            numeric, dt = "true", "false"
        else:  # timestamp
            suggest = f"CASE WHEN count({name}) = 0 THEN 'string' ELSE 'datetime' END"
            numeric, dt = "false", "true"
        parts.append(
            f"SELECT '{name}' AS column_name, '{dtype}' AS dtype, count(*) - count({name}) AS missing_count, "
            f"count(DISTINCT {name}) AS unique_count, {suggest} AS suggested_type, "
            f"{numeric} AS is_numeric, {dt} AS is_datetime FROM {src}"
        )
    return " UNION ALL ".join(parts)


_CUSTOMER_COLS = [
    ("c_custkey", "bigint", "int"),
    ("c_name", "string", "string"),
    ("c_nationkey", "int", "int"),
    ("c_acctbal", "double", "double"),
    ("c_mktsegment", "string", "string"),
]
_DOCUMENT_COLS = [
    ("doc_id", "bigint", "int"),
    ("text", "string", "string"),
    ("lang", "string", "string"),
    ("source", "string", "string"),
    ("n_chars", "bigint", "int"),
]
_EVENT_COLS = [
    ("event_id", "bigint", "int"),
    ("ts", "timestamp_ntz", "timestamp"),
    ("user_id", "bigint", "int"),
    ("event_type", "string", "string"),
    ("value", "double", "double"),
    ("props", "string", "string"),
]

register("profile_columns", f"WITH {CUSTOMER_N} " + _profile_sql("customer_n", "c_custkey", _CUSTOMER_COLS))(
    lambda spark, d: P.column_profile(customer_n(spark, d), order_by="c_custkey")
)
register("profile_columns_documents", _profile_sql("documents", "doc_id", _DOCUMENT_COLS))(
    lambda spark, d: P.column_profile(table(spark, d, "documents"), order_by="doc_id")
)
register("profile_columns_events", _profile_sql("events", "event_id", _EVENT_COLS))(
    lambda spark, d: P.column_profile(table(spark, d, "events"), order_by="event_id")
)


def _samples_sql(src, key, cols, k=5):
    parts = [
        f"SELECT column_name, rank, value FROM (SELECT '{n}' AS column_name, "
        f"CAST(row_number() OVER (ORDER BY {key}) AS INTEGER) AS rank, CAST({n} AS VARCHAR) AS value "
        f"FROM {src} WHERE {n} IS NOT NULL) WHERE rank <= {k}"
        for n, _, _ in cols
    ]
    return " UNION ALL ".join(parts)


register("profile_samples", f"WITH {CUSTOMER_N} " + _samples_sql("customer_n", "c_custkey", _CUSTOMER_COLS))(
    lambda spark, d: P.first_values(
        customer_n(spark, d), [c for c, _, _ in _CUSTOMER_COLS], 5, order_by="c_custkey"
    ).withColumn("rank", F.col("rank").cast("int"))
)

register(
    "profile_summary",
    f"""WITH {CUSTOMER_N}, m AS (
      SELECT count(*) AS row_count,
             (count(*) - count(c_custkey)) + (count(*) - count(c_name)) + (count(*) - count(c_nationkey))
             + (count(*) - count(c_acctbal)) + (count(*) - count(c_mktsegment)) AS total_missing
      FROM customer_n)
    SELECT row_count, 5 AS column_count, total_missing > 0 AS has_missing, total_missing FROM m""",
)(lambda spark, d: P.table_summary(customer_n(spark, d)))

register(
    "profile_numeric",
    """SELECT 'l_extendedprice' AS column_name, 'double' AS dtype, count(*) AS count,
              count(*) - count(l_extendedprice) AS missing_count, count(DISTINCT l_extendedprice) AS unique_count,
              min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(avg(l_extendedprice), 4) AS mean,
              round(stddev_samp(l_extendedprice), 4) AS std, round(quantile_cont(l_extendedprice, 0.5), 4) AS median
       FROM lineitem""",
)(
    lambda spark, d: P.column_stats(table(spark, d, "lineitem"), "l_extendedprice").select(
        "column_name", "dtype", "count", "missing_count", "unique_count", "min", "max",
        F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), F.round("median", 4).alias("median"),
    )
)

register(
    "profile_text",
    """SELECT 'text' AS column_name, 'string' AS dtype, count(*) AS count, count(*) - count(text) AS missing_count,
              count(DISTINCT text) AS unique_count, coalesce(max(length(text)), 0) AS max_length,
              coalesce(min(length(text)), 0) AS min_length, round(coalesce(avg(length(text)), 0), 4) AS avg_length
       FROM documents""",
)(
    lambda spark, d: P.column_stats(table(spark, d, "documents"), "text").select(
        "column_name", "dtype", "count", "missing_count", "unique_count", "max_length", "min_length",
        F.round("avg_length", 4).alias("avg_length"),
    )
)

register(
    "profile_top",
    """SELECT CAST(c_nationkey AS VARCHAR) AS value, count(*) AS count FROM customer
       WHERE c_nationkey IS NOT NULL GROUP BY 1 ORDER BY count DESC, value ASC LIMIT 10""",
)(lambda spark, d: P.top_values(table(spark, d, "customer"), "c_nationkey", 10))

register("profile_preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")(
    lambda spark, d: P.preview(table(spark, d, "orders"), "o_orderkey", 5)
)


def _pick(sql: str, cols: str) -> str:
    return f"SELECT {cols} FROM ({sql}) AS p"


register(
    "profile_missing",
    f"WITH {CUSTOMER_N} " + _pick(_profile_sql("customer_n", "c_custkey", _CUSTOMER_COLS), "column_name, missing_count"),
)(lambda spark, d: P.column_profile(customer_n(spark, d), order_by="c_custkey").select("column_name", "missing_count"))

_CONVERSATION_COLS = [
    ("conv_id", "bigint", "int"),
    ("turn", "bigint", "int"),
    ("role", "string", "string"),
    ("text", "string", "string"),
]
_ORDER_COLS = [
    ("o_orderkey", "bigint", "int"),
    ("o_custkey", "bigint", "int"),
    ("o_orderstatus", "string", "string"),
    ("o_totalprice", "double", "double"),
    ("o_orderdate", "timestamp_ntz", "timestamp"),
    ("o_orderpriority", "string", "string"),
]

register(
    "profile_suggest",
    " UNION ALL ".join(
        [
            _pick(_profile_sql("conversations", "conv_id, turn", _CONVERSATION_COLS), "'conversations' AS table_name, column_name, suggested_type"),
            _pick(_profile_sql("orders", "o_orderkey", _ORDER_COLS), "'orders' AS table_name, column_name, suggested_type"),
        ]
    ),
)(
    lambda spark, d: P.column_profile(
        table(spark, d, "conversations").withColumn("_order", F.struct("conv_id", "turn")), order_by="_order"
    )
    .filter(F.col("column_name") != "_order")
    .select(F.lit("conversations").alias("table_name"), "column_name", "suggested_type")
    .unionByName(
        P.column_profile(table(spark, d, "orders"), order_by="o_orderkey").select(
            F.lit("orders").alias("table_name"), "column_name", "suggested_type"
        )
    )
)

# more different words than a task's summary holds: candidates by summaries, then exact counts
register(
    "profile_top_words",
    """SELECT value, count(*) AS count FROM (SELECT unnest(string_split(text, ' ')) AS value FROM documents)
       GROUP BY value ORDER BY count DESC, value LIMIT 10""",
)(lambda spark, d: P.top_values(table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("word")), "word", 10))
register(
    "agg_many_distinct",
    """SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers,
              count(DISTINCT l_shipdate) AS days, sum(l_quantity) AS quantity
       FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag""",
)(lambda spark, d: aggregate(table(spark, d, "lineitem"), {"group_by": ["l_returnflag"], "aggregations": [
    {"column": "l_partkey", "function": "count_distinct", "alias": "parts"},
    {"column": "l_suppkey", "function": "nunique", "alias": "suppliers"},
    {"column": "l_shipdate", "function": "count_distinct", "alias": "days"},
    {"column": "l_quantity", "function": "sum", "alias": "quantity"}]}))
