"""Registered queries over the given tables, each with a DuckDB oracle.

Every query reads whole tables (or frames Spark derives from them) and runs
one operator family of the library; the oracle states the same semantics in
plain SQL.  Derived null columns come from value-based CASE expressions on
the same rows, never from row subsets.  Floating aggregates are rounded on
both sides because addition order differs between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregate import aggregate
from ..operators.filters import apply_filters
from ..operators.mapping import apply_mappings, auto_mappings, merge_mappings
from ..operators.validation import quarantine_rows, validate
from ..specs import ColumnMapping, FilterRule, ValidationRule
from .stages import run_stages

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql.strip()
        return fn

    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_SQL)


def _load_all():
    from . import catalog_api, catalog_files, catalog_loads, catalog_more, catalog_profile, catalog_sources  # noqa: F401  (registration side effects)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------------------
# derived frames (same definitions on both sides)

def orders_n(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        F.when(F.col("o_orderstatus") == "P", None).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        F.when(F.col("o_orderstatus") == "O", None).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
    )


ORDERS_N = """orders_n AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS o_totalprice,
         o_orderdate,
         CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders)"""


def customer_n(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        "c_custkey",
        "c_name",
        "c_nationkey",
        F.when(F.col("c_mktsegment") == "MACHINERY", None).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        "c_mktsegment",
    )


CUSTOMER_N = """customer_n AS (
  SELECT c_custkey, c_name, c_nationkey,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_acctbal END AS c_acctbal,
         c_mktsegment
  FROM customer)"""


# ---------------------------------------------------------------------------
# filters (F1-F15)

def _filter_query(rules, complement=False):
    def run(spark, sf_dir):
        kept, dropped = apply_filters(orders_n(spark, sf_dir), [FilterRule(**r) for r in rules])
        return dropped if complement else kept

    return run


_FILTERS = {
    "filter_eq": ([{"column": "o_orderpriority", "operator": "eq", "value": "1-URGENT"}],
                  "o_orderpriority IS NOT DISTINCT FROM '1-URGENT'"),
    "filter_neq": ([{"column": "o_orderpriority", "operator": "neq", "value": "1-URGENT"}],
                   "o_orderpriority IS DISTINCT FROM '1-URGENT'"),
    "filter_gt": ([{"column": "o_totalprice", "operator": "gt", "value": 200000}],
                  "coalesce(o_totalprice > 200000, false)"),
    "filter_lt": ([{"column": "o_totalprice", "operator": "lt", "value": 50000}],
                  "coalesce(o_totalprice < 50000, false)"),
    "filter_gte": ([{"column": "o_totalprice", "operator": "gte", "value": 250000.5}],
                   "coalesce(o_totalprice >= 250000.5, false)"),
    "filter_lte": ([{"column": "o_totalprice", "operator": "lte", "value": 100000}],
                   "coalesce(o_totalprice <= 100000, false)"),
    "filter_contains": ([{"column": "o_orderpriority", "operator": "contains", "value": "URG|HIGH"}],
                        "coalesce(regexp_matches(o_orderpriority, 'URG|HIGH'), false)"),
    "filter_not_contains": ([{"column": "o_orderpriority", "operator": "not_contains", "value": "LOW$"}],
                            "NOT coalesce(regexp_matches(o_orderpriority, 'LOW$'), false)"),
    "filter_is_null": ([{"column": "o_totalprice", "operator": "is_null"}], "o_totalprice IS NULL"),
    "filter_is_not_null": ([{"column": "o_orderpriority", "operator": "is_not_null"}],
                           "o_orderpriority IS NOT NULL"),
    "filter_in": ([{"column": "o_orderpriority", "operator": "in", "values": ["1-URGENT", "2-HIGH", 5]}],
                  "coalesce(o_orderpriority IN ('1-URGENT', '2-HIGH'), false)"),
    "filter_not_in": ([{"column": "o_orderpriority", "operator": "not_in", "values": ["5-LOW", "3-MEDIUM"]}],
                      "NOT coalesce(o_orderpriority IN ('5-LOW', '3-MEDIUM'), false)"),
    "filter_neq_type_mismatch": ([{"column": "o_custkey", "operator": "neq", "value": "7"}], "true"),
    "filter_timestamp_gte": ([{"column": "o_orderdate", "operator": "gte", "value": "1997-01-01"}],
                             "coalesce(o_orderdate >= TIMESTAMP '1997-01-01', false)"),
    "filter_multi": (
        [
            {"column": "o_orderstatus", "operator": "eq", "value": "F"},
            {"column": "o_totalprice", "operator": "gte", "value": 100000},
            {"column": "o_orderpriority", "operator": "not_in", "values": ["5-LOW"]},
        ],
        "o_orderstatus IS NOT DISTINCT FROM 'F' AND coalesce(o_totalprice >= 100000, false)"
        " AND NOT coalesce(o_orderpriority IN ('5-LOW'), false)",
    ),
    "filter_unknown_column": ([{"column": "no_such_column", "operator": "eq", "value": 1}], "true"),
}

for _name, (_rules, _where) in _FILTERS.items():
    register(_name, f"WITH {ORDERS_N} SELECT * FROM orders_n WHERE {_where}")(_filter_query(_rules))

register(
    "filter_complement",
    f"""WITH {ORDERS_N} SELECT * FROM orders_n WHERE NOT (
      o_orderstatus IS NOT DISTINCT FROM 'F' AND coalesce(o_totalprice >= 100000, false)
      AND NOT coalesce(o_orderpriority IN ('5-LOW'), false))""",
)(_filter_query(_FILTERS["filter_multi"][0], complement=True))


# ---------------------------------------------------------------------------
# mapping (M1-M20)

def _map(df: DataFrame, mappings, keep) -> DataFrame:
    out = apply_mappings(df, [ColumnMapping(**m) for m in mappings]).df
    return out.select(*keep)


@register(
    "map_integer",
    """WITH src AS (
      SELECT l_orderkey, l_linenumber,
             CASE WHEN l_returnflag = 'R' THEN 'n/a'
                  ELSE '$' || CAST(l_orderkey AS VARCHAR) || ',' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0')
             END AS amount_text
      FROM lineitem)
    SELECT l_orderkey, l_linenumber,
           TRY_CAST(trim(replace(replace(amount_text, ',', ''), '$', '')) AS BIGINT) AS amount_int
    FROM src""",
)
def map_integer(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    src = li.select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_returnflag") == "R", F.lit("n/a"))
        .otherwise(
            F.concat(
                F.lit("$"),
                F.col("l_orderkey").cast("string"),
                F.lit(","),
                F.lpad(F.col("l_linenumber").cast("string"), 3, "0"),
            )
        )
        .alias("amount_text"),
    )
    return _map(src, [{"column_name": "amount_text", "target_dtype": "integer", "rename_to": "amount_int"}],
                ["l_orderkey", "l_linenumber", "amount_int"])


@register(
    "map_float",
    """WITH src AS (
      SELECT l_orderkey, l_linenumber,
             CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN CAST(l_linenumber AS VARCHAR) || 'd'
                  WHEN l_returnflag = 'A' THEN CAST(l_linenumber AS VARCHAR) || 'e2'
                  ELSE ' $' || CAST(l_orderkey AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR)
             END AS t
      FROM lineitem)
    SELECT l_orderkey, l_linenumber,
           TRY_CAST(trim(replace(replace(t, ',', ''), '$', '')) AS DOUBLE) AS price
    FROM src""",
)
def map_float(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    t = (
        F.when(
            (F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N"),
            F.concat(F.col("l_linenumber").cast("string"), F.lit("d")),
        )
        .when(F.col("l_returnflag") == "A", F.concat(F.col("l_linenumber").cast("string"), F.lit("e2")))
        .otherwise(
            F.concat(F.lit(" $"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
        )
    )
    src = li.select("l_orderkey", "l_linenumber", t.alias("t"))
    return _map(src, [{"column_name": "t", "target_dtype": "float", "rename_to": "price"}],
                ["l_orderkey", "l_linenumber", "price"])


@register(
    "map_decimal",
    """SELECT l_orderkey, l_linenumber,
              round_even(l_extendedprice * l_discount * 100, 0) / 100 AS disc_amount
       FROM lineitem""",
)
def map_decimal(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    src = li.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * F.col("l_discount")).alias("disc_amount"))
    return _map(src, [{"column_name": "disc_amount", "target_dtype": "decimal"}],
                ["l_orderkey", "l_linenumber", "disc_amount"])


_BOOL_TEXT_SQL = """CASE event_type WHEN 'click' THEN ' Yes' WHEN 'view' THEN 'n' WHEN 'error' THEN '1'
                    WHEN 'purchase' THEN 'FALSE' ELSE 'maybe' END"""


@register(
    "map_boolean",
    f"""WITH src AS (SELECT event_id, {_BOOL_TEXT_SQL} AS flag FROM events)
    SELECT event_id,
           CASE WHEN lower(trim(flag)) IN ('true', 't', 'yes', 'y', '1') THEN true
                WHEN lower(trim(flag)) IN ('false', 'f', 'no', 'n', '0') THEN false END AS flag
    FROM src""",
)
def map_boolean(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    et = F.col("event_type")
    flag = (
        F.when(et == "click", " Yes").when(et == "view", "n").when(et == "error", "1")
        .when(et == "purchase", "FALSE").otherwise("maybe")
    )
    src = ev.select("event_id", flag.alias("flag"))
    return _map(src, [{"column_name": "flag", "target_dtype": "boolean"}], ["event_id", "flag"])


@register("map_string_truncate", "SELECT doc_id, substr(text, 1, 40) AS snippet FROM documents")
def map_string_truncate(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return _map(d, [{"column_name": "text", "target_dtype": "string", "max_length": 40, "rename_to": "snippet"}],
                ["doc_id", "snippet"])


@register("map_json", "SELECT event_id, props AS payload FROM events")
def map_json(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return _map(ev, [{"column_name": "props", "target_dtype": "json", "rename_to": "payload"}],
                ["event_id", "payload"])


# name -> (named format, Spark output pattern, strftime pattern)
_DATE_CASES = {
    "yyyy_mm_dd": ("YYYY-MM-DD", "yyyy-MM-dd", "%Y-%m-%d"),
    "yy_mm_dd": ("YY-MM-DD", "yy-MM-dd", "%y-%m-%d"),
    "dd_mm_yyyy": ("DD-MM-YYYY", "dd-MM-yyyy", "%d-%m-%Y"),
    "dd_mm_yy": ("DD-MM-YY", "dd-MM-yy", "%d-%m-%y"),
    "yyyy_mm_dd_slash": ("YYYY/MM/DD", "yyyy/M/d", "%Y/%-m/%-d"),
    "yy_mm_dd_slash": ("YY/MM/DD", "yy/M/d", "%y/%-m/%-d"),
    "dd_mm_yyyy_slash": ("DD/MM/YYYY", "d/M/yyyy", "%-d/%-m/%Y"),
    "dd_mm_yy_slash": ("DD/MM/YY", "d/M/yy", "%-d/%-m/%y"),
    "mmm_dd_yyyy": ("MMM DD, YYYY", "MMM d, yyyy", "%b %-d, %Y"),
    "mmmm_dd_yyyy": ("MMMM DD, YYYY", "MMMM dd, yyyy", "%B %d, %Y"),
}

_PARSE_SQL = {
    "YYYY-MM-DD": "%Y-%m-%d",
    "YY-MM-DD": "%y-%m-%d",
    "DD-MM-YYYY": "%d-%m-%Y",
    "DD-MM-YY": "%d-%m-%y",
    "YYYY/MM/DD": "%Y/%m/%d",
    "YY/MM/DD": "%y/%m/%d",
    "DD/MM/YYYY": "%d/%m/%Y",
    "DD/MM/YY": "%d/%m/%y",
    "MMM DD, YYYY": "%b %d, %Y",
    "MMMM DD, YYYY": "%B %d, %Y",
}


def _date_query(named, out_pattern):
    def run(spark, sf_dir):
        o = table(spark, sf_dir, "orders")
        text = F.when(F.col("o_orderstatus") == "P", F.lit("not-a-date")).otherwise(
            F.date_format("o_orderdate", out_pattern)
        )
        src = o.select("o_orderkey", text.alias("order_day"))
        return _map(src, [{"column_name": "order_day", "target_dtype": "date", "date_format": named}],
                    ["o_orderkey", "order_day"])

    return run


for _key, (_named, _spark_pat, _strf) in _DATE_CASES.items():
    register(
        f"map_date_{_key}",
        f"""WITH src AS (
          SELECT o_orderkey,
                 CASE WHEN o_orderstatus = 'P' THEN 'not-a-date' ELSE strftime(o_orderdate, '{_strf}') END AS t
          FROM orders)
        SELECT o_orderkey, CAST(try_strptime(t, '{_PARSE_SQL[_named]}') AS DATE) AS order_day FROM src""",
    )(_date_query(_named, _spark_pat))


_DATETIME_CASES = {
    "ymd_hms": ("YYYY-MM-DD HH:MM:SS", "yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
    "dmy_hms": ("DD-MM-YYYY HH:MM:SS", "dd-MM-yyyy HH:mm:ss", "%d-%m-%Y %H:%M:%S"),
    "mdy_hms": ("MM-DD-YYYY HH:MM:SS", "MM-dd-yyyy HH:mm:ss", "%m-%d-%Y %H:%M:%S"),
    "ymd_t_hms": ("YYYY-MM-DDTHH:MM:SS", "yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"),
    "iso8601": ("ISO8601", "yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ"),
}


def _datetime_query(named, out_pattern):
    def run(spark, sf_dir):
        ev = table(spark, sf_dir, "events")
        text = F.when(F.col("event_type") == "error", F.lit("garbage")).otherwise(F.date_format("ts", out_pattern))
        src = ev.select("event_id", text.alias("seen_at"))
        return _map(src, [{"column_name": "seen_at", "target_dtype": "datetime", "datetime_format": named}],
                    ["event_id", "seen_at"])

    return run


for _key, (_named, _spark_pat, _strf) in _DATETIME_CASES.items():
    register(
        f"map_datetime_{_key}",
        f"""WITH src AS (
          SELECT event_id,
                 CASE WHEN event_type = 'error' THEN 'garbage' ELSE strftime(ts, '{_strf}') END AS t
          FROM events)
        SELECT event_id, try_strptime(t, '{_strf}') AS seen_at FROM src""",
    )(_datetime_query(_named, _spark_pat))


@register(
    "map_rename_prefix_suffix",
    """SELECT c_custkey, c_name AS name, CAST(c_nationkey AS BIGINT) AS dim_c_nationkey,
              c_acctbal AS c_acctbal_usd, c_mktsegment AS segment_tag
       FROM customer""",
)
def map_rename_prefix_suffix(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return apply_mappings(
        c,
        [
            ColumnMapping("c_name", "string", rename_to="name"),
            ColumnMapping("c_nationkey", "integer", prefix="dim_"),
            ColumnMapping("c_acctbal", "float", suffix="_usd"),
            ColumnMapping("c_mktsegment", "text", rename_to="segment", suffix="_tag"),
        ],
    ).df


@register(
    "map_default",
    f"""WITH {CUSTOMER_N} SELECT c_custkey, coalesce(c_acctbal, 0.0) AS c_acctbal FROM customer_n""",
)
def map_default(spark, sf_dir):
    c = customer_n(spark, sf_dir)
    m = ColumnMapping("c_acctbal", "float", is_nullable=False, default_value=0)
    return apply_mappings(c, [m]).df.select("c_custkey", "c_acctbal")


@register(
    "map_auto_merge",
    """SELECT o_orderkey, o_custkey, o_orderstatus, round_even(o_totalprice * 100, 0) / 100 AS amount,
              o_orderdate, o_orderpriority
       FROM orders""",
)
def map_auto_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    user = [ColumnMapping("o_totalprice", "decimal", rename_to="amount")]
    return apply_mappings(o, merge_mappings(user, auto_mappings(o))).df


# ---------------------------------------------------------------------------
# validation (V1-V15)

def _err_sql(src, key, col, rule, where, value_expr=None, message=None):
    msg = message or f"Failed rule ''{rule}'' on column ''{col}''"
    value = value_expr or f"CAST({col} AS VARCHAR)"
    return (
        f"SELECT {key} AS row_id, '{col}' AS \"column\", '{rule}' AS rule, {value} AS value, "
        f"'{msg}' AS message FROM {src} WHERE {where}"
    )


def _validate_errors(frame_fn, rules, order_by):
    def run(spark, sf_dir):
        return validate(frame_fn(spark, sf_dir), [ValidationRule(**r) for r in rules], order_by=order_by).errors

    return run


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def customer(spark, sf_dir):
    return table(spark, sf_dir, "customer")


def events_text(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("day"),
        F.when(F.col("event_type") == "view", F.lit("n/a")).otherwise(F.col("user_id").cast("string")).alias("uid"),
    )


EVENTS_TEXT = """events_text AS (
  SELECT event_id,
         CASE WHEN event_type = 'error' THEN 'n/a' ELSE strftime(ts, '%Y-%m-%d') END AS day,
         CASE WHEN event_type = 'view' THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS uid
  FROM events)"""


def customer_email(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    email = F.when(F.col("c_mktsegment") == "FURNITURE", F.regexp_replace("c_name", "#", "@")).otherwise(
        F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.com"))
    )
    return c.select("c_custkey", email.alias("email"))


CUSTOMER_EMAIL = """customer_email AS (
  SELECT c_custkey,
         CASE WHEN c_mktsegment = 'FURNITURE' THEN replace(c_name, '#', '@')
              ELSE lower(replace(c_name, '#', '.')) || '@example.com' END AS email
  FROM customer)"""

_V = {
    "validate_not_null": (
        customer_n, "c_custkey", [{"column": "c_acctbal", "rule_type": "not_null"}],
        f"WITH {CUSTOMER_N} " + _err_sql("customer_n", "c_custkey", "c_acctbal", "not_null", "c_acctbal IS NULL"),
    ),
    "validate_unique": (
        documents, "doc_id", [{"column": "text", "rule_type": "unique"}],
        "WITH ranked AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn "
        "FROM documents) " + _err_sql("ranked", "doc_id", "text", "unique", "rn > 1", "text"),
    ),
    "validate_min_value": (
        customer, "c_custkey", [{"column": "c_acctbal", "rule_type": "min_value", "params": {"min": 0}}],
        _err_sql("customer", "c_custkey", "c_acctbal", "min_value", "c_acctbal < 0"),
    ),
    "validate_max_value": (
        customer, "c_custkey", [{"column": "c_acctbal", "rule_type": "max_value", "params": {"max": 9000}}],
        _err_sql("customer", "c_custkey", "c_acctbal", "max_value", "c_acctbal > 9000"),
    ),
    "validate_min_length": (
        documents, "doc_id", [{"column": "text", "rule_type": "min_length", "params": {"min_length": 100}}],
        _err_sql("documents", "doc_id", "text", "min_length", "length(text) < 100", "text"),
    ),
    "validate_max_length": (
        documents, "doc_id", [{"column": "text", "rule_type": "max_length", "params": {"max_length": 20000}}],
        _err_sql("documents", "doc_id", "text", "max_length", "length(text) > 20000", "text"),
    ),
    "validate_regex": (
        customer, "c_custkey", [{"column": "c_name", "rule_type": "regex", "params": {"pattern": "Customer#000000[0-9][0-4]"}}],
        _err_sql("customer", "c_custkey", "c_name", "regex",
                 "NOT coalesce(regexp_matches(c_name, '^(?:Customer#000000[0-9][0-4])'), false)", "c_name"),
    ),
    "validate_allowed_values": (
        customer, "c_custkey",
        [{"column": "c_mktsegment", "rule_type": "allowed_values", "params": {"values": ["BUILDING", "AUTOMOBILE"]}}],
        _err_sql("customer", "c_custkey", "c_mktsegment", "allowed_values",
                 "NOT coalesce(c_mktsegment IN ('BUILDING', 'AUTOMOBILE'), false)", "c_mktsegment"),
    ),
    "validate_date_format": (
        events_text, "event_id", [{"column": "day", "rule_type": "date_format", "params": {"format": "%Y-%m-%d"}}],
        f"WITH {EVENTS_TEXT} " + _err_sql("events_text", "event_id", "day", "date_format",
                                          "day IS NOT NULL AND try_strptime(day, '%Y-%m-%d') IS NULL", "day"),
    ),
    "validate_numeric": (
        events_text, "event_id", [{"column": "uid", "rule_type": "numeric"}],
        f"WITH {EVENTS_TEXT} " + _err_sql("events_text", "event_id", "uid", "numeric",
                                          "uid IS NOT NULL AND TRY_CAST(trim(uid) AS DOUBLE) IS NULL", "uid"),
    ),
    "validate_email": (
        customer_email, "c_custkey", [{"column": "email", "rule_type": "email"}],
        f"WITH {CUSTOMER_EMAIL} " + _err_sql(
            "customer_email", "c_custkey", "email", "email",
            "NOT coalesce(regexp_matches(email, '^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+$'), false)",
            "email"),
    ),
    "validate_custom_message": (
        customer, "c_custkey",
        [{"column": "c_acctbal", "rule_type": "min_value", "params": {"min": 100},
          "error_message": "balance below floor"}],
        _err_sql("customer", "c_custkey", "c_acctbal", "min_value", "c_acctbal < 100",
                 message="balance below floor"),
    ),
}

for _name, (_frame, _key, _rules, _sql) in _V.items():
    register(_name, _sql)(_validate_errors(_frame, _rules, _key))


_MULTI_RULES = [
    {"column": "c_acctbal", "rule_type": "not_null"},
    {"column": "c_acctbal", "rule_type": "min_value", "params": {"min": 0}},
    {"column": "c_mktsegment", "rule_type": "allowed_values", "params": {"values": ["BUILDING", "AUTOMOBILE", "HOUSEHOLD"]}},
    {"column": "c_name", "rule_type": "regex", "params": {"pattern": "Customer#0000000"}},
    {"column": "no_such_column", "rule_type": "not_null"},
]
_MULTI_BAD = {
    "not_null": "c_acctbal IS NULL",
    "min_value": "coalesce(c_acctbal < 0, false)",
    "allowed_values": "NOT coalesce(c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'HOUSEHOLD'), false)",
    "regex": "NOT coalesce(regexp_matches(c_name, '^(?:Customer#0000000)'), false)",
}

register(
    "validate_errors",
    f"WITH {CUSTOMER_N} "
    + " UNION ALL ".join(
        [
            _err_sql("customer_n", "c_custkey", "c_acctbal", "not_null", _MULTI_BAD["not_null"]),
            _err_sql("customer_n", "c_custkey", "c_acctbal", "min_value", _MULTI_BAD["min_value"]),
            _err_sql("customer_n", "c_custkey", "c_mktsegment", "allowed_values", _MULTI_BAD["allowed_values"],
                     "c_mktsegment"),
            _err_sql("customer_n", "c_custkey", "c_name", "regex", _MULTI_BAD["regex"], "c_name"),
        ]
    ),
)(_validate_errors(customer_n, _MULTI_RULES, "c_custkey"))


@register(
    "validate_split",
    f"WITH {CUSTOMER_N} SELECT * FROM customer_n WHERE NOT ("
    + " OR ".join(_MULTI_BAD.values())
    + ")",
)
def validate_split(spark, sf_dir):
    return validate(customer_n(spark, sf_dir), _MULTI_RULES, order_by="c_custkey").valid


@register(
    "validate_quarantine",
    f"""WITH {CUSTOMER_N}
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment,
           concat_ws('; ',
             CASE WHEN {_MULTI_BAD['not_null']} THEN 'c_acctbal: Failed rule ''not_null'' on column ''c_acctbal''' END,
             CASE WHEN {_MULTI_BAD['min_value']} THEN 'c_acctbal: Failed rule ''min_value'' on column ''c_acctbal''' END,
             CASE WHEN {_MULTI_BAD['allowed_values']}
                  THEN 'c_mktsegment: Failed rule ''allowed_values'' on column ''c_mktsegment''' END,
             CASE WHEN {_MULTI_BAD['regex']} THEN 'c_name: Failed rule ''regex'' on column ''c_name''' END
           ) AS _validation_errors
    FROM customer_n WHERE {' OR '.join(_MULTI_BAD.values())}""",
)
def validate_quarantine(spark, sf_dir):
    return quarantine_rows(validate(customer_n(spark, sf_dir), _MULTI_RULES, order_by="c_custkey"))


# ---------------------------------------------------------------------------
# aggregation (A1-A9)

def lineitem(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


def _agg_query(frame_fn, group_by, aggs, rounding, order_by=None):
    def run(spark, sf_dir):
        out = aggregate(frame_fn(spark, sf_dir), {"group_by": group_by, "aggregations": aggs}, order_by=order_by)
        cols = [F.col(k) for k in group_by]
        for a in aggs:
            name = a.get("alias") or f"{a['function']}_{a['column']}"
            digits = rounding.get(name)
            cols.append(F.round(F.col(name), digits).alias(name) if digits is not None else F.col(name))
        return out.select(*cols)

    return run


_LI_KEYS = ["l_returnflag", "l_linestatus"]
_LI_GROUP_SQL = "l_returnflag, l_linestatus"

_AGGS = {
    "agg_sum": ([{"column": "l_quantity", "function": "sum", "alias": "sum_qty"}], {"sum_qty": 2},
                "round(coalesce(sum(l_quantity), 0), 2) AS sum_qty"),
    "agg_count": ([{"column": "l_orderkey", "function": "count"}], {}, "count(l_orderkey) AS count_l_orderkey"),
    "agg_avg": ([{"column": "l_extendedprice", "function": "avg", "alias": "avg_price"}], {"avg_price": 4},
                "round(avg(l_extendedprice), 4) AS avg_price"),
    "agg_mean": ([{"column": "l_discount", "function": "mean"}], {"mean_l_discount": 6},
                 "round(avg(l_discount), 6) AS mean_l_discount"),
    "agg_min": ([{"column": "l_discount", "function": "min", "alias": "min_disc"}], {},
                "min(l_discount) AS min_disc"),
    "agg_max": ([{"column": "l_shipdate", "function": "max", "alias": "last_ship"}], {},
                "max(l_shipdate) AS last_ship"),
    "agg_count_distinct": ([{"column": "l_partkey", "function": "count_distinct", "alias": "n_parts"}], {},
                           "count(DISTINCT l_partkey) AS n_parts"),
    "agg_nunique": ([{"column": "l_suppkey", "function": "nunique"}], {},
                    "count(DISTINCT l_suppkey) AS nunique_l_suppkey"),
    "agg_size": ([{"column": "l_tax", "function": "size", "alias": "n_rows"}], {}, "count(*) AS n_rows"),
    "agg_median": ([{"column": "l_extendedprice", "function": "median", "alias": "median_price"}],
                   {"median_price": 4}, "round(quantile_cont(l_extendedprice, 0.5), 4) AS median_price"),
    "agg_std": ([{"column": "l_quantity", "function": "std", "alias": "std_qty"}], {"std_qty": 6},
                "round(stddev_samp(l_quantity), 6) AS std_qty"),
    "agg_var": ([{"column": "l_quantity", "function": "var", "alias": "var_qty"}], {"var_qty": 6},
                "round(var_samp(l_quantity), 6) AS var_qty"),
}

for _name, (_aggs, _round, _sel) in _AGGS.items():
    register(
        _name,
        f"SELECT {_LI_GROUP_SQL}, {_sel} FROM lineitem "
        f"WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY {_LI_GROUP_SQL}",
    )(_agg_query(lineitem, _LI_KEYS, _aggs, _round))

register(
    "agg_first_last",
    """SELECT o_orderpriority,
              arg_min(o_custkey, o_orderkey) AS first_cust,
              arg_max(o_custkey, o_orderkey) AS last_cust
       FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority""",
)(_agg_query(lambda s, d: table(s, d, "orders"), ["o_orderpriority"],
             [{"column": "o_custkey", "function": "first", "alias": "first_cust"},
              {"column": "o_custkey", "function": "last", "alias": "last_cust"}], {}, order_by="o_orderkey"))

register(
    "agg_prod",
    """SELECT l_orderkey, CAST(product(l_linenumber) AS DOUBLE) AS prod_l_linenumber
       FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey""",
)(_agg_query(lineitem, ["l_orderkey"], [{"column": "l_linenumber", "function": "prod"}], {}))

register(
    "agg_multi",
    """SELECT l_returnflag, l_linestatus,
              round(coalesce(sum(l_extendedprice), 0), 2) AS revenue,
              round(avg(l_extendedprice), 4) AS avg_revenue,
              max(l_extendedprice) AS max_revenue,
              count(l_orderkey) AS n_lines,
              count(DISTINCT l_orderkey) AS n_orders,
              round(quantile_cont(l_quantity, 0.5), 4) AS median_qty
       FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL
       GROUP BY l_returnflag, l_linestatus""",
)(_agg_query(lineitem, _LI_KEYS, [
    {"column": "l_extendedprice", "function": "sum", "alias": "revenue"},
    {"column": "l_extendedprice", "function": "avg", "alias": "avg_revenue"},
    {"column": "l_extendedprice", "function": "max", "alias": "max_revenue"},
    {"column": "l_orderkey", "function": "count", "alias": "n_lines"},
    {"column": "l_orderkey", "function": "count_distinct", "alias": "n_orders"},
    {"column": "l_quantity", "function": "median", "alias": "median_qty"},
], {"revenue": 2, "avg_revenue": 4, "median_qty": 4}))

register(
    "agg_null_keys",
    f"""WITH {ORDERS_N}
    SELECT o_orderpriority, round(coalesce(sum(o_totalprice), 0), 2) AS total, count(o_totalprice) AS n_priced,
           count(*) AS n_rows
    FROM orders_n WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority""",
)(_agg_query(orders_n, ["o_orderpriority"], [
    {"column": "o_totalprice", "function": "sum", "alias": "total"},
    {"column": "o_totalprice", "function": "count", "alias": "n_priced"},
    {"column": "o_totalprice", "function": "size", "alias": "n_rows"},
], {"total": 2}))

register(
    "agg_all_null_group",
    f"""WITH {ORDERS_N}
    SELECT o_orderstatus, round(coalesce(sum(o_totalprice), 0), 2) AS total,
           round(quantile_cont(o_totalprice, 0.5), 4) AS median_total
    FROM orders_n WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus""",
)(_agg_query(orders_n, ["o_orderstatus"], [
    {"column": "o_totalprice", "function": "sum", "alias": "total"},
    {"column": "o_totalprice", "function": "median", "alias": "median_total"},
], {"total": 2, "median_total": 4}))


# ---------------------------------------------------------------------------
# the full job (J1): filter -> map -> validate -> aggregate

ETL_FULL_SQL = """
WITH f AS (SELECT * FROM orders WHERE o_orderstatus IS NOT DISTINCT FROM 'F'),
m AS (SELECT o_orderkey, round_even(o_totalprice * 100, 0) / 100 AS amount, o_orderpriority FROM f),
v AS (SELECT * FROM m WHERE NOT coalesce(amount < 1000, false))
SELECT o_orderpriority,
       round(coalesce(sum(amount), 0), 2) AS total_amount,
       count(amount) AS n_orders,
       round(avg(amount), 4) AS avg_amount
FROM v WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority
"""


@register("etl_full", ETL_FULL_SQL)
def etl_full(spark, sf_dir):
    res = run_stages(
        table(spark, sf_dir, "orders"),
        filters=[FilterRule("o_orderstatus", "eq", "F")],
        mappings=[ColumnMapping("o_totalprice", "decimal", rename_to="amount")],
        rules=[ValidationRule("amount", "min_value", {"min": 1000})],
        aggregation={
            "group_by": ["o_orderpriority"],
            "aggregations": [
                {"column": "amount", "function": "sum", "alias": "total_amount"},
                {"column": "amount", "function": "count", "alias": "n_orders"},
                {"column": "amount", "function": "avg", "alias": "avg_amount"},
            ],
        },
        order_by="o_orderkey",
    )
    return res.output.select(
        "o_orderpriority",
        F.round("total_amount", 2).alias("total_amount"),
        "n_orders",
        F.round("avg_amount", 4).alias("avg_amount"),
    )
