"""Group-by aggregation: null keys dropped, result ordered by key.

All functions except ``median`` are built-in aggregates with map-side
partial aggregation, so a hot group costs one partial row per task.  The
exact median is computed by rank selection (``median.exact_median``) and
joined to the other results on the group keys (one row per group each).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casts import FLOATING_TYPES
from ..specs import AggregationRule
from .distinct import distinct_counts, join_counts
from .median import exact_median

ROW_ID = "_row_id"


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def agg_expression(function: str, column: str, order_col: str | None, floating: bool = False) -> Column:
    c = _q(column)
    if floating:
        c = F.when(~F.isnan(c), c)  # NaN is a missing value, skipped like null
    if function == "sum":
        # an all-null group sums to 0
        return F.coalesce(F.sum(c), F.lit(0))
    if function == "count":
        return F.count(c)
    if function in ("avg", "mean"):
        return F.avg(c)
    if function == "min":
        return F.min(c)
    if function == "max":
        return F.max(c)
    if function in ("count_distinct", "nunique"):
        return F.count_distinct(c)
    if function == "std":
        return F.stddev_samp(c)
    if function == "var":
        return F.var_samp(c)
    if function == "size":
        return F.count(F.lit(1))
    if function == "prod":
        return F.coalesce(F.product(c), F.lit(1.0))
    if function in ("first", "last"):
        if order_col is None:
            raise ValueError("first/last need a row order column")
        order = F.when(c.isNotNull(), _q(order_col))
        return F.min_by(c, order) if function == "first" else F.max_by(c, order)
    raise ValueError(f"unsupported aggregation function {function}")


def aggregate(df: DataFrame, rule, order_by: str | None = None) -> DataFrame:
    """Apply one group-by rule; every requested function is kept (D3)."""
    if not isinstance(rule, AggregationRule):
        rule = AggregationRule(**rule)
    keys = list(rule.group_by)
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ValueError(f"group_by columns not found: {missing}")
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, FLOATING_TYPES)}
    present = [(_q(k).isNotNull() & ~F.isnan(_q(k))) if k in floating else _q(k).isNotNull() for k in keys]
    base = df.filter(reduce(lambda a, b: a & b, present))
    order_col = order_by
    if order_col is None and any(a.function in ("first", "last") for a in rule.aggregations):
        order_col = ROW_ID
        base = base.withColumn(ROW_ID, F.monotonically_increasing_id())

    # one distinct count needs no copies of rows; several are counted together from partial sets
    distinct = [a for a in rule.aggregations if a.function in ("count_distinct", "nunique")]
    distinct = distinct if len({a.column for a in distinct}) > 1 else []
    plain = [a for a in rule.aggregations if a.function != "median" and a not in distinct]
    medians = [a for a in rule.aggregations if a.function == "median"]
    key_cols = [_q(k) for k in keys]

    exprs = [agg_expression(a.function, a.column, order_col, a.column in floating).alias(a.name) for a in plain]
    out = base.groupBy(*key_cols).agg(*(exprs or [F.count(F.lit(1)).alias("_size")]))
    if distinct:
        out = join_counts(out, distinct_counts(base, [a.column for a in distinct], keys, "_distinct"), keys)
        for i, a in enumerate(distinct):
            out = out.withColumn(a.name, F.coalesce(F.col(f"_distinct{i}"), F.lit(0))).drop(f"_distinct{i}")
    for a in medians:
        # groups whose values are all null get a null median, not a lost row
        out = out.join(exact_median(base, a.column, keys, a.name), keys, "left")
    names = [a.name for a in rule.aggregations]
    return out.select(*key_cols, *[_q(n) for n in names]).orderBy(*key_cols)
