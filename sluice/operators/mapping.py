"""Column mapping: casts, truncation, defaults, NOT NULL checks, renames.

The whole mapping is one ``select``: mapped columns are replaced in place,
unmapped columns pass through, renames are aliases.  Column-level failures
(a fractional value in an integer column, nulls in a NOT NULL column without
a default) need one aggregate over the input; all such checks share a single
pass that reads only the checked columns.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import casts
from ..specs import ColumnMapping

log = logging.getLogger("sluice.mapping")


class MappingError(ValueError):
    def __init__(self, errors):
        self.errors = errors
        super().__init__(
            f"mapping failed for {len(errors)} column(s): " + "; ".join(f"{e['column']}: {e['error']}" for e in errors)
        )


@dataclass
class MappingResult:
    df: DataFrame
    errors: list = field(default_factory=list)


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _first_value(df: DataFrame, name: str, order_by: str | None):
    """First non-null value of a column in row order (top-1, no full sort)."""
    c = _q(name)
    rows = df.filter(c.isNotNull())
    if order_by:
        rows = rows.orderBy(_q(order_by))
    row = rows.select(c.cast("string").alias("v")).limit(1).collect()
    return row[0]["v"] if row else None


def _default_literal(value, dtype: T.DataType) -> Column:
    return F.lit(value).try_cast(dtype) if not isinstance(dtype, T.NullType) else F.lit(value)


@dataclass
class MappingPlan:
    """Cast expressions by source column, the checks they still need, and errors found while planning.

    The expressions name source columns only, so a plan applies to any frame
    with the columns it was made for.
    """

    exprs: dict[str, Column]
    rename: dict[str, str]
    fraction_checks: dict[str, Column]
    null_checks: dict[str, Column]
    errors: list[dict]

    def check_counts(self) -> list[Column]:
        """One count of offending rows for each check, to be aggregated or observed."""
        checks = [*self.fraction_checks.values(), *self.null_checks.values()]
        return [F.count_if(c).alias(f"_check_{i}") for i, c in enumerate(checks)]

    def settle(self, counts: dict) -> bool:
        """Turn check counts into errors.  True if a cast had to be dropped."""
        dropped = False
        for i, name in enumerate([*self.fraction_checks, *self.null_checks]):
            bad = counts.get(f"_check_{i}") or 0
            if not bad:
                continue
            if i < len(self.fraction_checks):
                self.errors.append({"column": name, "error": f"{bad} value(s) have a fraction or do not fit an integer"})
                self.exprs.pop(name, None)
                dropped = True
            elif name in self.exprs:
                self.errors.append({"column": name, "error": f"{bad} NULL value(s) in a NOT NULL column without a default"})
        self.fraction_checks, self.null_checks = {}, {}
        return dropped

    def apply(self, df: DataFrame) -> DataFrame:
        return df.select(*[self.exprs.get(c, _q(c)).alias(self.rename.get(c, c)) for c in df.columns])


def plan_mappings(df: DataFrame, mappings, order_by: str | None = None) -> MappingPlan:
    """Plan the casts of ``mappings`` for ``df``.

    Reads data only for date columns without a format: one first value each.
    """
    mappings = [m if isinstance(m, ColumnMapping) else ColumnMapping(**m) for m in mappings or ()]
    schema = {f.name: f.dataType for f in df.schema.fields}
    plan = MappingPlan({}, {}, {}, {}, [])
    for m in mappings:
        name = m.column_name
        if name not in schema:
            plan.errors.append({"column": name, "error": "no such column in the input"})
            continue
        plan.rename[name] = m.final_name
        dtype = schema[name]
        guess = None
        declared = m.date_format if m.target_dtype == "date" else m.datetime_format
        if m.target_dtype in ("date", "datetime", "timestamp") and not declared and casts.is_string(dtype):
            sample = _first_value(df, name, order_by)
            guess = casts.guess_date_pattern(sample, df.sparkSession)
            if sample is not None and guess is None:
                plan.errors.append({"column": name, "error": f"no known date format fits {sample!r}"})
                continue
        expr, fraction = casts.cast_column(_q(name), dtype, m, guess)
        if fraction is not None:
            plan.fraction_checks[name] = fraction
        if not m.is_nullable:
            if m.default_value is not None:
                expr = F.coalesce(expr, _default_literal(m.default_value, casts.spark_type_for(m.target_dtype)))
            else:
                plan.null_checks[name] = expr.isNull()
        plan.exprs[name] = expr
    return plan


def apply_mappings(
    df: DataFrame,
    mappings,
    on_error: str = "fail",
    order_by: str | None = None,
) -> MappingResult:
    """Apply column mappings; returns the mapped frame and column errors.

    ``on_error``: ``fail`` raises MappingError, ``warn`` logs and continues,
    ``report`` returns the errors silently.  A column whose cast failed keeps
    its source values, as the stage leaves it untouched.  The checks are one
    aggregate over the checked columns; ``plans.jobs`` counts them in its
    writing action instead.
    """
    plan = plan_mappings(df, mappings, order_by)
    if checks := plan.check_counts():
        plan.settle(df.agg(*checks).first().asDict())
    if plan.errors:
        if on_error == "fail":
            raise MappingError(plan.errors)
        if on_error == "warn":
            for e in plan.errors:
                log.warning("Transform error on '%s': %s", e["column"], e["error"])
    return MappingResult(plan.apply(df), plan.errors)


# Targets of automatic mappings by Spark type; anything else is text.
_AUTO_TARGETS = (
    (casts.INTEGRAL_TYPES, "bigint"),
    ((T.FloatType, T.DoubleType, T.DecimalType), "float"),
    (T.BooleanType, "boolean"),
    ((T.TimestampType, T.TimestampNTZType), "timestamp"),
    (T.DateType, "date"),
)


def auto_mappings(df: DataFrame) -> list[ColumnMapping]:
    """Pass-through mappings from a frame's schema (migrate as-is)."""
    return [
        ColumnMapping(
            column_name=f.name,
            source_dtype=f.dataType.simpleString(),
            target_dtype=next((target for types, target in _AUTO_TARGETS if isinstance(f.dataType, types)), "text"),
        )
        for f in df.schema.fields
    ]


def merge_mappings(user, auto) -> list[ColumnMapping]:
    """User mappings first; automatic ones fill in columns the user left out."""
    user = list(user or ())
    if not user:
        return list(auto)
    named = {m.column_name for m in user}
    return user + [m for m in auto if m.column_name not in named]
