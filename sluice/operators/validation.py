"""Row validation: one ``errors`` array per row, then valid / invalid split.

Each rule is a never-null ``bad`` predicate plus an error struct; all rules
of the stage fuse into a single projection: ``_invalid = bad_1 OR ...`` for
the split and ``_errors = concat(when(bad_i, array(struct_i)) ...)`` for the
reasons, both inside whole-stage codegen.
Only ``unique`` needs data from other rows; it uses the skew-safe repeat
marks of ``keys``.  Text keys are grouped by their SHA-256
digest, so the shuffles move 32 bytes per key instead of the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions import casts
from ..functions.dates import strptime_to_java
from ..functions.literals import typed_values
from ..specs import ValidationRule
from .keys import mark_repeats

ERRORS = "_errors"
BAD = "_invalid"
ROW_ID = "_row_id"

ERROR_TYPE = T.StructType(
    [
        T.StructField("column", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)


@dataclass
class ValidationResult:
    annotated: DataFrame  # input columns + _errors array + _invalid flag
    valid: DataFrame
    invalid: DataFrame
    errors: DataFrame  # one row per failure: row id, column, rule, value, message


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _text(c: Column, dtype: T.DataType) -> Column:
    return c if casts.is_string(dtype) else c.cast("string")


def _never_null(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def bad_predicate(df: DataFrame, rule: ValidationRule, dup_col: str | None):
    """Never-null 'row fails rule' predicate, or None for an unknown column."""
    if rule.column not in df.columns:
        return None
    c = _q(rule.column)
    dtype = df.schema[rule.column].dataType
    params = rule.params or {}
    kind = rule.rule_type
    if kind == "not_null":
        return (c.isNull() | F.isnan(c)) if isinstance(dtype, casts.FLOATING_TYPES) else c.isNull()
    if kind == "unique":
        return _q(dup_col)
    if kind in ("min_value", "max_value"):
        num = casts.to_double(c, dtype, clean=False)
        if kind == "min_value":
            return _never_null(num < F.lit(float(params.get("min", 0))))
        return _never_null(num > F.lit(float(params.get("max", 0))))
    if kind == "min_length":
        return _never_null(F.length(_text(c, dtype)) < int(params.get("min_length", 0)))
    if kind == "max_length":
        return _never_null(F.length(_text(c, dtype)) > int(params.get("max_length", 255)))
    if kind == "regex":
        # a match anchored at the start of the value only; null never matches
        pattern = "^(?:" + str(params.get("pattern", "")) + ")"
        return ~_never_null(_text(c, dtype).rlike(pattern))
    if kind == "allowed_values":
        vals = typed_values(dtype, params.get("values", []))
        return ~_never_null(c.isin(*vals)) if vals else F.lit(True)
    if kind == "date_format":
        if isinstance(dtype, casts.TIME_TYPES):
            return F.lit(False)
        pattern = strptime_to_java(params.get("format", "%Y-%m-%d"))
        parsed = F.try_to_timestamp(_text(c, dtype), F.lit(pattern))
        return c.isNotNull() & parsed.isNull()
    if kind == "numeric":
        return c.isNotNull() & casts.to_double(c, dtype, clean=False).isNull()
    if kind == "email":
        return ~_never_null(_text(c, dtype).rlike(C.EMAIL_PATTERN))
    raise ValueError(f"unknown rule {kind}")


def validate(df: DataFrame, rules, order_by: str | None = None, lookup: DataFrame | None = None) -> ValidationResult:
    """Split ``df`` into valid and invalid rows with a reason for every failure.

    ``order_by`` names the row-order column (first occurrence for ``unique``
    and the ``row_id`` of error records).  Without one, file order from
    ``monotonically_increasing_id`` right after the scan is used; that is
    stable for a direct file scan - pass a column for shuffled inputs.
    ``lookup`` is a frame of the same rows that ``unique`` may read for its
    keys, so that rows of ``df`` pass once (see ``plans.jobs``).
    """
    rules = [r if isinstance(r, ValidationRule) else ValidationRule(**r) for r in rules or ()]
    base = df
    order_col = order_by
    if order_col is None:
        order_col = ROW_ID
        base = base.withColumn(ROW_ID, F.monotonically_increasing_id())
        lookup = lookup if lookup is None else lookup.withColumn(ROW_ID, F.monotonically_increasing_id())

    work = base
    dup_cols: dict[str, str] = {}
    for r in rules:
        if r.rule_type == "unique" and r.column in df.columns and r.column not in dup_cols:
            name = f"_repeat_{len(dup_cols)}"
            key = r.column
            dtype = df.schema[r.column].dataType
            if casts.is_string(dtype) or isinstance(dtype, T.BinaryType):
                # group and join long values by a 32-byte digest instead of
                # the value itself (nulls stay null, so they still group)
                key = f"_digest_{len(dup_cols)}"
                digest = F.sha2(_q(r.column).cast("binary"), 256)
                work = work.withColumn(key, digest)
                lookup = lookup if lookup is None else lookup.withColumn(key, digest)
            work = mark_repeats(work, [key], order_col, name, lookup)
            dup_cols[r.column] = name

    bads, structs = [], []
    empty = F.array().cast(T.ArrayType(ERROR_TYPE))
    for r in rules:
        bad = bad_predicate(work, r, dup_cols.get(r.column))
        if bad is None:
            continue
        dtype = work.schema[r.column].dataType
        err = F.struct(
            F.lit(r.column).alias("column"),
            F.lit(r.rule_type).alias("rule"),
            _text(_q(r.column), dtype).alias("value"),
            F.lit(r.message).alias("message"),
        )
        bads.append(bad)
        structs.append(F.when(bad, F.array(err)).otherwise(empty))

    # The split uses a plain OR of the rule predicates (whole-stage codegen);
    # the error list is a concat of one-element arrays, no lambda functions.
    any_bad = reduce(lambda a, b: a | b, bads) if bads else F.lit(False)
    errors = F.concat(*structs) if structs else empty
    keep_cols = [_q(c) for c in base.columns]
    annotated = work.select(*keep_cols, errors.alias(ERRORS), any_bad.alias(BAD))
    user_cols = [_q(c) for c in df.columns]
    valid = annotated.filter(~F.col(BAD)).select(*user_cols)
    invalid = annotated.filter(F.col(BAD))
    error_rows = invalid.select(
        _q(order_col).alias("row_id"), F.explode(ERRORS).alias("e")
    ).select("row_id", "e.column", "e.rule", "e.value", "e.message")
    return ValidationResult(
        annotated=annotated,
        valid=valid,
        invalid=invalid.select(*user_cols, ERRORS),
        errors=error_rows,
    )


def error_text(errors: Column | str = ERRORS) -> Column:
    """``"col: message; col: message"`` for a quarantine file."""
    e = F.col(errors) if isinstance(errors, str) else errors
    return F.concat_ws("; ", F.transform(e, lambda x: F.concat(x["column"], F.lit(": "), x["message"])))


def quarantine_rows(result: ValidationResult) -> DataFrame:
    """Invalid rows plus their reasons as text, ready for a file sink."""
    return result.invalid.withColumn("_validation_errors", error_text()).drop(ERRORS)
