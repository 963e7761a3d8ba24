"""Row filters (eq ... not_in), ANDed, with a complement output.

Rules see source column names and types.  Each rule becomes one Catalyst
predicate and all rules fuse into one ``Filter``.  The kept side uses the
plain form of each predicate so Catalyst can push it into the scan (a filter
drops a null result anyway); the complement uses the never-null form so that
kept + dropped is always the whole input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casts import FLOATING_TYPES
from ..functions.literals import LiteralTypeError, typed_literal, typed_values
from ..specs import FilterRule

_ORDERING = {
    "gt": lambda c, v: c > v,
    "lt": lambda c, v: c < v,
    "gte": lambda c, v: c >= v,
    "lte": lambda c, v: c <= v,
}


def _contains(c: Column, pattern) -> Column:
    # a regular-expression search on the text form of the value
    return c.cast("string").rlike(str(pattern))


def rule_predicate(df: DataFrame, rule: FilterRule) -> tuple[Column, Column] | None:
    """(plain, total) predicates of one rule, or None for an unknown column.

    ``plain`` may be null for a null input and is only used where null means
    'drop'; ``total`` is never null.
    """
    if rule.column not in df.columns:
        return None
    c = F.col(f"`{rule.column}`")
    dtype = df.schema[rule.column].dataType
    op = rule.operator
    # NaN is a missing value; the extra term stays outside the pushed-down
    # comparison, so the scan still receives the plain predicate
    nan = F.isnan(c) if isinstance(dtype, FLOATING_TYPES) else None

    def present(p: Column) -> Column:
        return p if nan is None else p & ~nan

    def or_missing(p: Column) -> Column:
        return p if nan is None else p | nan

    if op == "is_null":
        p = or_missing(c.isNull())
        return p, p
    if op == "is_not_null":
        p = present(c.isNotNull())
        return p, p
    if op in ("eq", "neq"):
        lit = typed_literal(dtype, rule.value)
        eq = present(c.eqNullSafe(lit)) if lit is not None else F.lit(False)
        p = eq if op == "eq" else ~eq
        return p, p
    if op in _ORDERING:
        lit = typed_literal(dtype, rule.value)
        if lit is None:
            raise LiteralTypeError(
                f"cannot compare column '{rule.column}' ({dtype.simpleString()}) "
                f"with {rule.value!r} using '{op}'"
            )
        plain = present(_ORDERING[op](c, lit))
        return plain, F.coalesce(plain, F.lit(False))
    if op in ("contains", "not_contains"):
        plain = present(_contains(c, rule.value))
        total = F.coalesce(plain, F.lit(False))
        if op == "contains":
            return plain, total
        return ~total, ~total
    if op in ("in", "not_in"):
        vals = typed_values(dtype, rule.values)
        plain = present(c.isin(*vals)) if vals else F.lit(False)
        total = F.coalesce(plain, F.lit(False))
        if op == "in":
            return plain, total
        return ~total, ~total
    raise ValueError(f"unknown operator {op}")


def predicates(df: DataFrame, rules) -> tuple[Column, Column] | None:
    """ANDed (plain, total) predicates of all known-column rules."""
    preds = [p for p in (rule_predicate(df, r) for r in rules or ()) if p is not None]
    if not preds:
        return None
    plain = reduce(lambda a, b: a & b, (p for p, _ in preds))
    total = reduce(lambda a, b: a & b, (t for _, t in preds))
    return plain, total


def keep(df: DataFrame, rules) -> DataFrame:
    """Rows passing every rule (pushdown-friendly form)."""
    p = predicates(df, rules)
    return df if p is None else df.filter(p[0])


def drop(df: DataFrame, rules) -> DataFrame:
    """Rows failing at least one rule: the exact complement of ``keep``."""
    p = predicates(df, rules)
    return df.filter(F.lit(False)) if p is None else df.filter(~p[1])


def apply_filters(df: DataFrame, rules) -> tuple[DataFrame, DataFrame]:
    """(kept, filtered_out), both lazy.  No rules: all kept, empty complement."""
    rules = [r if isinstance(r, FilterRule) else FilterRule(**r) for r in rules or ()]
    return keep(df, rules), drop(df, rules)
