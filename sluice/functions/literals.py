"""Typing of user literals against column types, decided on the driver.

Under ANSI mode ``int_col = 'abc'`` raises at run time, so a rule's literal
is checked against the column type while the plan is built: a foreign-typed
literal never matches an equality or membership test and makes an ordering
test an error, as comparing unlike Python values does.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .casts import TIME_TYPES, is_numeric, is_string


class LiteralTypeError(TypeError):
    """An ordering comparison between unlike types."""


def _is_number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def typed_literal(dtype: T.DataType, value) -> Column | None:
    """Literal usable against a column of ``dtype``, or None if unlike."""
    if value is None:
        return None
    if is_numeric(dtype):
        if _is_number(value) or isinstance(value, bool):
            return F.lit(value)
        return None
    if isinstance(dtype, T.BooleanType):
        if isinstance(value, bool):
            return F.lit(value)
        if _is_number(value) and value in (0, 1):
            return F.lit(bool(value))
        return None
    if is_string(dtype):
        return F.lit(value) if isinstance(value, str) else None
    if isinstance(dtype, TIME_TYPES):
        if isinstance(value, (_dt.datetime, _dt.date)):
            return F.lit(value)
        if isinstance(value, str):
            # a string is read as a point in time, like a timestamp coercion
            target = "date" if isinstance(dtype, T.DateType) else dtype.simpleString()
            return F.lit(value).try_cast(target)
        return None
    return F.lit(value)


def typed_values(dtype: T.DataType, values) -> list[Column]:
    out = []
    for v in values or ():
        lit = typed_literal(dtype, v)
        if lit is not None:
            out.append(lit)
    return out
