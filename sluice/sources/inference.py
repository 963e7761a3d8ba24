"""Type inference for text columns (CSV cells, JSON record fields).

One aggregate pass decides every column at once: integer if every non-null
value is an integer literal (double when some are missing, as a missing
integer reads as NaN), float if every value is a number, boolean if every
value is a True/False token and none is missing, text otherwise.  Dates are
never inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions.casts import INFINITIES, NUMBER_SHAPE, no_fraction, text_to_double


def cell_kind(c: Column) -> Column:
    """One code per cell, computed once: n(ull) i(nteger) f(loat) b(oolean)
    s(tring).  One regular expression per cell; the bigint cast runs only
    on integer-shaped text, so it never fails (a failed try-cast is costly)."""
    v = F.trim(c)
    number = v.rlike(NUMBER_SHAPE)
    integer = F.when(no_fraction(v) & v.try_cast("bigint").isNotNull(), F.lit("i")).otherwise(F.lit("f"))
    return (
        F.when(c.isNull(), F.lit("n"))
        .when(number, integer)
        .when(F.lower(v).isin(*INFINITIES), F.lit("f"))
        .when(c.isin(*C.CSV_TRUE_TOKENS, *C.CSV_FALSE_TOKENS), F.lit("b"))
        .otherwise(F.lit("s"))
    )


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def null_tokens(df: DataFrame, columns=None) -> DataFrame:
    """Text cells holding a missing-value token become null (typed columns
    are left alone: the tokens are text)."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    columns = set(columns or df.columns) & text
    return df.select(
        *[
            F.when(_q(c).isin(*C.CSV_NULL_TOKENS), F.lit(None)).otherwise(_q(c)).alias(c) if c in columns else _q(c)
            for c in df.columns
        ]
    )


def inference_aggregates(columns) -> list[Column]:
    """One aggregate per column: the set of cell kinds seen (at most five
    codes, so the buffer is bounded).  Each kind column is referenced once,
    which keeps the optimized plan small."""
    return [F.collect_set(_q(c)).alias(f"k{i}") for i, c in enumerate(columns)]


def decide_kinds(kinds) -> str:
    """Spark type for a column from the set of its cell kinds."""
    seen = set(kinds or ())
    values = seen - {"n"}
    if not values:
        return "double"  # an all-missing column reads as float NaN
    if values == {"i"}:
        return "bigint" if "n" not in seen else "double"
    if values <= {"i", "f"}:
        return "double"
    if values == {"b"} and "n" not in seen:
        return "boolean"
    return "string"


def decide_types(row, columns) -> dict[str, str]:
    return {c: decide_kinds(row[f"k{i}"]) for i, c in enumerate(columns)}


def cast_inferred(df: DataFrame, types: dict[str, str]) -> DataFrame:
    cols = []
    for c in df.columns:
        t = types.get(c, "string")
        v = F.trim(_q(c))
        if t == "bigint":
            cols.append(v.try_cast("bigint").alias(c))
        elif t == "double":
            cols.append(text_to_double(v).alias(c))
        elif t == "boolean":
            cols.append(_q(c).isin(*C.CSV_TRUE_TOKENS).alias(c))
        else:
            cols.append(_q(c).alias(c))
    return df.select(*cols)


def infer_and_cast(df: DataFrame) -> tuple[DataFrame, object]:
    """Infer every string column's type in one pass and cast."""
    columns = list(df.columns)
    staged = df.select(*[cell_kind(_q(c)).alias(c) for c in columns])
    row = staged.agg(*inference_aggregates(columns)).first()
    return cast_inferred(df, decide_types(row, columns)), row
