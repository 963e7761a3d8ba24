"""Column cast expressions of the column mapping (integer ... json).

Every builder takes a source ``Column`` plus its Spark type and returns a
``Column``; nothing here runs a job.  ANSI casts raise on bad text, so every
text conversion is a ``try_`` form limited to the accept-set of the pandas
readers being reproduced.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from . import dates

# Text that reads as a finite decimal number: sign, digits, optional
# fraction and exponent.  Spark's cast alone would also accept '1d' and
# '5f'.  The shape test also guards every text cast: a failed try-cast
# costs an exception inside Spark, a regular-expression miss does not.
NUMBER_SHAPE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INFINITIES = ("inf", "+inf", "-inf", "infinity", "+infinity", "-infinity")

NUMERIC_TYPES = (
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
    T.DecimalType,
)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING_TYPES = (T.FloatType, T.DoubleType)
TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES)


def is_string(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def clean_number_text(c: Column) -> Column:
    """Drop thousands separators and dollar signs, trim blanks."""
    return F.trim(F.translate(c.cast("string"), ",$", ""))


def no_fraction(s: Column) -> Column:
    # no fraction and no exponent (the text already has a number's shape)
    return (F.instr(s, ".") == 0) & (F.instr(s, "e") == 0) & (F.instr(s, "E") == 0)


def is_number_text(s: Column) -> Column:
    """Trimmed text with the shape of a number (infinities included).
    One regular expression; case folding only for the rare misses."""
    return F.when(s.rlike(NUMBER_SHAPE), F.lit(True)).otherwise(F.lower(s).isin(*INFINITIES))


def plain_integer(s: Column, is_number: Column) -> Column:
    """A number-shaped text with no fraction or exponent, as bigint (null
    when out of range)."""
    return F.when(is_number & s.rlike(NUMBER_SHAPE) & no_fraction(s), s.try_cast("bigint"))


def text_to_double(s: Column) -> Column:
    """Number text -> double; anything else (including 'nan') -> null."""
    return F.when(is_number_text(s), s.try_cast("double"))


def to_double(c: Column, dtype: T.DataType, clean: bool = True) -> Column:
    """Any column -> double, the way a numeric coercion reads it."""
    if isinstance(dtype, FLOATING_TYPES):
        return F.when(~F.isnan(c), c.cast("double"))
    if is_numeric(dtype):
        return c.cast("double")
    if isinstance(dtype, T.BooleanType):
        return c.cast("double")
    s = clean_number_text(c) if clean else F.trim(c.cast("string"))
    return text_to_double(s)


def to_integer_parts(c: Column, dtype: T.DataType) -> tuple[Column, Column | None]:
    """Any column -> bigint, plus a 'not integral' flag for the column check.

    The flag is None when the source type can never hold a fraction.  A
    fractional value fails the whole column (checked by one aggregate).
    """
    if isinstance(dtype, INTEGRAL_TYPES):
        return c.cast("bigint"), None
    if isinstance(dtype, T.BooleanType):
        return c.cast("bigint"), None
    if isinstance(dtype, T.DecimalType) and dtype.scale == 0:
        return c.try_cast("bigint"), None
    d = to_double(c, dtype)
    if is_string(dtype):
        s = clean_number_text(c)
        value = F.coalesce(plain_integer(s, d.isNotNull()), F.when(d == F.floor(d), d.try_cast("bigint")))
    else:
        value = F.when(d == F.floor(d), d.try_cast("bigint"))
    bad = d.isNotNull() & ((d != F.floor(d)) | value.isNull())
    return value, bad


def to_decimal(c: Column, dtype: T.DataType) -> Column:
    """Float, then round half-to-even at two places (on x*100)."""
    d = to_double(c, dtype)
    return F.rint(d * 100) / 100


def to_text(c: Column, dtype: T.DataType, max_length: int | None = None) -> Column:
    s = c if is_string(dtype) else c.cast("string")
    if max_length:
        s = F.substring(s, 1, max_length)
    return s


def to_boolean(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        return c
    norm = F.lower(F.trim(c.cast("string")))
    return F.when(norm.isin(*C.TRUE_TOKENS), F.lit(True)).when(
        norm.isin(*C.FALSE_TOKENS), F.lit(False)
    )


def to_date(c: Column, dtype: T.DataType, pattern: str) -> Column:
    if isinstance(dtype, T.DateType):
        return c
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(c)
    return dates.parse_date(c.cast("string"), pattern)


def to_datetime(c: Column, dtype: T.DataType, pattern: str) -> Column:
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz")
    return dates.parse_timestamp_ntz(c.cast("string"), pattern)


def cast_column(c: Column, dtype: T.DataType, mapping, date_guess: str | None = None):
    """Mapping -> (expression, fraction-check flag or None)."""
    target = mapping.target_dtype
    if target in ("integer", "bigint"):
        return to_integer_parts(c, dtype)
    if target == "float":
        return to_double(c, dtype), None
    if target == "decimal":
        return to_decimal(c, dtype), None
    if target in ("string", "text", "json"):
        return to_text(c, dtype, mapping.max_length), None
    if target == "boolean":
        return to_boolean(c, dtype), None
    if target == "date":
        if mapping.date_format:
            pattern = dates.date_pattern(mapping.date_format)
        else:
            pattern = date_guess or dates.date_pattern(None)
        return to_date(c, dtype, pattern), None
    if target in ("datetime", "timestamp"):
        pattern = dates.datetime_pattern(mapping.datetime_format)
        if not mapping.datetime_format and date_guess:
            pattern = date_guess
        return to_datetime(c, dtype, pattern), None
    raise ValueError(f"unknown target type {target}")


def spark_type_for(target: str) -> T.DataType:
    return {
        "integer": T.LongType(),
        "bigint": T.LongType(),
        "float": T.DoubleType(),
        "decimal": T.DoubleType(),
        "string": T.StringType(),
        "text": T.StringType(),
        "json": T.StringType(),
        "boolean": T.BooleanType(),
        "date": T.DateType(),
        "datetime": T.TimestampNTZType(),
        "timestamp": T.TimestampNTZType(),
    }[target]


def guess_date_pattern(sample_value: str | None, spark) -> str | None:
    """Pick the first guess pattern that parses one sample value.

    Runs on a one-row local relation: the value was already fetched by the
    caller with a top-1 query, so this costs no scan of the data.  None means
    that there is no value or that no pattern fits it.
    """
    if sample_value is None:
        return None
    probe = spark.createDataFrame([(str(sample_value),)], "v string")
    checks = [
        F.try_to_timestamp(F.col("v"), F.lit(p)).isNotNull().alias(f"p{i}")
        for i, p in enumerate(dates.GUESS_PATTERNS)
    ]
    row = probe.select(*checks).first()
    for i, p in enumerate(dates.GUESS_PATTERNS):
        if row[f"p{i}"]:
            return p
    return None
