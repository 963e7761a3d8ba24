"""Date and datetime parsing expressions.

All parsing is done by Spark's own ``try_to_timestamp`` / ``to_timestamp_ntz``
with Java patterns; strptime-style formats given by users are translated once
on the driver into a Java pattern (plain string work, no data touched).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

# strptime directive -> Java DateTimeFormatter letters.  %m / %d / %H / %M /
# %S map to single letters because strptime accepts one or two digits there.
_DIRECTIVES = {
    "Y": "yyyy",
    "y": "yy",
    "m": "M",
    "d": "d",
    "H": "H",
    "I": "h",
    "M": "m",
    "S": "s",
    "f": "SSSSSS",
    "p": "a",
    "b": "MMM",
    "B": "MMMM",
    "a": "EEE",
    "A": "EEEE",
    "j": "D",
    "z": "Z",
    "Z": "z",
}


def strptime_to_java(fmt: str) -> str:
    """Translate a strptime format into a Spark datetime pattern.

    Literal text is quoted so letters in it are not read as pattern letters.
    """
    out: list[str] = []
    literal: list[str] = []

    def flush():
        if literal:
            text = "".join(literal).replace("'", "''")
            if any(ch.isalpha() for ch in text) or "'" in text:
                out.append(f"'{text}'")
            else:
                out.append(text)
            literal.clear()

    i = 0
    while i < len(fmt):
        ch = fmt[i]
        if ch == "%" and i + 1 < len(fmt):
            code = fmt[i + 1]
            if code == "%":
                literal.append("%")
            elif code in _DIRECTIVES:
                flush()
                out.append(_DIRECTIVES[code])
            else:
                raise ValueError(f"unsupported strptime directive %{code}")
            i += 2
            continue
        literal.append(ch)
        i += 1
    flush()
    return "".join(out)


def _has_two_digit_year(pattern: str) -> bool:
    stripped = pattern.replace("''", "")
    parts = stripped.split("'")
    letters = "".join(parts[::2])  # text outside quotes
    return "yy" in letters and "yyyy" not in letters


def _fix_century_ts(ts: Column) -> Column:
    # strptime reads 69-99 as 1969-1999; Spark's 'yy' reads them as 2069-2099.
    return F.when(
        F.year(ts) >= C.TWO_DIGIT_YEAR_PIVOT, F.timestamp_add("YEAR", F.lit(-100), ts)
    ).otherwise(ts)


def _fix_century_date(d: Column) -> Column:
    return F.when(F.year(d) >= C.TWO_DIGIT_YEAR_PIVOT, F.add_months(d, -1200)).otherwise(d)


def parse_timestamp_ntz(text: Column, pattern: str) -> Column:
    """Text -> TIMESTAMP_NTZ by a Java pattern; unparseable -> null.

    ``try_to_timestamp`` guards ``to_timestamp_ntz`` so invalid text never
    raises under ANSI mode, and the value is read as wall-clock time with no
    session time-zone shift.
    """
    pat = F.lit(pattern)
    ok = F.try_to_timestamp(text, pat).isNotNull()
    ts = F.when(ok, F.to_timestamp_ntz(text, pat))
    return _fix_century_ts(ts) if _has_two_digit_year(pattern) else ts


def parse_date(text: Column, pattern: str) -> Column:
    """Text -> DATE by a Java pattern; unparseable -> null."""
    d = F.to_date(F.try_to_timestamp(text, F.lit(pattern)))
    return _fix_century_date(d) if _has_two_digit_year(pattern) else d


def date_pattern(named_format: str | None) -> str:
    return C.DATE_FORMATS[named_format or C.DEFAULT_DATE_FORMAT]


def datetime_pattern(named_format: str | None) -> str:
    return C.DATETIME_FORMATS[named_format or C.DEFAULT_DATETIME_FORMAT]


# Patterns tried, in order, when a date or datetime column has no declared
# format: one is chosen per column from its first non-null value (see
# casts.guess_date_pattern).  Month-first readings come before day-first ones.
_GUESS_DAYS = (
    "yyyy-M-d",
    "M/d/yyyy",
    "d/M/yyyy",
    "yyyy/M/d",
    "M-d-yyyy",
    "d-M-yyyy",
    "d.M.yyyy",
    "yyyy.M.d",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "yyyyMMdd",
)
_GUESS_TIMES = ("H:m:s", "H:m", "H:m:s.SSSSSS", "H:m:s.SSS")
GUESS_PATTERNS = (
    *_GUESS_DAYS,
    *(f"{day} {time}" for time in _GUESS_TIMES for day in _GUESS_DAYS),
    *(f"yyyy-M-d'T'{time}{zone}" for zone in ("", "'Z'", "XXX") for time in _GUESS_TIMES),
    *(f"yyyy-M-d {time}XXX" for time in _GUESS_TIMES),
)

# Patterns that the profile's date test tries on sampled values, besides its
# fixed formats.
PROFILE_PATTERNS = (
    "yyyy-M-d",
    "yyyy-M-d H:m:s",
    "yyyy-M-d'T'H:m:s",
    "yyyy-M-d H:m:s.SSSSSS",
    "yyyy-M-d'T'H:m:s.SSSSSS",
    "yyyy-M-d'T'H:m:s'Z'",
    "M/d/yyyy",
    "yyyy/M/d",
    "d.M.yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "d MMM yyyy",
    "yyyyMMdd",
)
