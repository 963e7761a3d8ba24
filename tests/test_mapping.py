import datetime as dt

import pytest

from sluice.operators.mapping import MappingError, apply_mappings, auto_mappings, merge_mappings
from sluice.specs import ColumnMapping, SpecError


def one_col(spark, values, dtype="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")


def mapped(spark, values, mapping, dtype="string", **kw):
    res = apply_mappings(one_col(spark, values, dtype), [mapping], **kw)
    name = mapping.final_name
    return [r[name] for r in res.df.orderBy("i").collect()], res


def test_integer_cleanup(spark):
    out, _ = mapped(spark, ["1", "2", "$1,000", " $2,500 ", None, "abc", "1e3"], ColumnMapping("v", "integer"))
    assert out == [1, 2, 1000, 2500, None, None, 1000]


def test_integer_fraction_fails_whole_column(spark):
    with pytest.raises(MappingError) as err:
        mapped(spark, ["1", "2.5"], ColumnMapping("v", "integer"))
    assert "have a fraction" in str(err.value)
    # warn / report keep the source values and continue
    out, res = mapped(spark, ["1", "2.5"], ColumnMapping("v", "integer"), on_error="report")
    assert out == ["1", "2.5"] and len(res.errors) == 1


def test_float_accepts_only_number_text(spark):
    out, _ = mapped(spark, ["3.5", "$1,234.50", "1d", "5f", "nan", "1e3", " 7 ", "x"], ColumnMapping("v", "float"))
    assert out == [3.5, 1234.5, None, None, None, 1000.0, 7.0, None]


def test_decimal_rounds_half_even(spark):
    out, _ = mapped(spark, [3.14159, 0.125, 0.375, None], ColumnMapping("v", "decimal"), dtype="double")
    assert out == [3.14, 0.12, 0.38, None]


def test_string_truncation_and_text_form(spark):
    out, _ = mapped(spark, ["HelloWorld", None], ColumnMapping("v", "string", max_length=5))
    assert out == ["Hello", None]
    out, _ = mapped(spark, [1.5, None], ColumnMapping("v", "text"), dtype="double")
    assert out == ["1.5", None]
    with pytest.raises(SpecError):
        ColumnMapping("v", "integer", max_length=3)


def test_boolean_tokens(spark):
    vals = ["true", "yes", "1", "True", "YES", " t ", "y", "false", "no", "0", "False", "NO", "f", "n", "maybe", None]
    out, _ = mapped(spark, vals, ColumnMapping("v", "boolean"))
    assert out == [True] * 7 + [False] * 7 + [None, None]


@pytest.mark.parametrize(
    "fmt, values, expected",
    [
        ("YYYY-MM-DD", ["2024-01-15", "2023-6-3", "not-a-date", "2023-02-30"],
         [dt.date(2024, 1, 15), dt.date(2023, 6, 3), None, None]),
        ("YY-MM-DD", ["68-01-05", "69-01-05", "99-12-31"], [dt.date(2068, 1, 5), dt.date(1969, 1, 5), dt.date(1999, 12, 31)]),
        ("DD-MM-YYYY", ["15-01-2024", "1-2-2024"], [dt.date(2024, 1, 15), dt.date(2024, 2, 1)]),
        ("DD/MM/YY", ["05/01/69", "5/1/00"], [dt.date(1969, 1, 5), dt.date(2000, 1, 5)]),
        ("MMM DD, YYYY", ["Jan 05, 2024", "feb 5, 2024"], [dt.date(2024, 1, 5), dt.date(2024, 2, 5)]),
        ("MMMM DD, YYYY", ["January 05, 2024"], [dt.date(2024, 1, 5)]),
    ],
)
def test_dates(spark, fmt, values, expected):
    out, _ = mapped(spark, values, ColumnMapping("v", "date", date_format=fmt))
    assert out == expected


def test_date_without_format_guesses_per_column(spark):
    out, _ = mapped(spark, ["01/15/2024", "02/01/2024", "bad"], ColumnMapping("v", "date"), order_by="i")
    assert out == [dt.date(2024, 1, 15), dt.date(2024, 2, 1), None]


@pytest.mark.parametrize(
    "fmt, text, expected",
    [
        ("YYYY-MM-DD HH:MM:SS", "2024-01-15 10:20:30", dt.datetime(2024, 1, 15, 10, 20, 30)),
        ("DD-MM-YYYY HH:MM:SS", "15-01-2024 10:20:30", dt.datetime(2024, 1, 15, 10, 20, 30)),
        ("MM-DD-YYYY HH:MM:SS", "01-15-2024 10:20:30", dt.datetime(2024, 1, 15, 10, 20, 30)),
        ("YYYY-MM-DDTHH:MM:SS", "2024-01-15T10:20:30", dt.datetime(2024, 1, 15, 10, 20, 30)),
        ("ISO8601", "2024-01-15T10:20:30Z", dt.datetime(2024, 1, 15, 10, 20, 30)),
        ("ISO8601", "garbage", None),
    ],
)
def test_datetimes(spark, fmt, text, expected):
    out, res = mapped(spark, [text], ColumnMapping("v", "datetime", datetime_format=fmt))
    assert out == [expected]
    assert res.df.schema["v"].dataType.simpleString() == "timestamp_ntz"


def test_default_and_not_null(spark):
    out, _ = mapped(spark, [1.0, None, 3.0], ColumnMapping("v", "float", is_nullable=False, default_value=0),
                    dtype="double")
    assert out == [1.0, 0.0, 3.0]
    with pytest.raises(MappingError) as err:
        mapped(spark, [1.0, None, None], ColumnMapping("v", "float", is_nullable=False), dtype="double")
    assert "2 NULL value(s)" in str(err.value)


def test_rename_prefix_suffix_and_passthrough(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "id int, name string, amt double")
    out = apply_mappings(
        df,
        [ColumnMapping("name", "string", rename_to="label", prefix="p_"), ColumnMapping("amt", "float", suffix="_usd")],
    ).df
    assert out.columns == ["id", "p_label", "amt_usd"]


def test_missing_column_is_reported_others_continue(spark):
    df = spark.createDataFrame([("5",)], "a string")
    res = apply_mappings(df, [ColumnMapping("nope", "integer"), ColumnMapping("a", "integer")], on_error="warn")
    assert res.df.first()["a"] == 5
    assert res.errors[0] == {"column": "nope", "error": "no such column in the input"}


def test_auto_mappings_and_merge(spark):
    df = spark.createDataFrame([(1, 2.0, "x", True)], "a bigint, b double, c string, d boolean")
    auto = auto_mappings(df)
    assert [m.target_dtype for m in auto] == ["bigint", "float", "text", "boolean"]
    merged = merge_mappings([ColumnMapping("b", "decimal")], auto)
    assert [m.column_name for m in merged] == ["b", "a", "c", "d"]
    assert merged[0].target_dtype == "decimal"


@pytest.mark.parametrize("text, day", [
    ("25/12/2024", "2024-12-25"), ("15-01-2024", "2024-01-15"), ("2024.01.15", "2024-01-15"),
    ("2024-01-15T10:00:00+00:00", "2024-01-15"), ("01/15/2024 10:00:00", "2024-01-15"), ("2024-01-15", "2024-01-15"),
])
def test_dates_without_a_format_are_guessed_for_every_target(spark, text, day):
    df = spark.createDataFrame([(1, text), (2, None)], "k int, d string")
    for target in ("date", "datetime", "timestamp"):
        got = apply_mappings(df, [ColumnMapping("d", target)], order_by="k").df.orderBy("k").collect()
        assert str(got[0]["d"])[:10] == day and got[1]["d"] is None
    if "10:00" in text:
        assert apply_mappings(df, [ColumnMapping("d", "datetime")], order_by="k").df.first()["d"].hour == 10


def test_a_date_that_no_format_fits_is_a_column_error(spark):
    df = spark.createDataFrame([(1, "soon")], "k int, d string")
    res = apply_mappings(df, [ColumnMapping("d", "date")], on_error="report")
    assert [e["column"] for e in res.errors] == ["d"] and res.df.first()["d"] == "soon"
