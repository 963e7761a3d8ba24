import pytest
from pyspark.sql import functions as F

from sluice.functions.literals import LiteralTypeError
from sluice.operators.filters import apply_filters
from sluice.specs import FilterRule, SpecError


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(
        [(90, "Alice", "A"), (70, None, "B"), (50, "Charlie", "A"), (80, "Dave", "C"), (None, "Eve", None)],
        "score int, name string, tag string",
    )


def names(df):
    return sorted((r["name"] or "<null>") for r in df.collect())


def run(frame, *rules):
    return apply_filters(frame, [FilterRule(**r) for r in rules])


@pytest.mark.parametrize(
    "rule, expected",
    [
        ({"column": "tag", "operator": "eq", "value": "A"}, ["Alice", "Charlie"]),
        ({"column": "tag", "operator": "neq", "value": "A"}, ["<null>", "Dave", "Eve"]),
        ({"column": "score", "operator": "gt", "value": 70}, ["Alice", "Dave"]),
        ({"column": "score", "operator": "lt", "value": 70}, ["Charlie"]),
        ({"column": "score", "operator": "gte", "value": 70}, ["<null>", "Alice", "Dave"]),
        ({"column": "score", "operator": "lte", "value": 70}, ["<null>", "Charlie"]),
        ({"column": "name", "operator": "contains", "value": "^[AC]"}, ["Alice", "Charlie"]),
        ({"column": "name", "operator": "not_contains", "value": "^[AC]"}, ["<null>", "Dave", "Eve"]),
        ({"column": "name", "operator": "is_null"}, ["<null>"]),
        ({"column": "name", "operator": "is_not_null"}, ["Alice", "Charlie", "Dave", "Eve"]),
        ({"column": "tag", "operator": "in", "values": ["A", "C"]}, ["Alice", "Charlie", "Dave"]),
        ({"column": "tag", "operator": "not_in", "values": ["A", "C"]}, ["<null>", "Eve"]),
    ],
)
def test_each_operator_and_complement(frame, rule, expected):
    kept, dropped = run(frame, rule)
    assert names(kept) == expected
    # kept + dropped is always the whole input, nulls included
    assert sorted(names(kept) + names(dropped)) == names(frame)


def test_rules_are_anded(frame):
    kept, dropped = run(
        frame,
        {"column": "tag", "operator": "eq", "value": "A"},
        {"column": "score", "operator": "gt", "value": 60},
    )
    assert names(kept) == ["Alice"]
    assert len(names(dropped)) == 4


def test_unknown_column_is_ignored(frame):
    kept, dropped = run(frame, {"column": "missing", "operator": "eq", "value": 1})
    assert kept.count() == 5 and dropped.count() == 0


def test_no_rules(frame):
    kept, dropped = apply_filters(frame, [])
    assert kept.count() == 5 and dropped.count() == 0


def test_type_mismatch(frame):
    kept, _ = run(frame, {"column": "score", "operator": "eq", "value": "90"})
    assert kept.count() == 0
    kept, _ = run(frame, {"column": "score", "operator": "neq", "value": "90"})
    assert kept.count() == 5
    kept, _ = run(frame, {"column": "score", "operator": "in", "values": ["90", 90]})
    assert names(kept) == ["Alice"]
    with pytest.raises(LiteralTypeError):
        run(frame, {"column": "score", "operator": "gt", "value": "abc"})


def test_timestamp_column_takes_text_literal(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-03-01",)], "d string").select(
        F.to_timestamp("d").alias("ts")
    )
    kept, _ = apply_filters(df, [FilterRule("ts", "gte", "2024-02-01")])
    assert kept.count() == 1


def test_spec_checks():
    with pytest.raises(SpecError):
        FilterRule("a", "in")
    with pytest.raises(SpecError):
        FilterRule("a", "eq")
    with pytest.raises(SpecError):
        FilterRule("a", "like", "x")
    FilterRule("a", "is_null")


def test_kept_side_pushes_into_parquet_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    kept, _ = apply_filters(df, [FilterRule("o_totalprice", "gt", 1000), FilterRule("o_orderstatus", "eq", "F")])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)" in plan


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None), (4, 5.0)], "k int, v double")

    def ks(rule):
        kept, dropped = apply_filters(df, [FilterRule(**rule)])
        assert kept.count() + dropped.count() == 4
        return sorted(r["k"] for r in kept.collect())

    assert ks({"column": "v", "operator": "gt", "value": 2}) == [4]
    assert ks({"column": "v", "operator": "is_null"}) == [2, 3]
    assert ks({"column": "v", "operator": "neq", "value": 1.0}) == [2, 3, 4]
    assert ks({"column": "v", "operator": "not_in", "values": [5.0]}) == [1, 2, 3]
