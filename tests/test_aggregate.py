import random
import statistics

import pytest

from sluice.operators.aggregate import aggregate
from sluice.operators.median import exact_median
from sluice.specs import AggregationRule, SpecError


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(
        [("eng", 100, 1), ("eng", 120, 2), ("sales", 80, 3), ("sales", 90, 4)], "dept string, salary int, id int"
    )


def agg(df, *aggs, keys=("dept",), order_by=None):
    out = aggregate(df, {"group_by": list(keys), "aggregations": list(aggs)}, order_by=order_by)
    return [r.asDict() for r in out.collect()]


def test_sum_mean_count(frame):
    out = agg(frame, {"column": "salary", "function": "sum", "alias": "total"},
              {"column": "salary", "function": "mean"}, {"column": "id", "function": "count"})
    assert out == [
        {"dept": "eng", "total": 220, "mean_salary": 110.0, "count_id": 2},
        {"dept": "sales", "total": 170, "mean_salary": 85.0, "count_id": 2},
    ]


def test_several_functions_on_one_column_all_kept(frame):
    out = agg(frame, {"column": "salary", "function": "min"}, {"column": "salary", "function": "max"},
              {"column": "salary", "function": "count_distinct"}, {"column": "salary", "function": "median"})
    assert out[0] == {"dept": "eng", "min_salary": 100, "max_salary": 120, "count_distinct_salary": 2,
                      "median_salary": 110.0}


def test_null_keys_dropped_and_all_null_group(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, 5.0), ("b", 2.0)], "k string, v double")
    out = agg(df, {"column": "v", "function": "sum"}, {"column": "v", "function": "count"},
              {"column": "v", "function": "size"}, {"column": "v", "function": "median"},
              {"column": "v", "function": "prod"}, keys=("k",))
    assert out == [
        {"k": "a", "sum_v": 0.0, "count_v": 0, "size_v": 2, "median_v": None, "prod_v": 1.0},
        {"k": "b", "sum_v": 2.0, "count_v": 1, "size_v": 1, "median_v": 2.0, "prod_v": 2.0},
    ]


def test_first_last_std_var(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "x", 3.0), (3, "x", 5.0), (4, "x", None), (5, "y", 1.0)],
                               "o int, k string, v double")
    out = agg(df, {"column": "v", "function": "first"}, {"column": "v", "function": "last"},
              {"column": "v", "function": "std"}, {"column": "v", "function": "var"}, keys=("k",), order_by="o")
    assert out[0]["first_v"] == 3.0 and out[0]["last_v"] == 5.0
    assert out[0]["var_v"] == pytest.approx(2.0) and out[0]["std_v"] == pytest.approx(2.0 ** 0.5)
    assert out[1]["std_v"] is None  # one value: sample deviation undefined


def test_exact_median_with_hot_group_matches_statistics(spark):
    rnd = random.Random(7)
    data = [("hot" if i % 3 else f"g{i % 11}", rnd.uniform(-1e3, 1e3)) for i in range(5000)]
    data += [("hot", float("nan")), ("hot", None), ("solo", 4.0), ("pair", 1.0), ("pair", 2.0)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r["k"]: r["median"] for r in exact_median(df, "v", ["k"]).collect()}
    groups = {}
    for k, v in data:
        if v is not None and v == v:
            groups.setdefault(k, []).append(v)
    for k, vs in groups.items():
        assert got[k] == pytest.approx(statistics.median(vs), rel=1e-12, abs=1e-9)
    assert got.keys() == groups.keys()
    whole = exact_median(df, "v").first()["median"]
    assert whole == pytest.approx(statistics.median([v for vs in groups.values() for v in vs]))


def test_median_where_one_value_holds_most_rows(spark):
    data = [("a", 5.0)] * 900 + [("a", float(i)) for i in range(300)] + [("b", 1.0), ("b", 1.0), ("b", 2.0), ("b", 9.0)]
    df = spark.createDataFrame(data, "k string, v double").repartition(6)
    got = {r["k"]: r["median"] for r in exact_median(df, "v", ["k"]).collect()}
    assert got == {"a": 5.0, "b": 1.5}


def test_rule_checks():
    with pytest.raises(SpecError):
        AggregationRule([], [{"column": "a", "function": "sum"}])
    with pytest.raises(SpecError):
        AggregationRule(["k"], [{"column": "a", "function": "mode"}])


def test_nan_is_skipped_like_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 3.0), (None, 1.0)], "k string, v double")
    out = agg(df, {"column": "v", "function": "sum"}, {"column": "v", "function": "max"},
              {"column": "v", "function": "count"}, {"column": "v", "function": "mean"}, keys=("k",))
    assert out == [{"k": "a", "sum_v": 4.0, "max_v": 3.0, "count_v": 2, "mean_v": 2.0}]
    keyed = spark.createDataFrame([(float("nan"), 1), (1.0, 2)], "k double, v int")
    assert [r["k"] for r in aggregate(keyed, {"group_by": ["k"], "aggregations": [{"column": "v", "function": "sum"}]}).collect()] == [1.0]
