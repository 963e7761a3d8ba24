import datetime
import random

import pytest
from pyspark.sql import functions as F

from sluice.operators import distinct as D
from sluice.operators.aggregate import aggregate
from sluice.operators.profile import column_profile, top_values


@pytest.fixture
def frame(spark):
    rnd = random.Random(5)
    rows = []
    for k in range(3000):
        g = rnd.choice([1, 1, 1, 1, 2, 3])
        rows.append((g, rnd.choice([None, "a", "b" * rnd.randint(1, 40), "é"]), rnd.choice([None, 0.0, -0.0, float("nan"), rnd.random()]),
                     rnd.randint(0, 50), k, datetime.datetime(2024, 1, 1 + rnd.randint(0, 20)), [rnd.randint(0, 3)], rnd.random() < 0.5))
    return spark.createDataFrame(rows, "g int, t string, f double, i int, k long, d timestamp, a array<int>, b boolean").repartition(5)


COLUMNS = ["t", "f", "i", "k", "d", "b"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [40, 1 << 18])
def test_counts_equal_count_distinct(frame, monkeypatch, most):
    monkeypatch.setattr(D, "SET_VALUES", most)
    clean = frame.withColumn("f", F.when(~F.isnan("f"), F.col("f")))
    want = clean.agg(*[F.count_distinct(c) for c in COLUMNS]).first()
    got = D.distinct_counts(frame, COLUMNS)
    assert tuple(got.first()) == tuple(want) and "Expand" not in plan_of(got)
    by_group = {r["g"]: tuple(r)[1:] for r in D.distinct_counts(frame, COLUMNS, ["g"]).collect()}
    assert by_group == {r["g"]: tuple(r)[1:] for r in clean.groupBy("g").agg(*[F.count_distinct(c) for c in COLUMNS]).collect()}
    assert D.distinct_counts(frame, ["a"]).first()[0] == 4


def test_empty_tables_and_columns_of_nulls(frame, spark):
    assert tuple(D.distinct_counts(frame.limit(0), ["t", "i"]).first()) == (0, 0)
    nulls = spark.range(5).select(F.lit(None).cast("string").alias("t"), "id")
    assert tuple(D.distinct_counts(nulls, ["t", "id"]).first()) == (0, 5)


def test_sketches_of_parts_put_together_are_close(spark):
    frame = spark.range(60_000).select((F.col("id") % 7).alias("p"), (F.col("id") % 20_000).alias("v"), F.col("id").cast("string").alias("t"))
    sketches = D.distinct_sketches(frame, ["v", "t"], ["p"])
    got = {r["column_name"]: r["distinct"] for r in D.sketched_counts(sketches).collect()}
    assert abs(got["v"] - 20_000) < 1000 and abs(got["t"] - 60_000) < 3000


def test_profiles_and_aggregations_without_expand(frame):
    assert "Expand" not in plan_of(column_profile(frame.drop("a"), order_by="k"))
    rule = {"group_by": ["g"], "aggregations": [{"column": c, "function": "count_distinct", "alias": f"n_{c}"} for c in ("t", "i", "f")]}
    got = aggregate(frame, rule | {"aggregations": [*rule["aggregations"], {"column": "k", "function": "max", "alias": "m"}]})
    assert "Expand" not in plan_of(got) and got.columns == ["g", "n_t", "n_i", "n_f", "m"]
    clean = frame.withColumn("f", F.when(~F.isnan("f"), F.col("f")))
    want = clean.groupBy("g").agg(*[F.count_distinct(c) for c in ("t", "i", "f")], F.max("k")).orderBy("g").collect()
    assert list(map(tuple, got.collect())) == list(map(tuple, want))


def top(values, k):
    counts = {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
    return sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:k]


@pytest.mark.parametrize("kind,how", [("few", "summaries"), ("skewed", "candidates"), ("even", "all")])
def test_top_values_by_summaries(spark, kind, how):
    rnd = random.Random(9)
    values = {"few": [f"v{rnd.randint(0, 30)}" for _ in range(3000)],
              "skewed": [f"h{rnd.randint(0, 9)}" if rnd.random() < 0.7 else f"x{k}" for k in range(3000)],
              "even": [f"e{rnd.randint(0, 900)}" for _ in range(3000)]}[kind]
    frame = spark.createDataFrame([(v,) for v in values], "v string").repartition(4)
    got, found = D.heavy_values(frame, 7, counters=60)
    assert found == how and list(map(tuple, got.collect())) == top(values, 7)


def test_top_values_of_other_types(frame):
    want = [(str(v), n) for v, n in sorted(
        {v: n for v, n in frame.groupBy("i").count().collect()}.items(), key=lambda x: (-x[1], str(x[0])))[:4]]
    assert list(map(tuple, top_values(frame, "i", 4).collect())) == want
    assert top_values(frame.limit(0), "i", 4).count() == 0
