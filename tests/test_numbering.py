import random

import pytest
from pyspark.sql import functions as F

from sluice.operators.numbering import equal_ranges, fill_keys, number_rows


def ntiles(values, k):
    values = sorted(v for v in values if v is not None)
    base, more = divmod(len(values), k)
    out, at = [], 0
    for i in range(k):
        size = base + (i < more)
        if size:
            out.append((i + 1, values[at], values[at + size - 1], size))
        at += size
    return out


def test_numbers_are_dense_and_in_order(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([7, 7, 7, None, rnd.randint(0, 400)]), k, "x") for k in range(3000)]
    frame = spark.createDataFrame(rows, "a int, b int, _rid string").repartition(5)
    got = sorted((r["n"], r["a"], r["b"]) for r in number_rows(frame, ["a", "b"], "n", 11).collect())
    order = sorted(((a, b) for a, b, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == [(11 + i, a, b) for i, (a, b) in enumerate(order)]


def test_hot_values_are_split_over_partitions(spark):
    frame = spark.range(4000).select(F.lit(1).alias("a"), F.col("id").alias("b"))
    numbered = number_rows(frame, "a", "n")
    assert sorted(r[0] for r in numbered.select("n").collect()) == list(range(1, 4001))
    assert numbered.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_numbers_stay_when_read_again(spark):
    frame = spark.range(500).select((F.rand(3) * 5).cast("int").alias("a"), "id")
    numbered = number_rows(frame, "a", "n")
    assert sorted(map(tuple, numbered.collect())) == sorted(map(tuple, numbered.collect()))


def test_missing_keys_go_on_from_the_largest(spark):
    frame = spark.createDataFrame([(None, "c"), (4, "a"), (None, "b"), (9, "d")], "id int, v string")
    filled = fill_keys(frame, "id", "v", 6)
    assert filled.schema == frame.schema
    assert sorted(map(tuple, filled.collect())) == [(4, "a"), (9, "d"), (10, "b"), (11, "c")]
    absent = fill_keys(frame.select("v"), "id", "v", 20).collect()
    assert sorted((r["id"], r["v"]) for r in absent) == [(21, "a"), (22, "b"), (23, "c"), (24, "d")]
    assert fill_keys(frame.limit(0), "id", "v").count() == 0


@pytest.mark.parametrize("k", [1, 2, 7, 50])
def test_ranges_equal_ntile(spark, k):
    rnd = random.Random(k)
    values = [rnd.choice([5, 5, 5, None, rnd.randint(0, 90)]) for _ in range(1234)]
    frame = spark.createDataFrame([(v, f"é{v:03d}" if v is not None else None) for v in values], "a int, t string").repartition(4)
    assert sorted(map(tuple, equal_ranges(frame, "a", k).collect())) == ntiles(values, k)
    texts = [f"é{v:03d}" for v in values if v is not None]
    assert sorted(map(tuple, equal_ranges(frame, "t", k).collect())) == ntiles(texts, k)


def test_fewer_rows_than_ranges_and_none(spark):
    frame = spark.createDataFrame([(3,), (1,), (None,)], "a int")
    assert sorted(map(tuple, equal_ranges(frame, "a", 5).collect())) == [(1, 1, 1, 1), (2, 3, 3, 1)]
    assert equal_ranges(frame.limit(0), "a", 5).count() == 0
    with pytest.raises(ValueError):
        equal_ranges(frame, "a", 0)


def test_append_goes_on_from_the_largest_key(spark, tmp_path):
    from sluice.sinks.keyed import append_keyed

    path = str(tmp_path / "target")
    first = append_keyed(spark.createDataFrame([("b",), ("a",)], "v string"), path, "id", "v")
    assert first == {"rows_written": 2, "first_key": 1, "last_key": 2}
    append_keyed(spark.createDataFrame([(None, "c"), (10, "d")], "id long, v string"), path, "id", "v")
    append_keyed(spark.createDataFrame([("e",)], "v string"), path, "id", "v")
    got = spark.read.parquet(path).select("id", "v").collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (2, "b"), (10, "d"), (11, "c"), (12, "e")]


def test_range_predicates_deal_each_row_once(spark):
    import datetime

    from sluice.sources.jdbc import range_predicates, sql_value

    rnd = random.Random(2)
    values = [rnd.choice([None, 5, 5, 5, rnd.randint(-50, 50)]) for _ in range(500)]
    lows = [low for _, low, _, _ in ntiles(values, 9)]
    frame = spark.createDataFrame([(v,) for v in values], "c int")
    counts = [frame.filter(p).count() for p in range_predicates("c", lows)]
    assert sum(counts) == 500 and len(counts) == len(set(lows)) + 1
    assert range_predicates("c", []) == ["1 = 1"] and range_predicates("c", ["x"]) == ["c IS NOT NULL", "c IS NULL"]
    assert sql_value("o'x") == "'o''x'" and sql_value(datetime.date(2024, 1, 2)) == "DATE '2024-01-02'"


def test_auto_increment_statements():
    from sluice.sinks.jdbc import auto_increment_statements
    from sluice.specs import ColumnMapping

    key = [ColumnMapping("id", "bigint", is_primary_key=True), ColumnMapping("v", "string")]
    assert "START WITH 8" in auto_increment_statements("t", key, "postgresql", 8)[0]
    assert "AUTO_INCREMENT" in auto_increment_statements("t", key, "mysql", 8)[0]
    assert auto_increment_statements("t", [ColumnMapping("id", "string", is_primary_key=True)], "mysql", 8) == []
    both = [ColumnMapping(c, "bigint", is_primary_key=True) for c in "ab"]
    assert auto_increment_statements("t", both, "mysql", 8) == []
