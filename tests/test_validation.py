import pytest
from pyspark.sql import functions as F

from sluice.operators.keys import mark_repeats
from sluice.operators.validation import quarantine_rows, validate
from sluice.specs import ValidationRule


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(
        [(1, "Alice", 100, "a@b.com"), (2, None, 85, "bad-email"), (2, "Charlie", 200, "c@d.com"), (3, "Dave", 50, "e@f.com")],
        "id int, name string, score int, email string",
    ).withColumn("pos", F.monotonically_increasing_id())


def bad_rows(frame, rule, order="pos"):
    res = validate(frame, [rule], order_by=order)
    return sorted(r["row_id"] for r in res.errors.collect()), res


def test_one_bad_row_per_rule(frame):
    ids = {r["pos"]: r["name"] for r in frame.collect()}
    assert [ids[i] for i in bad_rows(frame, ValidationRule("name", "not_null"))[0]] == [None]
    assert [ids[i] for i in bad_rows(frame, ValidationRule("id", "unique"))[0]] == ["Charlie"]
    assert [ids[i] for i in bad_rows(frame, ValidationRule("score", "min_value", {"min": 60}))[0]] == ["Dave"]
    assert [ids[i] for i in bad_rows(frame, ValidationRule("score", "max_value", {"max": 150}))[0]] == ["Charlie"]
    assert [ids[i] for i in bad_rows(frame, ValidationRule("email", "email"))[0]] == [None]


def test_valid_plus_invalid_is_total(frame):
    res = validate(frame, [ValidationRule("name", "not_null"), ValidationRule("id", "unique"),
                           ValidationRule("score", "max_value", {"max": 150})], order_by="pos")
    assert res.valid.count() == 2 and res.invalid.count() == 2
    # a row failing several rules is one invalid row with several errors
    assert res.errors.count() == 3


def test_regex_allowed_length(spark):
    df = spark.createDataFrame([("ABC-123", "active", 1), ("bad", "deleted", 2), ("XYZ-999", None, 3), (None, "inactive", 4)],
                               "code string, status string, k int")
    res = validate(df, [ValidationRule("code", "regex", {"pattern": r"[A-Z]{3}-\d{3}"})], order_by="k")
    assert sorted(r["row_id"] for r in res.errors.collect()) == [2, 4]  # null fails a regex
    res = validate(df, [ValidationRule("status", "allowed_values", {"values": ["active", "inactive"]})], order_by="k")
    assert sorted(r["row_id"] for r in res.errors.collect()) == [2, 3]
    res = validate(df, [ValidationRule("code", "min_length", {"min_length": 4})], order_by="k")
    assert sorted(r["row_id"] for r in res.errors.collect()) == [2]  # null never fails a length rule
    res = validate(df, [ValidationRule("code", "max_length", {"max_length": 3})], order_by="k")
    assert sorted(r["row_id"] for r in res.errors.collect()) == [1, 3]


def test_date_format_and_numeric(spark):
    df = spark.createDataFrame([(1, "2024-01-05", "12"), (2, "05/01/2024", "1,000"), (3, None, None), (4, "2024-1-5", "nan")],
                               "k int, d string, n string")
    res = validate(df, [ValidationRule("d", "date_format", {"format": "%Y-%m-%d"})], order_by="k")
    assert sorted(r["row_id"] for r in res.errors.collect()) == [2]
    res = validate(df, [ValidationRule("n", "numeric")], order_by="k")
    assert sorted(r["row_id"] for r in res.errors.collect()) == [2, 4]


def test_error_records_and_quarantine_text(frame):
    res = validate(frame, [ValidationRule("name", "not_null", error_message="name required"),
                           ValidationRule("email", "email")], order_by="pos")
    errs = res.errors.collect()
    assert {(e["column"], e["rule"], e["message"]) for e in errs} == {
        ("name", "not_null", "name required"), ("email", "email", "Failed rule 'email' on column 'email'")}
    q = quarantine_rows(res).collect()
    assert len(q) == 1
    assert q[0]["_validation_errors"] == "name: name required; email: Failed rule 'email' on column 'email'"


def test_unknown_column_and_no_rules(frame):
    res = validate(frame, [ValidationRule("nope", "not_null")], order_by="pos")
    assert res.valid.count() == 4 and res.invalid.count() == 0
    res = validate(frame, [], order_by="pos")
    assert res.valid.count() == 4


def test_unique_with_nulls_counts_them_as_equal(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, None), (4, "a"), (5, "b")], "k int, v string")
    res = validate(df, [ValidationRule("v", "unique")], order_by="k")
    assert sorted(r["row_id"] for r in res.errors.collect()) == [3, 4]


def test_unique_with_a_hot_key_matches_brute_force(spark):
    # one value holds a third of the rows, nulls hold another large share
    n = 3000
    data = [(i, "hot" if i % 3 == 0 else (None if i % 7 == 0 else f"v{i % 50}")) for i in range(n)]
    df = spark.createDataFrame(data, "k long, v string")
    first = {}
    for k, v in data:
        first.setdefault(v, k)
    marked = mark_repeats(df, ["v"], "k", "again").collect()
    assert len(marked) == n
    assert all(r["again"] == (first[r["v"]] != r["k"]) for r in marked)
    res = validate(df, [ValidationRule("v", "unique")], order_by="k")
    expected = sorted(k for k, v in data if first[v] != k)
    assert sorted(r["row_id"] for r in res.errors.collect()) == expected


def test_repeats_join_on_key_and_order_so_a_hot_key_spreads(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(i, "hot") for i in range(4000)], "k long, v string")
        marked = mark_repeats(df, ["v"], "k", "again")
        plan = marked._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    smj = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert smj and "k#" in smj[0].split("[")[1] and "v#" in smj[0].split("[")[1]
    parts = df.repartition(8, "v", "k").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) <= 2 * 4000 / 8


def test_ties_in_the_order_column_flag_all_but_one(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, "a"), (1, "b"), (None, "c"), (None, "c")], "k int, v string")
    res = validate(df, [ValidationRule("v", "unique")], order_by="k")
    assert res.invalid.count() == 4 and res.valid.count() == 3
