import datetime as dt
import glob
import json
import os
import tempfile
import time
import uuid

import pytest

from sluice.plans import jobs, ledger
from sluice.sinks import files as fsink
from sluice.sinks.jdbc import LoadError, load_table
from sluice.sinks.rest import send_batches, send_summary
from sluice.sources import jdbc
from sluice.specs import (ApiDestination, ColumnMapping, DatabaseConnection, DatabaseDestination,
                          DatabaseSource, FileDestination, JobSpec)
from sluice.streaming.folder import read_outputs, watch_folder


def tmpdir():
    return tempfile.mkdtemp(prefix="sluice-test-")


# JDBC round trips need a database.  The only driver shipped with Spark is
# embedded Derby; starting even an in-process database is opt-in, so these
# run only with SLUICE_JDBC_TESTS=1.
needs_db = pytest.mark.skipif(os.environ.get("SLUICE_JDBC_TESTS") != "1",
                              reason="database tests are opt-in (SLUICE_JDBC_TESTS=1)")


@pytest.fixture
def derby():
    return DatabaseConnection(url=f"jdbc:derby:memory:db{uuid.uuid4().hex[:8]};create=true", dialect="derby",
                              driver="org.apache.derby.jdbc.EmbeddedDriver")


@pytest.fixture
def users(spark):
    return spark.createDataFrame([(1, "Alice", 95.5), (2, "Bob", 82.0)], "id int, name string, score double")


def db_rows(spark, conn, table):
    return jdbc.read_db(spark, DatabaseSource(connection=conn, table_name=table)).count()


def test_file_writes_report_rows_and_bytes(spark, users):
    d = tmpdir()
    for fmt in ("csv", "parquet"):
        rep = fsink.write_file(users, FileDestination(fmt, os.path.join(d, f"out_{fmt}")))
        assert rep["rows_written"] == 2 and rep["file_size_bytes"] > 0
    back = spark.read.option("header", True).csv(os.path.join(d, "out_csv"))
    assert back.columns == ["id", "name", "score"] and back.count() == 2


@needs_db
@pytest.mark.parametrize("atomic", [True, False])
def test_db_load_modes(spark, users, derby, atomic):
    dest = lambda mode: DatabaseDestination(connection=derby, table_name="users", if_exists=mode, atomic=atomic)
    maps = [ColumnMapping("id", "integer", is_primary_key=True), ColumnMapping("score", "decimal")]
    rep = load_table(users, dest("fail"), maps)
    assert rep["rows_inserted"] == 2 and db_rows(spark, derby, "users") == 2
    with pytest.raises(LoadError):
        load_table(users, dest("fail"), maps)
    load_table(users, dest("append"), [])
    assert db_rows(spark, derby, "users") == 4
    load_table(users, dest("replace"), maps)
    assert db_rows(spark, derby, "users") == 2
    # no staging table is left behind
    assert [r["table_name"] for r in jdbc.list_tables(spark, derby).collect()] == ["USERS"]


@needs_db
def test_db_key_check_and_index(spark, derby):
    dup = spark.createDataFrame([(1, "a"), (1, "b")], "id int, name string")
    with pytest.raises(LoadError):
        load_table(dup, DatabaseDestination(connection=derby, table_name="t"), [ColumnMapping("id", "integer", is_unique=True)])
    ok = spark.createDataFrame([(1, 2.0), (2, float("nan"))], "id int, v double")
    rep = load_table(ok, DatabaseDestination(connection=derby, table_name="t2", create_index=True, index_columns=["id"]))
    assert rep["index_created"] is True
    vals = [r["v"] for r in jdbc.read_db(spark, DatabaseSource(connection=derby, table_name="t2")).collect()]
    assert sorted(vals, key=lambda v: (v is None, v)) == [2.0, None]  # NaN never reaches the database


def body_files(d):
    """A transport that writes each body to a file of its own."""
    def send(method, url, body, headers):
        import os
        import uuid

        with open(os.path.join(d, f"batch-{uuid.uuid4().hex}.json"), "w") as fh:
            fh.write(body)
        return 200

    return send


def test_rest_sink_batches(spark):
    d = tmpdir()
    df = spark.range(0, 25).selectExpr("id", "cast(id * 2 as double) as v").repartition(2)
    report = send_batches(df, ApiDestination(url="http://unused", batch_size=10, records_key="data"), body_files(d))
    summary = send_summary(report)
    assert summary == {"total_records": 25, "sent": 25, "failed": 0, "failed_batches": 0, "errors": []}
    sent = []
    for p in glob.glob(os.path.join(d, "batch-*.json")):
        body = json.load(open(p))
        assert len(body["data"]) <= 10
        sent += [r["id"] for r in body["data"]]
    assert sorted(sent) == list(range(25))


def test_rest_sink_reports_failures(spark):
    def failing_transport(method, url, body, headers):  # nested: shipped to workers by value
        return 503

    df = spark.range(0, 5)
    report = send_batches(df.coalesce(1), ApiDestination(url="http://unused", batch_size=2), failing_transport,
                          max_retries=2)
    assert send_summary(report) == {"total_records": 5, "sent": 0, "failed": 5, "failed_batches": 3,
                                    "errors": ["HTTP 503"]}


def write_csv(path, text):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)
    return path


def test_run_job_end_to_end(spark):
    d = tmpdir()
    src = write_csv(os.path.join(d, "in.csv"), "id,name,score\n1,Ann,90\n2,,80\n3,Cid,50\n4,Dee,70\n")
    spec = JobSpec(
        file_source={"path": src},
        filters=[{"column": "score", "operator": "gte", "value": 60}],
        column_mappings=[ColumnMapping("score", "float", rename_to="points")],
        validation_rules=[{"column": "name", "rule_type": "not_null"}],
        order_by="id",
        file_destination=FileDestination("parquet", os.path.join(d, "out")),
        quarantine_path=os.path.join(d, "bad"),
    )
    res = jobs.run_job(spark, spec, log_dir=os.path.join(d, "logs"), ledger_path=os.path.join(d, "ledger"))
    assert res["success"], res
    assert (res["total_rows"], res["processed_rows"], res["failed_rows"]) == (4, 2, 1)
    assert res["stage_rows"]["filtered"] == 3
    out = spark.read.parquet(os.path.join(d, "out"))
    assert sorted(out.columns) == ["id", "name", "points"] and out.count() == 2
    bad = spark.read.option("header", True).csv(os.path.join(d, "bad")).collect()
    assert bad[0]["_validation_errors"] == "name: Failed rule 'not_null' on column 'name'"
    summary = ledger.log_summary(ledger.read_logs(spark, os.path.join(d, "logs"))).first()
    assert summary["job_id"] == res["job_id"] and summary["errors"] == 0
    states = ledger.latest_states(spark, os.path.join(d, "ledger")).collect()
    assert [(s["job_id"], s["state"]) for s in states] == [(res["job_id"], "done")]


def test_mapping_error_fails_job(spark):
    d = tmpdir()
    src = write_csv(os.path.join(d, "in.csv"), "id,v\n1,1.5\n2,2\n")
    spec = JobSpec(file_source={"path": src}, column_mappings=[ColumnMapping("v", "integer")],
                   file_destination=FileDestination("csv", os.path.join(d, "out")))
    res = jobs.run_job(spark, spec)
    assert not res["success"] and "mapping failed" in res["message"]


def test_job_counts_are_those_of_the_write(spark):
    d = tmpdir()
    src = os.path.join(d, "in.parquet")
    rows = spark.range(20_000).selectExpr("id", "concat('2024-01-', lpad(id % 28 + 1, 2, '0')) AS day", "id % 15000 AS k")
    rows.repartition(6).write.parquet(src)
    spec = JobSpec(file_source={"path": src}, filters=[{"column": "id", "operator": "lt", "value": 18_000}],
                   column_mappings=[ColumnMapping("day", "date"), ColumnMapping("k", "integer")],
                   validation_rules=[{"column": "k", "rule_type": "unique"}], order_by="id",
                   file_destination=FileDestination("parquet", os.path.join(d, "out")))
    res = jobs.run_job(spark, spec)
    assert res["success"], res
    assert (res["total_rows"], res["processed_rows"], res["failed_rows"]) == (20_000, 15_000, 3_000)
    assert res["stage_rows"] == {"extracted": 20_000, "filtered": 18_000, "valid": 15_000}


def test_a_failed_integer_cast_leaves_the_column_when_errors_are_warnings(spark):
    d = tmpdir()
    src = write_csv(os.path.join(d, "in.csv"), "id,v\n1,1.5\n2,2\n")
    spec = JobSpec(file_source={"path": src}, column_mappings=[ColumnMapping("v", "integer")], on_error="warn",
                   file_destination=FileDestination("parquet", os.path.join(d, "out")))
    res = jobs.run_job(spark, spec)
    assert res["success"] and res["total_rows"] == 2 and res["log_summary"]["warnings"] == 1
    assert sorted(r["v"] for r in spark.read.parquet(os.path.join(d, "out")).collect()) == [1.5, 2.0]


def test_idempotent_submit_and_expiry(spark):
    d = tmpdir()
    src = write_csv(os.path.join(d, "in.csv"), "id\n1\n2\n")
    spec = JobSpec(file_source={"path": src}, file_destination=FileDestination("csv", os.path.join(d, "out")))
    led = os.path.join(d, "ledger")
    first = jobs.submit(spark, spec, led)
    second = jobs.submit(spark, spec, led)
    assert second["duplicate"] and second["job_id"] == first["job_id"]
    later = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) + dt.timedelta(hours=25)
    assert ledger.find_job(spark, led, ledger.request_hash(spec), now=later) is None
    reqs = spark.createDataFrame([(ledger.request_hash(spec),), ("other",)], "request_hash string")
    assert [r[0] for r in ledger.pending_requests(reqs, spark, led).collect()] == ["other"]


@needs_db
def test_migration_between_databases(spark, derby):
    users = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0), (3, "c", 3.0)], "id int, name string, score double")
    load_table(users, DatabaseDestination(connection=derby, table_name="src_users"))
    res = jobs.migrate(
        spark,
        DatabaseSource(connection=derby, table_name="src_users"),
        DatabaseDestination(connection=derby, table_name="dst_users"),
        filters=[{"column": "score", "operator": "gt", "value": 1.5}],
    )
    assert res["success"], res
    assert res["processed_rows"] == 2 and db_rows(spark, derby, "dst_users") == 2


@needs_db
def test_upload_file_to_table(spark, derby):
    d = tmpdir()
    src = write_csv(os.path.join(d, "typed.csv"), "id,name,score,active,joined\n1,A,1.5,yes,2024-01-02\n2,B,2.5,no,2024-02-03\n")
    maps = [ColumnMapping("active", "boolean"), ColumnMapping("joined", "date", date_format="YYYY-MM-DD")]
    rep = jobs.upload_file(spark, src, DatabaseDestination(connection=derby, table_name="typed"), maps)
    assert rep["rows_inserted"] == 2
    back = jdbc.read_db(spark, DatabaseSource(connection=derby, table_name="typed"))
    assert dict(back.dtypes)["joined"] == "date" and dict(back.dtypes)["active"] == "boolean"


def test_folder_stream_runs_each_file_once(spark):
    d = tmpdir()
    inbox = os.path.join(d, "inbox")
    os.makedirs(inbox)
    write_csv(os.path.join(inbox, "a.csv"), "id,score\n1,90\n2,40\n")
    write_csv(os.path.join(inbox, "b.csv"), "id,score\n3,70\n4,\n")
    spec = JobSpec(table_source="unused", file_destination=FileDestination("parquet", os.path.join(d, "x")),
                   column_mappings=[ColumnMapping("score", "float")],
                   filters=[{"column": "score", "operator": "gte", "value": 50}],
                   validation_rules=[{"column": "id", "rule_type": "unique"}], order_by="id")
    q = watch_folder(spark, inbox, ["id", "score"], spec, os.path.join(d, "out"), os.path.join(d, "ckpt"),
                     quarantine_dir=os.path.join(d, "bad"))
    q.awaitTermination(120)
    got = sorted(r["id"] for r in read_outputs(spark, os.path.join(d, "out")).collect())
    assert got == [1, 3]
    # a restart finds nothing new
    q2 = watch_folder(spark, inbox, ["id", "score"], spec, os.path.join(d, "out2"), os.path.join(d, "ckpt"))
    q2.awaitTermination(120)
    assert not os.path.exists(os.path.join(d, "out2"))


def test_ddl_types_and_key_checks_without_a_database(spark, users):
    from sluice.sinks.jdbc import RENAME_SQL, check_keys, column_types, quote

    maps = [ColumnMapping("id", "integer"), ColumnMapping("name", "string", rename_to="name"),
            ColumnMapping("score", "decimal")]
    assert column_types(users, maps, "postgresql") == "id INTEGER, name VARCHAR(255), score NUMERIC(18,2)"
    assert column_types(users, maps, "mysql") == "id INT, name VARCHAR(255), score DECIMAL(18,2)"
    assert column_types(users, maps, "derby") == "id INTEGER, score DECIMAL(18,2)"
    assert quote("a`b", "mysql") == "`a``b`" and quote('x"y', "postgresql") == '"x""y"'
    assert RENAME_SQL["postgresql"].format(old="s", new="t") == "ALTER TABLE s RENAME TO t"
    check_keys(users, [ColumnMapping("id", "integer", is_primary_key=True)])
    pairs = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "x"), (None, "x")], "p string, q string")
    both = [ColumnMapping("p", "text", is_primary_key=True), ColumnMapping("q", "text", is_primary_key=True)]
    check_keys(pairs.filter("p IS NOT NULL"), both)  # (a, x) and (a, y) are two keys
    with pytest.raises(LoadError) as err:
        check_keys(pairs.union(pairs), both)
    assert "p: 4 null" in str(err.value) and "p, q: 2 duplicate" in str(err.value)
    nulls = users.union(spark.createDataFrame([(None, "C", 1.0), (1, "D", 2.0)], users.schema))
    with pytest.raises(LoadError) as err:
        check_keys(nulls, [ColumnMapping("id", "integer", is_primary_key=True)])
    assert "1 null value(s)" in str(err.value) and "1 duplicate value(s)" in str(err.value)


def test_folder_stream_of_parquet_files(spark):
    d = tmpdir()
    inbox = os.path.join(d, "inbox")
    spark.createDataFrame([(1, 90.0), (2, 40.0), (3, 70.0)], "id long, score double").coalesce(1) \
        .write.parquet(inbox)
    spec = JobSpec(table_source="unused", file_destination=FileDestination("parquet", os.path.join(d, "x")),
                   filters=[{"column": "score", "operator": "gte", "value": 50}])
    q = watch_folder(spark, inbox, None, spec, os.path.join(d, "out"), os.path.join(d, "ckpt"), fmt="parquet")
    q.awaitTermination(120)
    assert sorted(r["id"] for r in read_outputs(spark, os.path.join(d, "out")).collect()) == [1, 3]


def test_text_key_check_uses_digest_but_stays_exact(spark):
    from sluice.sinks.jdbc import check_keys

    df = spark.createDataFrame([("a" * 500,), ("a" * 499 + "b",), ("a" * 500,)], "k string")
    with pytest.raises(LoadError) as err:
        check_keys(df, [ColumnMapping("k", "text", is_unique=True)])
    assert "1 duplicate value(s)" in str(err.value)


def test_clustered_tables_join_without_a_shuffle(spark):
    from sluice.sinks.jdbc import write_clustered_table

    suffix = uuid.uuid4().hex[:8]
    left = spark.range(0, 1000).selectExpr("id AS k", "id * 2 AS v")
    right = spark.range(0, 1000).selectExpr("id AS k", "id * 3 AS w")
    write_clustered_table(left, f"l_{suffix}", ["k"], 8)
    write_clustered_table(right, f"r_{suffix}", ["k"], 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table(f"l_{suffix}").join(spark.table(f"r_{suffix}"), "k")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_rest_sink_keeps_null_fields(spark):
    d = tmpdir()
    df = spark.createDataFrame([(1, None)], "id int, name string")
    send_summary(send_batches(df, ApiDestination(url="http://unused", batch_size=5), body_files(d)))
    body = json.load(open(glob.glob(os.path.join(d, "batch-*.json"))[0]))
    assert body == [{"id": 1, "name": None}]


def test_table_rules_and_swaps_by_dialect():
    from sluice.sinks.jdbc import constraint_statements, swap_statements

    maps = [ColumnMapping("a", "integer", is_primary_key=True), ColumnMapping("b", "string", is_primary_key=True),
            ColumnMapping("c", "string", is_unique=True, default_value="it's"), ColumnMapping("gone", "text", is_unique=True)]
    assert constraint_statements("t", ["a", "b", "c"], maps, "postgresql") == [
        'ALTER TABLE t ALTER COLUMN "a" SET NOT NULL', 'ALTER TABLE t ALTER COLUMN "b" SET NOT NULL',
        'ALTER TABLE t ALTER COLUMN "c" SET DEFAULT \'it\'\'s\'',
        'ALTER TABLE t ADD PRIMARY KEY ("a", "b")', 'ALTER TABLE t ADD UNIQUE ("c")']
    assert constraint_statements("t", ["a", "b", "c"], maps, "mysql")[0] == "ALTER TABLE t MODIFY COLUMN `a` INT NOT NULL"
    assert constraint_statements("t", ["a", "b"], maps, "sqlite") == ['CREATE UNIQUE INDEX "t_key0" ON t ("a", "b")']
    assert swap_statements("t", "s", True, "mysql") == ["RENAME TABLE t TO s_old, s TO t", "DROP TABLE s_old"]
    assert swap_statements("t", "s", True, "postgresql") == ["DROP TABLE t", "ALTER TABLE s RENAME TO t"]
    assert swap_statements("t", "s", False, "mysql") == ["RENAME TABLE s TO t"]
