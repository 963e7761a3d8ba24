import json
import os
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from sluice.sources import files, jdbc, rest
from sluice.sources.payloads import drill
from sluice.specs import ApiSource, DatabaseConnection, DatabaseSource


def tmpdir():
    return tempfile.mkdtemp(prefix="sluice-test-")


def write(path, data: bytes):
    with open(path, "wb") as fh:
        fh.write(data)
    return path


def test_csv_inference_null_tokens_and_quoted_newline(spark):
    d = tmpdir()
    p = write(os.path.join(d, "people.csv"),
              b'id,name,score,active,notes\n1,Ann,90.5,True,"two\nlines"\n2,NA,80,False,x\n3,Bob,,True,n/a\n')
    df = files.read_csv(spark, p)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert types == {"id": "bigint", "name": "string", "score": "double", "active": "boolean", "notes": "string"}
    rows = sorted(df.collect(), key=lambda r: r["id"])
    assert rows[0]["notes"] == "two\nlines"
    assert rows[1]["name"] is None and rows[2]["score"] is None and rows[2]["notes"] is None


def test_csv_integer_with_missing_reads_as_float(spark):
    d = tmpdir()
    p = write(os.path.join(d, "n.csv"), b"a,b\n1,x\n,y\n3,z\n")
    assert files.read_csv(spark, p).schema["a"].dataType.simpleString() == "double"


def test_csv_latin1_fallback(spark):
    d = tmpdir()
    p = write(os.path.join(d, "latin.csv"), "name,city\nJoão,São Paulo\n".encode("latin-1"))
    row = files.read_csv(spark, p).first()
    assert row["name"] == "João" and row["city"] == "São Paulo"


def test_parquet_nan_to_null_and_dispatch(spark):
    d = tmpdir()
    path = os.path.join(d, "vals.parquet")
    spark.createDataFrame([(1.5,), (float("nan"),), (3.2,)], "val double").write.parquet(path)
    vals = sorted((r["val"] for r in files.scan(spark, path).collect()), key=lambda v: (v is None, v))
    assert vals == [1.5, 3.2, None]
    with pytest.raises(files.UnsupportedFileError):
        files.scan(spark, os.path.join(d, "x.txt"))


def test_list_files_filters_extensions(spark):
    d = tmpdir()
    write(os.path.join(d, "a.csv"), b"x\n1\n")
    write(os.path.join(d, "b.txt"), b"nope")
    write(os.path.join(d, "c.parquet"), b"not really parquet but listed")
    got = sorted((r["name"], r["extension"], r["size_bytes"]) for r in files.list_files(spark, d).collect())
    assert got == [("a.csv", ".csv", 4), ("c.parquet", ".parquet", 29)]


def test_an_output_in_parts_is_listed_as_one(spark):
    d = tmpdir()
    write(os.path.join(d, "a.csv"), b"x\n1\n")
    spark.range(40).repartition(4).write.option("header", True).csv(os.path.join(d, "b.CSV"))
    got = {r["name"]: r for r in files.list_files(spark, d, outputs=True).collect()}
    assert sorted(got) == ["a.csv", "b.CSV"] and got["b.CSV"]["extension"] == ".csv"
    parts = [f for f in os.listdir(os.path.join(d, "b.CSV")) if f.startswith("part-")]
    assert len(parts) == 4 and got["b.CSV"]["size_bytes"] == sum(os.path.getsize(os.path.join(d, "b.CSV", f)) for f in parts)
    assert files.read_csv(spark, got["b.CSV"]["path"]).count() == 40


def test_listed_outputs_are_written_without_dealing_rows_to_three_tasks(spark):
    from sluice.plans.catalog_more import list_written_files

    d = tmpdir()
    spark.range(1000).select("id", F.lit(None).cast("string").alias("v")).repartition(5).write.parquet(f"{d}/lineitem.parquet")
    writes, writer = [], type(spark.range(1).write)
    csv = writer.csv

    def seen(self, *args, **kwargs):
        writes.append(self._df._jdf.queryExecution().optimizedPlan().toString())
        return csv(self, *args, **kwargs)

    writer.csv = seen
    try:
        got = list_written_files(spark, d).collect()
    finally:
        writer.csv = csv
    assert [tuple(r) for r in got] == [(".csv", 3, True, 1000)]
    assert writes and not any("Repartition" in w for w in writes)


def test_csv_verdicts_do_not_sort_the_lines(spark, monkeypatch):
    d = tmpdir()
    write(os.path.join(d, "a.csv"), b"id,v\n1,x\n2,y\n")
    write(os.path.join(d, "b.csv"), b"id,w\n3,\xe9\n")
    plans, frame = [], type(spark.range(1))
    collect = frame.collect

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return collect(df)

    monkeypatch.setattr(frame, "collect", seen)
    got = files._file_verdicts(spark, d, None)
    assert [(v["encoding"], v["names"], v["cells"]) for v in got] == [("UTF-8", ("id", "v"), 2), ("ISO-8859-1", ("id", "w"), 2)]
    assert "ObjectHashAggregate" in plans[0] and "SortAggregate" not in plans[0]


# JDBC round trips need a database.  The only driver shipped with Spark is
# embedded Derby; starting even an in-process database is opt-in, so these
# run only with SLUICE_JDBC_TESTS=1.
needs_db = pytest.mark.skipif(os.environ.get("SLUICE_JDBC_TESTS") != "1",
                              reason="database tests are opt-in (SLUICE_JDBC_TESTS=1)")


@pytest.fixture
def derby():
    name = f"db{uuid.uuid4().hex[:8]}"
    return DatabaseConnection(url=f"jdbc:derby:memory:{name};create=true", dialect="derby",
                              driver="org.apache.derby.jdbc.EmbeddedDriver")


def seed_orders(spark, conn):
    df = spark.createDataFrame(
        [(1, "alice", 10.0, "paid"), (2, None, 20.0, "paid"), (3, "carol", 30.0, "pending"),
         (4, "dave", 40.0, "paid"), (5, "erin", 50.0, "cancelled")],
        "order_id int, customer string, amount double, status string",
    )
    w = df.write.format("jdbc").mode("error").option("dbtable", "orders_src")
    for k, v in conn.options().items():
        w = w.option(k, v)
    w.save()


@needs_db
def test_jdbc_table_query_columns_and_catalogue(spark, derby):
    seed_orders(spark, derby)
    t = jdbc.read_db(spark, DatabaseSource(connection=derby, table_name="orders_src", columns=["order_id", "status"]))
    assert t.columns == ["order_id", "status"] and t.count() == 5
    q = jdbc.read_db(spark, DatabaseSource(connection=derby, query='SELECT * FROM orders_src WHERE "amount" > 15'))
    assert q.count() == 4
    par = jdbc.read_db(spark, DatabaseSource(connection=derby, table_name="orders_src", partition_column="order_id",
                                             lower_bound=1, upper_bound=6, num_partitions=3))
    assert par.rdd.getNumPartitions() == 3 and par.count() == 5
    assert jdbc.table_exists(spark, derby, "orders_src")
    assert not jdbc.table_exists(spark, derby, "missing_table")
    assert [r["table_name"] for r in jdbc.list_tables(spark, derby).collect()] == ["ORDERS_SRC"]
    preview = {r["column_name"]: r["suggested_target_dtype"] for r in
               jdbc.schema_preview(spark, DatabaseSource(connection=derby, table_name="orders_src")).collect()}
    assert preview == {"order_id": "bigint", "customer": "text", "amount": "float", "status": "text"}
    summary = jdbc.summarize(spark, derby, preview_rows=2)
    assert summary[0]["row_count"] == 5 and len(summary[0]["preview"]) == 2
    assert {c["name"] for c in summary[0]["columns"]} == {"order_id", "customer", "amount", "status"}


def land_pages(d, pages, key="results"):
    for i, recs in enumerate(pages, start=1):
        with open(os.path.join(d, f"page_{i}.json"), "w") as fh:
            json.dump({key: recs, "page": i}, fh)


def page_files(d):
    """A transport that serves the files of a folder, answers 404 for others and notes its calls."""
    def fetch(method, url, body, headers):
        import os
        import urllib.parse
        import uuid

        class Missing(Exception):
            code = 404

        with open(os.path.join(d, f"call-{uuid.uuid4().hex}"), "w") as fh:
            fh.write(url)
        parts = urllib.parse.urlsplit(url)
        name = parts.path.lstrip("/") or f"page_{urllib.parse.parse_qs(parts.query)['page'][0]}.json"
        if not os.path.exists(os.path.join(d, name)):
            raise Missing(url)
        with open(os.path.join(d, name)) as fh:
            return fh.read()

    return fetch


def calls(d):
    return len([x for x in os.listdir(d) if x.startswith("call-")])


def test_rest_page_number_paging_parallel(spark):
    d = tmpdir()
    pages = [[{"id": p * 10 + i, "v": float(i)} for i in range(3)] for p in range(5)]
    land_pages(d, pages)
    src = ApiSource(url="http://api", records_key="results", max_pages=5)
    pages_df = rest.read_pages(spark, src, page_files(d), pages_per_partition=2)
    assert pages_df.count() == 5 and pages_df.count() == 5
    assert calls(d) == 5  # one call a page, however often the frame is used
    df = rest.read_api(spark, src, page_files(d))
    assert df.count() == 15
    assert dict(df.dtypes) == {"id": "bigint", "v": "double"}
    # open-ended paging runs in parallel rounds and takes a 404 past the first page as its end
    open_ended = ApiSource(url="http://api", records_key="results")
    assert rest.read_api(spark, open_ended, page_files(d)).count() == 15
    rounds = rest.read_pages(spark, open_ended, page_files(d), pages_per_partition=1)
    assert sorted(r["page"] for r in rounds.collect()) == [1, 2, 3, 4, 5]


def test_rest_404_on_the_first_page_is_an_error(spark):
    with pytest.raises(Exception):
        rest.read_pages(spark, ApiSource(url="http://api", records_key="results"), page_files(tmpdir()))


def test_rest_parallel_ranges_stop_at_first_empty_page(spark):
    d = tmpdir()
    pages = [[{"id": 1}], [{"id": 2}], [], [{"id": 4}], [{"id": 5}]]
    land_pages(d, pages)
    src = ApiSource(url="http://api", records_key="results", max_pages=5)
    got = sorted(r["id"] for r in rest.read_api(spark, src, page_files(d)).collect())
    assert got == [1, 2]


def test_rest_next_url_paging_calls_each_page_once(spark):
    d = tmpdir()
    for i in range(3):
        nxt = f"http://api/p{i + 1}.json" if i < 2 else None
        with open(os.path.join(d, f"p{i}.json"), "w") as fh:
            json.dump({"data": {"items": [{"n": i, "code": "007"}]}, "next": nxt}, fh)
    src = ApiSource(url="http://api/p0.json", records_key="data.items", next_url_key="next")
    got = rest.read_api(spark, src, page_files(d))
    assert sorted((r["n"], r["code"]) for r in got.collect()) == [(0, "007"), (1, "007"), (2, "007")]
    assert got.count() == 3 and calls(d) == 3


def test_drill_keeps_json_types(spark):
    body = ('[{"a": "1", "b": 1, "c": 1.5, "d": true, "e": {"x": [1]}, "f": null},'
            ' {"a": "x", "b": 2, "c": 2, "d": false, "e": [], "g": 3}]')
    out = drill(spark.createDataFrame([(body,), ("[]",), (None,)], "body string"), "body", None)
    assert dict(out.dtypes) == {"a": "string", "b": "bigint", "c": "double", "d": "boolean", "e": "string", "f": "double",
                                "g": "double"}
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [
        ("1", 1, 1.5, True, '{"x":[1]}', None, None), ("x", 2, 2.0, False, "[]", None, 3.0)]))
    assert drill(spark.createDataFrame([(body,)], "body string"), "body", None, fields=["b"]).columns == ["b"]


def test_drill_nested_key(spark):
    pages = spark.createDataFrame([('{"a": {"b": [{"x": 1, "y": "p"}, {"x": 2, "y": null}]}}',)], "body string")
    out = drill(pages, "body", "a.b").orderBy("x").collect()
    assert [(r["x"], r["y"]) for r in out] == [(1, "p"), (2, None)]


def test_multiline_detection(spark):
    d = tmpdir()
    plain = write(os.path.join(d, "plain.csv"), b'a,b\n1,"x ""q"" y"\n2,z\n')
    spans = write(os.path.join(d, "spans.csv"), b'a,b\n1,"two\nlines"\n2,z\n')
    assert not files.has_multiline_records(spark, plain)
    assert files.has_multiline_records(spark, spans)
    assert [r["b"] for r in files.read_csv(spark, plain).orderBy("a").collect()] == ['x "q" y', "z"]
    assert [r["b"] for r in files.read_csv(spark, spans).orderBy("a").collect()] == ["two\nlines", "z"]


def test_csv_folder_of_mixed_files(spark):
    d = tmpdir()
    write(os.path.join(d, "a.csv"), "k,name\n1,João\n2,� kept\n".encode())
    write(os.path.join(d, "b.csv"), "name,k\nRené,3\n".encode("latin-1"))
    write(os.path.join(d, "c x.csv"), b'k,name\n4,"two\nlines"\n')
    write(os.path.join(d, "d [x].csv"), b"k,other\n5,z\n")
    got = {r["k"]: (r["name"], r["other"]) for r in files.read_csv(spark, d).collect()}
    assert got == {1: ("João", None), 2: ("� kept", None), 3: ("René", None), 4: ("two\nlines", None), 5: (None, "z")}


def test_csv_surplus_cells_are_an_error_and_short_rows_are_padded(spark):
    d = tmpdir()
    short = write(os.path.join(d, "short.csv"), b"a,b\n1\n2,x\n")
    assert sorted(map(str, map(tuple, files.read_csv(spark, short).collect()))) == ["(1, None)", "(2, 'x')"]
    wide = write(os.path.join(d, "wide.csv"), b'a,b\n1,"x,y"\n2,x,3\n')
    with pytest.raises(ValueError):
        files.read_csv(spark, wide)


def test_jdbc_bounds_query():
    conn = jdbc.DatabaseConnection(url="jdbc:x", dialect="postgresql")
    src = jdbc.DatabaseSource(connection=conn, table_name="t", partition_column="id")
    assert jdbc.bounds_query(src) == "SELECT MIN(id) AS low, MAX(id) AS high FROM t"


def test_all_tables_are_counted_by_few_statements(spark):
    names = [f"t{k}" for k in range(250)] + ["o'x"]
    queries = jdbc.count_queries(names)
    assert len(queries) == 3 and sum(q.count("COUNT(*)") for q in queries) == 251 and "'o''x' AS table_name" in queries[2]
    assert jdbc.count_queries([]) == []
