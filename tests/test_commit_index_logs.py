import json
import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest

from sluice.sinks import commit as C
from sluice.sinks.indexed import files_with, lookup, write_indexed
from sluice.streaming.logs import follow_logs, running_summary


def ids(df):
    return None if df is None else sorted(r[0] for r in df.collect())


def test_a_load_that_fails_between_destinations_shows_in_neither(spark, tmp_path):
    root = str(tmp_path)
    good, bad = spark.range(10), spark.range(5).selectExpr("raise_error('lost') id")
    C.fan_out(spark, {"a": spark.range(3), "b": spark.range(4)}, root)
    with pytest.raises(Exception):
        C.fan_out(spark, {"a": good, "b": bad}, root, "second")
    assert ids(C.read_committed(spark, root, "a")) == [0, 1, 2] and ids(C.read_committed(spark, root, "b")) == [0, 1, 2, 3]
    assert "a/v-second" in C.recover(spark, root)
    assert not os.path.exists(f"{root}/a/v-second") and ids(C.read_committed(spark, root, "a")) == [0, 1, 2]
    # run again under its name it counts once, also if its commit is asked for twice
    assert C.fan_out(spark, {"a": good, "b": spark.range(20, 22)}, root, "second") == {"a": 10, "b": 2}
    C.commit(spark, root, [], "second")
    assert len(ids(C.read_committed(spark, root, "a"))) == 13 and ids(C.read_committed(spark, root, "b")) == [0, 1, 2, 3, 20, 21]
    C.fan_out(spark, {"b": spark.range(1)}, root, replace=True)
    assert ids(C.read_committed(spark, root, "b")) == [0] and len(ids(C.read_committed(spark, root, "a"))) == 13
    assert C.read_committed(spark, root, "c") is None and C.recover(spark, root) == []


def test_loads_at_once_are_all_committed(spark, tmp_path):
    root = str(tmp_path)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: C.fan_out(spark, {"a": spark.range(k, k + 1)}, root, f"l{k}"), range(6)))
    assert ids(C.read_committed(spark, root, "a")) == list(range(6))


def test_lookups_read_few_files(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(k, rnd.randint(0, 10**6) if k % 9 else None, f"t{rnd.randint(0, 500)}") for k in range(4000)]
    path, columns = str(tmp_path / "t"), ["id", "other", "text"]
    write_indexed(spark.createDataFrame(rows, "id long, other long, text string").repartition(3), path, "id", ["other", "text"], files=20)
    assert len(files_with(spark, path, columns, "id", [5])) == 1
    some = [r[1] for r in rows[1:400:40] if r[1] is not None]
    found = files_with(spark, path, columns, "other", some)
    assert len(found) <= len(some) + 2
    got = lookup(spark, path, columns, "other", some)
    assert len(got.inputFiles()) == len(found)
    assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[1] in some)
    assert sorted(map(tuple, lookup(spark, path, columns, "text", ["t7", "none"]).collect())) == sorted(r for r in rows if r[2] == "t7")
    assert files_with(spark, path, columns, "other", [-1]) == [] and lookup(spark, path, columns, "id", [10**9]).count() == 0
    assert lookup(spark, path, columns, "id", []).count() == 0


def test_summaries_go_on_after_a_restart(spark, tmp_path):
    logs, out, checkpoint = (str(tmp_path / n) for n in ("logs", "out", "checkpoint"))
    os.makedirs(logs)

    def write(name, *levels):
        with open(f"{logs}/{name}.json", "w") as f:
            f.writelines(json.dumps({"level": level, "job_id": job, "message": "m"}) + "\n" for job, level in levels)
            f.write("{ broken\n")

    write("1", ("a", "INFO"), ("a", "ERROR"), ("b", "WARNING"))
    follow_logs(spark, logs, out, checkpoint)
    write("2", ("a", "ERROR"), ("c", "INFO"))
    write("3", ("a", "WARNING"))
    follow_logs(spark, logs, out, checkpoint)
    follow_logs(spark, logs, out, checkpoint)
    got = sorted(map(tuple, running_summary(spark, out).collect()))
    assert [r for r in got if r[0]] == [("a", 4, 2, 1), ("b", 1, 0, 1), ("c", 1, 0, 0)]
