import datetime
import glob
import os
from concurrent.futures import ThreadPoolExecutor

from sluice.plans import jobs, ledger
from sluice.specs import FileDestination, JobSpec

NOW = datetime.datetime(2024, 3, 1, 12)


def entries(spark, path):
    return sorted(map(str, ledger.read_ledger(spark, path).collect()))


def note(spark, path, n, first=0):
    for k in range(first, first + n):
        ledger.record(spark, path, f"j{k % 3}", f"h{k % 3}", f"s{k}", ts=NOW + datetime.timedelta(hours=k))


def test_one_of_many_claims_at_once_holds(spark, tmp_path):
    path = str(tmp_path / "ledger")
    with ThreadPoolExecutor(8) as pool:
        holders = list(pool.map(lambda k: ledger.claim(spark, path, "abc", f"job{k}", now=NOW), range(24)))
    assert len(set(holders)) == 1
    assert ledger.claim(spark, path, "other", "x", now=NOW) == "x"
    later = NOW + datetime.timedelta(hours=30)
    assert ledger.claim(spark, path, "abc", "late", now=later) == "late"
    assert ledger.claim(spark, path, "abc", "later", now=later) == "late"
    assert not glob.glob(f"{path}/_claims/*.tmp")


def test_of_equal_submissions_at_once_one_runs(spark, tmp_path):
    src, out = str(tmp_path / "in.parquet"), str(tmp_path / "out")
    spark.range(50).write.parquet(src)
    spec = JobSpec(file_source={"path": src}, file_destination=FileDestination("parquet", out))
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda _: jobs.submit(spark, spec, str(tmp_path / "ledger")), range(6)))
    ran = [r for r in got if not r.get("duplicate")]
    assert len(ran) == 1 and ran[0]["success"] and {r["job_id"] for r in got} == {ran[0]["job_id"]}
    assert spark.read.parquet(out).count() == 50


def test_compaction_keeps_the_entries_and_bounds_the_files(spark, tmp_path):
    path = str(tmp_path / "ledger")
    note(spark, path, 6)
    before = entries(spark, path)
    assert ledger.compact(spark, path) and entries(spark, path) == before
    note(spark, path, 2, 6)
    both = entries(spark, path)
    assert len(both) == 8 and ledger.latest_states(spark, path, ttl_hours=24, now=NOW + datetime.timedelta(hours=9)).count() == 3
    assert ledger.compact(spark, path) and entries(spark, path) == both
    # the files that the first snapshot covered are gone; the second one's stay until the next
    assert len(glob.glob(f"{path}/day=*/*.parquet")) == 2
    assert ledger.compact(spark, path) and entries(spark, path) == both and not glob.glob(f"{path}/day=*/*.parquet")
    assert ledger.find_job(spark, path, "h1", ttl_hours=24, now=NOW + datetime.timedelta(hours=9))[:2] == ("j1", "s7")


def test_only_one_of_two_compactions_counts(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    note(spark, path, 3)
    before = entries(spark, path)
    os.makedirs(f"{path}/{ledger.MANIFESTS}")
    put = ledger.put_if_absent
    monkeypatch.setattr(ledger, "put_if_absent", lambda *a: False)
    assert not ledger.compact(spark, path) and entries(spark, path) == before
    monkeypatch.setattr(ledger, "put_if_absent", put)
    assert ledger.compact(spark, path, ttl_hours=1, now=NOW + datetime.timedelta(hours=2))
    assert len(entries(spark, path)) == 2
