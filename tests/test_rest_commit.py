import glob
import json
import os
from urllib.parse import parse_qs, urlsplit

import pytest

from sluice.sinks.rest_commit import AckFolder, batches, failed_batches, load_batches
from sluice.sources.rest import read_pages
from sluice.specs import ApiDestination, ApiSource
from sluice.streaming.pages import resume_api, resume_pages


def inbox(folder, kill_at=None, refuse=()):
    """A transport that appends each request's key and body to files; it dies once at batch ``kill_at``,
    by what no handler of the sink catches, as a lost executor would."""
    def send(method, url, body, headers):
        batch = int(headers["Idempotency-Key"].rpartition("-")[2])
        if batch == kill_at and not os.path.exists(f"{folder}/killed"):
            open(f"{folder}/killed", "w").close()
            raise KeyboardInterrupt
        if batch in refuse:
            return 500
        with open(f"{folder}/{batch:05d}.json", "a") as f:
            f.write(body + "\n")
        return 201

    return send


def received(folder):
    """Rows by batch; a batch that came twice has two lines."""
    return {int(os.path.basename(p)[:5]): [json.loads(line) for line in open(p)] for p in glob.glob(f"{folder}/*.json")}


@pytest.fixture
def frame(spark):
    return spark.range(1000).selectExpr("id", "cast(id % 7 as int) k", "if(id % 3 = 0, null, 'x\"é') t").repartition(6)


def test_batches_are_cut_by_global_numbers(frame):
    made = sorted(map(tuple, batches(frame, ApiDestination(url="u", batch_size=64, records_key="rows"), "id").collect()))
    assert [b for b, _, _ in made] == list(range(16)) and [n for _, n, _ in made] == [64] * 15 + [40]
    rows = [r for _, _, body in made for r in json.loads(body)["rows"]]
    assert [r["id"] for r in rows] == list(range(1000)) and rows[0] == {"id": 0, "k": 0, "t": None}


def test_a_load_that_broke_off_sends_no_batch_twice(frame, tmp_path):
    dest = ApiDestination(url="http://unused", batch_size=4)
    box, ledger = tmp_path / "box", str(tmp_path / "ledger")
    box.mkdir()
    with pytest.raises(Exception):
        load_batches(frame, dest, "one", "id", inbox(str(box), kill_at=100), ledger=ledger)
    before = received(box)
    assert before and 100 not in before and AckFolder(ledger).read("committed") is None
    result = load_batches(frame, dest, "one", "id", inbox(str(box), kill_at=100), ledger=ledger)
    after = received(box)
    assert sorted(after) == list(range(250)) and all(len(lines) == 1 for lines in after.values())
    assert [r["id"] for k in sorted(after) for r in after[k][0]] == list(range(1000))
    assert result == {"total_records": 1000, "sent": 1000, "failed": 0, "failed_batches": 0, "skipped": len(before),
                      "batches": 250, "errors": []}
    again = load_batches(frame, dest, "one", "id", inbox(str(box)), ledger=ledger)
    assert again["skipped"] == 250 and all(len(lines) == 1 for lines in received(box).values())


def test_refused_batches_are_reported_and_sent_by_the_next_run(spark, frame, tmp_path):
    dest = ApiDestination(url="http://unused", batch_size=100)
    ledger = str(tmp_path / "ledger")
    first = load_batches(frame, dest, "two", "id", inbox(str(tmp_path), refuse=(2, 9)), max_retries=2, ledger=ledger)
    assert first["failed"] == 200 and first["failed_batches"] == 2 and first["errors"] == ["HTTP 500"]
    assert sorted(map(tuple, failed_batches(spark, "two", ledger).collect())) == [(2, 100, "HTTP 500"), (9, 100, "HTTP 500")]
    second = load_batches(frame, dest, "two", "id", inbox(str(tmp_path)), ledger=ledger)
    assert second["failed"] == 0 and second["skipped"] == 8 and failed_batches(spark, "two", ledger).count() == 0
    assert sorted(received(tmp_path)) == list(range(10))


def test_an_entry_half_written_leaves_the_one_before(tmp_path):
    acks = AckFolder(str(tmp_path))
    acks.write("unit-0", {"acked": [1]})
    acks.write("unit-0", {"acked": [1, 2], "version": 1})
    (tmp_path / "unit-0-0.json").write_text('{"acked": [1, 2')
    assert acks.read("unit-0")["acked"] == [1] and acks.read("unit-1") is None


def test_nothing_to_send(frame, tmp_path):
    got = load_batches(frame.limit(0), ApiDestination(url="u"), "none", "id", inbox(str(tmp_path)), ledger=str(tmp_path / "l"))
    assert got["total_records"] == 0 and got["batches"] == 0


def pages(folder, total, per_page=10, break_at=None):
    """A transport that serves numbered or linked pages and notes each request; it fails once at page ``break_at``."""
    def get(method, url, body, headers):
        page = int(parse_qs(urlsplit(url).query)["page"][0])
        if page == break_at and not os.path.exists(f"{folder}/broken"):
            open(f"{folder}/broken", "w").close()
            raise OSError("connection lost")
        with open(f"{folder}/asked", "a") as f:
            f.write(f"{page}\n")
        items = [{"id": k, "v": f"é{k}"} for k in range((page - 1) * per_page, min(page * per_page, total))]
        return json.dumps({"items": items, "next": f"http://api/?page={page + 1}" if page * per_page < total else None})

    return get


def asked(folder):
    return [int(x) for x in open(f"{folder}/asked")]


def test_a_cursor_goes_on_after_the_last_committed_batch(spark, tmp_path):
    source = ApiSource(url="http://api/", records_key="items", next_url_key="next")
    folder = str(tmp_path / "land")
    with pytest.raises(Exception):
        resume_pages(spark, source, folder, pages(str(tmp_path), 300, break_at=12), pages_per_batch=4)
    done = spark.read.parquet(f"{folder}/pages").count()
    assert done == 8
    before = len(asked(tmp_path))
    got = resume_api(spark, source, folder, pages(str(tmp_path), 300, break_at=12)).collect()
    assert sorted(map(tuple, got)) == [(k, f"é{k}") for k in range(300)]
    assert min(asked(tmp_path)[before:]) > done and sorted(set(asked(tmp_path))) == list(range(1, 31))
    before = len(asked(tmp_path))
    assert resume_pages(spark, source, folder, pages(str(tmp_path), 300)).count() == 30 and len(asked(tmp_path)) == before


def test_numbered_pages_go_on_with_the_first_unfinished_round(spark, tmp_path):
    source = ApiSource(url="http://api/", records_key="items")
    folder = str(tmp_path / "land")
    with pytest.raises(Exception):
        resume_pages(spark, source, folder, pages(str(tmp_path), 300, break_at=22), pages_per_batch=4)
    before = len(asked(tmp_path))
    got = resume_pages(spark, source, folder, pages(str(tmp_path), 300, break_at=22), pages_per_batch=4)
    assert sorted(r["page"] for r in got.collect()) == list(range(1, 31))
    assert min(asked(tmp_path)[before:]) >= 17  # rounds of 8 pages: the first two are complete


def test_bounded_and_empty_sources(spark, tmp_path):
    few = ApiSource(url="http://api/", records_key="items", max_pages=5)
    assert resume_pages(spark, few, str(tmp_path / "a"), pages(str(tmp_path), 300)).count() == 5
    none = ApiSource(url="http://api/", records_key="items", next_url_key="next")
    assert resume_pages(spark, none, str(tmp_path / "b"), pages(str(tmp_path), 0)).count() == 0


def test_rounds_grow_and_are_read_as_one_scan(spark, tmp_path):
    source, folder = ApiSource(url="http://api/", records_key="items"), str(tmp_path / "land")
    got = resume_pages(spark, source, folder, pages(str(tmp_path), 1500), pages_per_batch=2)
    assert sorted(r["page"] for r in got.collect()) == list(range(1, 151))
    # rounds of 4, 4, 8, 16, ... pages; the last is of 128, and each of its 4 ranges asks for one page past the end at most
    assert len(list((tmp_path / "land").glob("from-*"))) == 7 and max(asked(tmp_path)) <= 256
    assert len(asked(tmp_path)) <= 150 + 4 and "Union" not in got._jdf.queryExecution().optimizedPlan().toString()
    open_ended = read_pages(spark, source, pages(str(tmp_path), 1500), pages_per_partition=1)
    assert open_ended.count() == 150 and "Union" not in open_ended._jdf.queryExecution().optimizedPlan().toString()


def test_linked_pages_run_in_few_rounds_of_a_task_each(spark, tmp_path):
    source, folder = ApiSource(url="http://api/", records_key="items", next_url_key="next"), str(tmp_path / "land")
    got = resume_pages(spark, source, folder, pages(str(tmp_path), 1500), pages_per_batch=2)
    assert sorted(r["page"] for r in got.collect()) == list(range(150)) and asked(tmp_path) == list(range(1, 151))
    assert len(list((tmp_path / "land" / "pages").glob("from=*"))) == 8  # 2, 2, 4, ... 64 and the rest


def test_a_cursor_to_an_empty_page_ends_the_run(spark, tmp_path):
    def served(last):
        def get(method, url, body, headers):
            page = int(parse_qs(urlsplit(url).query)["page"][0])
            return json.dumps({"items": [page] if page <= last else [], "next": f"http://api/?page={page + 1}"})

        return get

    source = ApiSource(url="http://api/", records_key="items", next_url_key="next")
    for last in (3, 4):  # inside a round, and at its end
        assert resume_pages(spark, source, str(tmp_path / f"l{last}"), served(last), pages_per_batch=4).count() == last
    assert resume_pages(spark, source, str(tmp_path / "l4"), served(6), pages_per_batch=4).count() == 6
