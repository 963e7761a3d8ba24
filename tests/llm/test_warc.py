import hashlib
import zlib

import duckdb
import pytest

from sluice.llm import warc as w


@pytest.fixture
def pages(spark, rnd):
    page = lambda n: "".join(rnd.choice("<p>abc é\r\n\r\n") for _ in range(n))
    big, small = page(3000), page(200)
    rows = [(i, f"http://h/{i}", page(rnd.randint(0, 6000))) for i in range(60)]
    rows += [(100 + i, None, big) for i in range(9)] + [(200 + i, "u\r\nWARC-Type: x", small) for i in range(4)]
    rows += [(300, "u", None), (301, "u", ""), (302, "u", "WARC/1.1 \x1f")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def read_back(spark, pages, path, **conf):
    w.write_archives(pages, path)
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return [tuple(r) for r in w.page_records(w.read_archives(spark, path)).collect()]
    finally:
        for k in conf:
            spark.conf.unset(k)


@pytest.mark.parametrize("split", ["128m", "997b"])
def test_round_trip_over_splits_matches_sql(spark, pages, tmp_path, split):
    got = read_back(spark, pages, str(tmp_path / "a"), **{
        "spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": "1"})
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(str, got)) == sorted(map(str, con.execute(w.OP5_SQL).fetchall()))
    assert sum(r[3] == "revisit" for r in got) == 8


def test_archives_are_plain_gzip_and_payloads_come_back(spark, pages, tmp_path):
    w.write_archives(pages.repartition(2), str(tmp_path / "a"))
    texts = []
    for file in (tmp_path / "a").glob("part-*"):
        data = file.read_bytes()
        while data:
            unpacker = zlib.decompressobj(31)
            texts.append(unpacker.decompress(data))
            data = unpacker.unused_data
    assert sum(t.startswith(b"WARC/1.1\r\n") for t in texts) == pages.count()
    rows = w.read_archives(spark, str(tmp_path / "a")).collect()
    payload = {r["warc"]["warc-record-id"]: bytes(r["payload"]) for r in rows if r["warc"]["warc-type"] == "response"}
    for r in pages.filter("page_id < 60").collect():
        assert payload[f"<urn:x-page:{r['page_id']}>"] == r["html"].encode()


def test_the_magic_inside_a_member_is_put_back(spark, tmp_path, rnd):
    """Members that are stored, not packed, so that the payload's own magic stands in the file as it is."""
    def stored(data):
        packer = zlib.compressobj(0, zlib.DEFLATED, 31)
        return packer.compress(data) + packer.flush()

    payloads = [(w.MAGIC + b"\x00" * 7).join(rnd.randbytes(rnd.randint(5, 900)) for _ in range(30)) for _ in range(12)]
    payloads.append(w._member(b"WARC/"[:3] + b"x" * 100))
    archive = b""
    for k, p in enumerate(payloads):
        sha = hashlib.sha1(p).hexdigest()
        archive += stored(w._record(k, None, p, len(p), sha, None)) + w.EMPTY_MEMBER
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "part-0.warc").write_bytes(archive)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2500b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = w.page_records(w.read_archives(spark, str(tmp_path / "a"))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r["page_id"], r["payload_digest"]) for r in got) == [
        (k, hashlib.sha1(p).hexdigest()) for k, p in enumerate(payloads)]


def test_null_ids_ties_and_no_rows(spark, tmp_path):
    big = "x" * 1200
    rows = [(None, "u", big), (None, "u", big)]
    schema = "page_id long, url string, html string, k1 int, sha1 string, length long"
    frame = lambda rows: spark.createDataFrame([(*r, 1, "s", 5) for r in rows], schema)
    assert {r[3:] for r in read_back(spark, frame(rows), str(tmp_path / "a"))} == {("response", None)}
    got = read_back(spark, frame([*rows, (4, "u", big), (4, "u", big), (2, None, big)]), str(tmp_path / "b"))
    assert sorted(map(str, ((r[0], *r[3:]) for r in got))) == sorted(map(str, [
        (None, "revisit", 4), (None, "revisit", 4), (4, "response", None), (4, "response", None), (2, "revisit", 4)]))
    assert read_back(spark, frame(rows).limit(0), str(tmp_path / "c")) == []
