import csv
import io
import random

import pytest

from sluice.sources import files, split_csv


@pytest.fixture
def tiny_splits(spark):
    """Splits of a few bytes, several of them in one task."""
    keys = {"spark.sql.files.maxPartitionBytes": "61", "spark.sql.files.openCostInBytes": "1",
            "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}

    def put(size):
        for k, v in keys.items():
            spark.conf.set(k, v if k != "spark.sql.files.maxPartitionBytes" else str(size))

    put(61)
    yield put
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def made(rnd, n):
    cells = ["plain", "", 'a "b" c', "two\nlines", "x,y", "\n\n", "naïve", ' " ', ",\n,", "7", "long " * 30, "a\r\nb"]
    return [[str(k), rnd.choice(cells), rnd.choice(cells)] for k in range(n)]


def write(path, rows, line="\n", encoding="utf-8"):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=line).writerows([["id", "a", "b"], *rows])
    path.write_bytes(out.getvalue().encode(encoding))
    return str(path)


def read(spark, path, **options):
    got = files.read_csv(spark, path, infer_types=False, **options).collect()
    return sorted([[v or "" for v in r] for r in got], key=lambda r: int(r[0]))


@pytest.mark.parametrize("size", [41, 997])
def test_records_over_splits(spark, tiny_splits, rnd_rows, tmp_path, size):
    tiny_splits(size)
    path = write(tmp_path / "spans.csv", rnd_rows)
    assert read(spark, path) == rnd_rows


@pytest.fixture
def rnd_rows():
    return made(random.Random(3), 60)


def test_line_ends_encodings_and_folders(spark, tiny_splits, rnd_rows, tmp_path):
    folder = tmp_path / "mixed.csv"
    folder.mkdir()
    write(folder / "a.csv", rnd_rows[:20], "\r\n")
    write(folder / "b.csv", rnd_rows[20:40], "\n", "latin-1")
    write(folder / "c d.csv", rnd_rows[40:])
    assert read(spark, str(folder)) == rnd_rows


def test_one_cell_over_many_splits_and_no_line_end(spark, tiny_splits, tmp_path):
    long = "\n".join(f"line {k}" for k in range(80))
    path = tmp_path / "long.csv"
    path.write_text(f'id,a,b\n1,"{long}",x\n2,y,"{long}"')
    assert read(spark, str(path)) == [["1", long, "x"], ["2", "y", long]]


def test_quotes_inside_plain_cells_open_nothing(spark, tiny_splits, tmp_path):
    path = tmp_path / "inches.csv"
    path.write_text('id,a,b\n1,5" pipe,x\n2,"two\nlines",6"\n3,a"b,"c"\n')
    assert read(spark, str(path)) == [["1", '5" pipe', "x"], ["2", "two\nlines", '6"'], ["3", 'a"b', "c"]]


def test_header_over_lines_short_and_long_records(spark, tiny_splits, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text('id,"a\nb",c\n1\n\n2,"x\ny",z,more\n')
    got = files.read_csv(spark, str(path), infer_types=False)
    assert got.columns == ["id", "a\nb", "c"]
    assert sorted(map(tuple, got.collect())) == [("1", None, None), ("2", "x\ny", "z")]


def test_types_are_read_by_a_given_schema(spark, tiny_splits, tmp_path):
    path = tmp_path / "typed.csv"
    path.write_text('id,a,b\n1,"x\ny",2.5\n2,z,\n')
    got = files.read_csv(spark, str(path), schema="id int, a string, b double").collect()
    assert sorted(map(tuple, got)) == [(1, "x\ny", 2.5), (2, "z", None)]


def test_one_file_is_read_in_many_tasks(spark, tiny_splits, rnd_rows, tmp_path):
    path = write(tmp_path / "spans.csv", rnd_rows)
    cut = split_csv._lines(spark, path, "UTF-8")
    assert cut.rdd.getNumPartitions() > 10


@pytest.mark.parametrize("seed", range(10))
def test_open_cells_as_a_character_machine_finds_them(seed):
    rnd = random.Random(seed)

    def slowly(line, inside):
        k, state = 0, "inside" if inside else "start"
        while k < len(line):
            ch = line[k]
            if state == "inside":
                if ch == '"':
                    if line[k + 1:k + 2] == '"':
                        k += 1
                    else:
                        state = "plain"
            elif ch == ",":
                state = "start"
            else:
                state = "inside" if state == "start" and ch == '"' else "plain"
            k += 1
        return state == "inside"

    for _ in range(100):
        line = "".join(rnd.choice('"",,ab') for _ in range(rnd.randint(0, 14)))
        for inside in (False, True):
            assert split_csv.open_at_end(line, inside) == slowly(line, inside), (line, inside)


def test_no_files_lines_or_records(spark, tmp_path):
    path = tmp_path / "head.csv"
    path.write_text('id,"a\nb",c\n')
    assert files.read_csv(spark, str(path), infer_types=False).count() == 0
