"""CSV sources: differing and odd headers, quoted line breaks over splits, files that can't be read, folder names."""

import csv
import io
import random

import pytest

from caseload.sources import files
from caseload.sources.csv_scan import CsvScan


def test_odd_headers_and_missing_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,"od`d ""x"", y"\n1,p\n')
    (tmp_path / "b.csv").write_text("id,z\n2,q\n")
    (tmp_path / "empty.csv").write_text("")
    paths = [str(tmp_path / n) for n in ("a.csv", "b.csv", "empty.csv", "none.csv")]
    with pytest.warns(UserWarning, match="none.csv"):
        got = files.read_tickets_csv(spark, paths)
    assert got.columns == ["id", 'od`d "x", y', "z"]
    assert sorted(map(tuple, got.collect())) == [("1", "p", None), ("2", None, "q")]


def test_other_failures_are_raised(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id\n1\n")
    with pytest.raises(Exception, match="nofs"):
        files.read_tickets_csv(spark, [str(tmp_path / "a.csv"), "nofs://x/b.csv"])


def test_latest_table_takes_a_folder_name_literally(spark, tmp_path):
    base = tmp_path / "x.(1)+"
    base.mkdir()
    (base / "t.csv").write_text("id\n7\n")
    assert [r["id"] for r in files.latest_table(spark, str(base)).collect()] == ["7"]


CELLS = ["plain", "with, comma", 'say "hi"', "two\nlines", '"', 'a\n"b",\n\nc', "", "ü 漢字", '5" pipe', "\n", ",\n,", 'end"\n']


def written(rng, header, rows):
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(header)
    data = [[rng.choice(CELLS) if rng.random() < 0.4 else str(rng.random()) for _ in header] for _ in range(rows)]
    for i, row in enumerate(data):
        w.writerow([str(i), *row[1:]])
    return out.getvalue(), [[str(i), *row[1:]] for i, row in enumerate(data)]


@pytest.fixture
def small_splits(spark):
    """Splits of 2 000 bytes, as a large file has them of many megabytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_line_breaks_in_cells_over_many_splits(spark, tmp_path, small_splits):
    rng = random.Random(5)
    want = []
    for n, (name, header) in enumerate([("sub dir", ["id", "a", "b"]), ("x", ["id", "b", "new\nline", "c"]), ("y", ["id", "a", "b"])]):
        (tmp_path / name).mkdir()
        text, rows = written(rng, header, 400)
        (tmp_path / name / "t.csv").write_text(text)
        want += [{"id": r[0], **dict(zip(header[1:], r[1:]))} for r in rows]
    scan = CsvScan(spark, str(tmp_path))
    assert scan.rows.rdd.getNumPartitions() >= 4
    shape = ["id", "a", "b", "new\nline", "c"]
    blank = lambda v: v or None
    key = lambda rows: sorted(repr([blank(r.get(c)) for c in shape]) for r in rows)
    got = [r.asDict() for r in scan.checked().collect()]
    assert set(got[0]) == set(shape)
    assert key(got) == key(want)


def test_plain_large_file_is_split_and_read_by_the_csv_scan(spark, tmp_path, small_splits):
    (tmp_path / "t.csv").write_text("id,v\n" + "".join(f'{i},"x, ""{i}"""\n' for i in range(2000)))
    scan = CsvScan(spark, str(tmp_path))
    plan = scan.rows._jdf.queryExecution().executedPlan().toString()
    assert "FileScan csv" in plan and "Window" not in plan and scan.rows.rdd.getNumPartitions() > 5
    assert sorted(int(r["id"]) for r in scan.rows.where("v = concat('x, \"', id, '\"')").collect()) == list(range(2000))


def test_files_left_out_are_rows_with_a_reason(spark, tmp_path):
    (tmp_path / "good.csv").write_text("﻿id,id,,x\n\n1,2,3,4\n  \n5,6\n7,8,9,10,11\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "blank.csv").write_text("\n \n")
    (tmp_path / "open.csv").write_text('id\n1\n"2\n3\n' + "4\n" * 50)
    (tmp_path / "old.csv.processed").write_text("id\n99\n")
    (tmp_path / "big.csv.processed").write_text("id\n98\n" + "\n" * 1000)
    scan = CsvScan(spark, str(tmp_path))
    assert {r["file"].split("/")[-1]: r["reason"] for r in scan.files.collect()} == {
        "good.csv": None, "big.csv.processed": None, "blank.csv": "empty", "open.csv": "unclosed quote",  # Spark lists no file of no bytes
        "old.csv.processed": "small processed file"}
    with pytest.warns(UserWarning, match="unclosed quote"):
        rows = scan.checked()
    assert sorted(rows.columns) == ["_c2", "id", "id.1", "x"]
    got = sorted((tuple(r[c] for c in ("id", "id.1", "_c2", "x")) for r in rows.collect()), key=str)
    assert got == [("1", "2", "3", "4"), ("5", "6", None, None), ("7", "8", "9", "10"), ("98", None, None, None)]


def test_nothing_readable(spark, tmp_path):
    (tmp_path / "e.csv").write_text("\n")
    with pytest.raises(ValueError), pytest.warns(UserWarning):
        files.read_tickets_csv(spark, str(tmp_path))
