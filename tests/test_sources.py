import csv
import hashlib

import pytest
from pyspark.sql import functions as F

from cairnmap.sources import artifacts as A
from cairnmap.sources.csv_rows import read_csv_rows


def write(path, header, *rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([header, *rows])
    return str(path)


def test_values_stay_strings(spark, tmp_path):
    path = write(tmp_path / "a.csv", ["name", "score", "note"], ["x", "95", 'say "hi"\nand, bye'], ["y", "", "é"])
    got = sorted(read_csv_rows(spark, path).collect())
    assert [(r.row_id, r.row_name, r.source_row_number) for r in got] == [(1, "x", 1), (2, "y", 2)]
    assert got[0].metadata == {"score": "95", "note": 'say "hi"\nand, bye'}
    assert got[1].metadata == {"score": "", "note": "é"}


def test_header_only_and_no_special_columns(spark, tmp_path):
    assert read_csv_rows(spark, write(tmp_path / "h.csv", ["name", "a"])).count() == 0
    row = read_csv_rows(spark, write(tmp_path / "n.csv", ["a"], ["1"])).first()
    assert row.row_name is None and row.file_path is None and row.metadata == {"a": "1"}


def test_no_header(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError):
        read_csv_rows(spark, str(tmp_path / "e.csv"))


def test_rows_are_numbered_across_splits_and_files(spark, tmp_path):
    write(tmp_path / "a.csv", ["name"], *[[f"a{i}"] for i in range(5000)])
    write(tmp_path / "b.csv", ["name"], *[[f"b{i}"] for i in range(7000)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = read_csv_rows(spark, str(tmp_path), multiline=False, first_row_id=10).collect()
        tasks = read_csv_rows(spark, str(tmp_path), multiline=False).select("row_name").rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert tasks > 2
    assert {r.row_name: (r.row_id, r.source_row_number) for r in got} == {
        **{f"a{i}": (10 + i, i + 1) for i in range(5000)}, **{f"b{i}": (5010 + i, i + 1) for i in range(7000)},
    }


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.txt").write_text("one")
    (tmp_path / "sub" / "same.md").write_text("one")
    (tmp_path / "pic.png").write_bytes(b"\x89PNG\xff")
    return tmp_path


def attached(spark, folder, *names):
    rows = spark.createDataFrame(
        [(i, i, n) for i, n in enumerate(names, 1)], "row_id long, source_row_number long, file_path string"
    )
    return A.attach(rows, A.read_files(spark, str(folder)))


def test_one_artifact_two_links(spark, folder):
    links = attached(spark, folder, "one.txt", "sub/same.md", "./one.txt", str(folder / "pic.png"), "", None)
    found = {r.artifact_id: r for r in A.artifacts(links).collect()}
    key = hashlib.sha256(b"one").hexdigest()
    assert len(found) == 2 and A.item_artifacts(links).count() == 4
    assert found[key].original_path == str(folder / "one.txt") and found[key].mime_type == "text/plain"
    assert found[key].stored_path == f"{key[:2]}/{key}.txt" and found[key].bytes == 3


def test_missing_file_names_the_row(spark, folder):
    with pytest.raises(Exception, match="row 2: file 'gone.txt' not found"):
        attached(spark, folder, "one.txt", "gone.txt").collect()


@pytest.mark.parametrize("path,mime", [
    ("a.PNG", "image/png"), ("a.tar.gz", "application/x-tar"), ("a", None), (".png", None), ("d.x/a", None), ("a.unknownext", None),
])
def test_mime_type(spark, path, mime):
    assert spark.range(1).select(A.mime_type(F.lit(path)).alias("m")).first().m == mime


def test_undecodable_files_are_empty(spark, folder):
    got = A.read_files(spark, str(folder)).select("relative", A.file_text(F.col("content")).alias("t")).collect()
    assert {r.relative: r.t for r in got} == {"one.txt": "one", "sub/same.md": "one", "pic.png": ""}
