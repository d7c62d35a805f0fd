import pytest
from pyspark.sql import functions as F

from cairnmap.streaming import incremental

SCHEMA = "row_id long, row_name string, metadata map<string,string>, extracted_text string"


def test_new_files_add_only_new_items(spark, tmp_path):
    folder, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def arrive(*ids):
        rows = [(i, f"n{i}", {"k": "v"}, "text") for i in ids]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)

    def run():
        texts = incremental.text_stream(incremental.watch(spark, folder, SCHEMA, files_per_batch=1))
        incremental.run_available(texts, incremental.append_new(out, "item_id"), progress)
        return sorted(r.item_id for r in spark.read.parquet(out).select("item_id").collect())

    arrive(1, 2)
    assert run() == [1, 2]
    arrive(2, 3)
    arrive(3, 4)
    assert run() == [1, 2, 3, 4]
    assert run() == [1, 2, 3, 4]
    assert spark.read.parquet(out).filter(F.col("text") == "n1\n\nk: v\n\ntext").count() == 1


def test_keys_in_the_state_store(spark, tmp_path):
    """A key comes through once; a batch that is run again replaces its own folder and reads nothing that is stored."""
    folder, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def arrive(*ids):
        rows = [(i, f"n{i}", {"k": "v"}, f"text {len(seen)}") for i in ids]
        seen.append(ids)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)

    def run(write):
        texts = incremental.first_of_key(incremental.text_stream(incremental.watch(spark, folder, SCHEMA, files_per_batch=1)), "item_id")
        incremental.run_available(texts, write, progress)
        return sorted(r.item_id for r in spark.read.parquet(out).select("item_id").collect())

    seen = []
    arrive(1, 2, 2)
    assert run(incremental.write_batches(out)) == [1, 2]
    arrive(2, 3)

    def dies(batch, number):
        incremental.write_batches(out)(batch, number)
        raise OSError("lost after the rows were written")

    with pytest.raises(Exception, match="lost"):
        run(dies)
    assert run(incremental.write_batches(out)) == [1, 2, 3]
    arrive(3, 4, 1)
    assert run(incremental.write_batches(out)) == [1, 2, 3, 4]
    assert run(incremental.write_batches(out)) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        incremental.first_of_key(incremental.watch(spark, folder, SCHEMA), "row_id", "row_name")


def test_keys_within_a_watermark(spark, tmp_path):
    folder, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:05:00")]
    spark.createDataFrame(rows, "id long, at string").selectExpr("id", "CAST(at AS timestamp) AS at").write.parquet(folder)
    stream = incremental.first_of_key(incremental.watch(spark, folder, "id long, at timestamp"), "id", "at", "1 hour")
    incremental.run_available(stream, incremental.write_batches(out), progress)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2]


def test_a_table_of_one_file_or_a_folder_of_files(spark, tmp_path):
    one, many, out = (str(tmp_path / n) for n in ("one", "many", "out"))
    spark.range(3).coalesce(1).write.parquet(one)
    (part,) = [f for f in (tmp_path / "one").iterdir() if f.suffix == ".parquet"]
    part.rename(tmp_path / "file.parquet")
    spark.range(5).repartition(2).write.parquet(f"{many}/table.parquet")
    for number, path, n in ((0, str(tmp_path / "file.parquet"), 3), (1, f"{many}/table.parquet", 5)):
        stream = incremental.watch_table(spark, path, "id long")
        incremental.run_available(stream, incremental.write_batches(f"{out}{number}"), f"{out}{number}-progress")
        assert spark.read.parquet(f"{out}{number}").count() == n
