"""CSV files to rows and items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

# Columns that are not metadata.
SPECIAL_COLUMNS = ("name", "file_path")
MAX_FIELD_CHARS = 10 * 1024 * 1024


def read_csv_rows(spark: SparkSession, path: str, multiline: bool = True, first_row_id: int = 1) -> DataFrame:
    """Rows of UTF-8 CSV files with a header, every value a string.

    ``path`` is a file or a folder of files with one header. Quoted fields may
    hold line breaks while ``multiline`` is on; a file is then one task, so turn
    it off for large files without such fields to let Spark split them.

    Row numbers follow the file: a row's place within its split plus the row
    counts of the earlier splits of that file. ``row_id`` numbers the rows over
    the files in path order. Only one count per split meets in one place.
    """
    raw = (
        spark.read.option("header", True).option("inferSchema", False).option("escape", '"')
        .option("multiLine", multiline).option("encoding", "UTF-8")
        .option("maxCharsPerColumn", MAX_FIELD_CHARS).option("enforceSchema", False)
        .csv(path)
    )
    columns = raw.columns
    if not columns:
        raise ValueError(f"{path} has no header row")
    placed = raw.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_mark"),
    )
    split = ["_file", "_split"]
    counts = placed.groupBy(*split).agg(F.count("*").alias("_n"), F.min("_mark").alias("_first"))
    in_file = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    in_all = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("_file").alias("_in_file"), F.col("_split").alias("_in_split"), "_first",
        F.coalesce(F.sum("_n").over(in_file), F.lit(0)).alias("_before_in_file"),
        F.coalesce(F.sum("_n").over(in_all), F.lit(0)).alias("_before"),
    )
    metadata = [c for c in columns if c not in SPECIAL_COLUMNS]
    pairs = [x for c in metadata for x in (F.lit(c), F.coalesce(F.col(f"`{c}`"), F.lit("")))]
    entry = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    here = F.col("_mark") - F.col("_first")
    optional = lambda c: F.col(c) if c in columns else F.lit(None).cast("string")
    same_split = F.col("_file").eqNullSafe(F.col("_in_file")) & F.col("_split").eqNullSafe(F.col("_in_split"))
    return placed.join(offsets, same_split).select(
        (here + F.col("_before") + F.lit(first_row_id)).alias("row_id"),
        optional("name").alias("row_name"),
        entry.alias("metadata"),
        (here + F.col("_before_in_file") + 1).alias("source_row_number"),
        optional("file_path").alias("file_path"),
        F.col("_file").alias("source_file"),
    )


def items(rows: DataFrame) -> DataFrame:
    """One item per row."""
    return rows.select(F.col("row_id").alias("item_id"), "row_id")


def rows_from_table(df: DataFrame, id_col: str, name, metadata: list[str]) -> DataFrame:
    """Rows from any table with a unique id: named columns become string metadata."""
    pairs = [x for c in metadata for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    return df.select(
        F.col(id_col).cast("long").alias("row_id"), name.alias("row_name"),
        F.create_map(*pairs).alias("metadata"), F.col(id_col).cast("long").alias("source_row_number"),
    )
