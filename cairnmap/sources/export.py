"""CSV export of a cluster run."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cairnmap.functions.ranking import latest


def export_run(run_id: int, runs: DataFrame, rows: DataFrame, assignments: DataFrame, summaries: DataFrame,
               coordinates: DataFrame, layouts: DataFrame) -> DataFrame:
    """One row per assigned item, noise kept; missing labels and coordinates are empty.

    ``layouts(cluster_run_id, layout_id)`` names the 2-D layout of the run.
    """
    if runs.filter(F.col("cluster_run_id") == run_id).isEmpty():
        raise ValueError(f"cluster run {run_id} not found")
    return export_rows(
        rows, assignments.filter(F.col("cluster_run_id") == run_id), summaries, coordinates, layouts
    ).drop("cluster_run_id")


def export_rows(rows: DataFrame, assignments: DataFrame, summaries: DataFrame, coordinates: DataFrame,
                layouts: DataFrame) -> DataFrame:
    labels = latest(summaries, ["cluster_run_id", "cluster_id"], "cluster_summary_id").select(
        "cluster_run_id", "cluster_id", F.col("label").alias("cluster_label")
    )
    placed = coordinates.join(
        layouts.withColumnRenamed("layout_id", "reduction_id"), "reduction_id"
    ).select("cluster_run_id", "item_id", "coordinates")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return (
        assignments.join(rows, assignments["item_id"] == rows["row_id"])
        .join(labels, ["cluster_run_id", "cluster_id"], "left")
        .join(placed, ["cluster_run_id", "item_id"], "left")
        .select(
            "cluster_run_id", "row_id", "row_name", "cluster_id",
            F.coalesce("cluster_label", F.lit("")).alias("cluster_label"),
            text(F.get("coordinates", F.lit(0))).alias("umap2_x"),
            text(F.get("coordinates", F.lit(1))).alias("umap2_y"),
            F.to_json("metadata").alias("metadata"),
        )
    )


def write_csv(exported: DataFrame, path: str) -> None:
    """Sorted CSV files: a range sort, so the files in name order are one sorted table."""
    exported.orderBy("row_id").write.mode("overwrite").option("header", True).option("escape", '"').option(
        "emptyValue", ""
    ).csv(path)
