"""Which reductions and runs exist, and lookups over them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F


def canonical(params: dict) -> str:
    """Parameters as JSON with sorted keys, so equal parameters are equal text."""
    return json.dumps(params, sort_keys=True)


def parse_reference(reference: str) -> tuple[str, int]:
    """``umap_8d`` gives the method and the width."""
    method, _, width = reference.rpartition("_")
    return method, int(width.rstrip("d"))


def find_reduction(reductions: DataFrame, method: str, dims: int) -> DataFrame:
    """Newest reduction of a method and width (no row if none)."""
    return (
        reductions.filter((F.col("method") == method) & (F.col("target_dimensions") == dims))
        .agg(F.max("reduction_id").alias("reduction_id"))
        .filter(F.col("reduction_id").isNotNull())
    )


def new_reductions(wanted: DataFrame, reductions: DataFrame) -> DataFrame:
    """Wanted reductions not stored yet; parameters and input count as part of the key."""
    return wanted.join(
        reductions, ["embedding_reference", "method", "target_dimensions", "params", "fingerprint"], "left_anti"
    )


def new_runs(wanted: DataFrame, runs: DataFrame) -> DataFrame:
    """Wanted cluster runs whose reduction, method and parameters are not stored yet."""
    return wanted.join(runs, ["reduction_id", "method", "params"], "left_anti")


def fingerprint(vectors: DataFrame) -> DataFrame:
    """One value that changes when ids or vectors change, whatever their order."""
    return vectors.agg(
        F.concat_ws(
            "-", F.count("*").cast("string"), F.coalesce(F.bit_xor(F.xxhash64("item_id", "vector")), F.lit(0)).cast("string")
        ).alias("fingerprint")
    )


def export_layout(runs: DataFrame, reductions: DataFrame) -> DataFrame:
    """Per run: newest 2-D UMAP reduction over the same embedding."""
    own = runs.join(reductions.select("reduction_id", "embedding_reference"), "reduction_id").select(
        "cluster_run_id", "embedding_reference"
    )
    # one row per embedding before the join, or it would pair all runs with all layouts of an embedding
    newest = reductions.filter("method = 'umap' and target_dimensions = 2").groupBy("embedding_reference").agg(
        F.max("reduction_id").alias("layout_id")
    )
    return own.join(newest, "embedding_reference").groupBy("cluster_run_id").agg(F.max("layout_id").alias("layout_id"))
