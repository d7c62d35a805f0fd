"""Quality figures of cluster runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from cairnmap.functions import vectors as V
from cairnmap.operators.tiles import block_of, blocks_for, pair_blocks
from cairnmap.session import written

SILHOUETTE_DECIMALS = 3
# Means of clusters that a task holds.
CENTRE_BYTES = 64 * 1024 * 1024


def cluster_sizes(assignments: DataFrame) -> DataFrame:
    """Member count of each non-noise cluster."""
    return assignments.filter("cluster_id >= 0").groupBy("cluster_run_id", "cluster_id").agg(
        F.count("*").alias("size")
    )


def run_metrics(assignments: DataFrame) -> DataFrame:
    """Cluster count, noise share and size spread of every run.

    Two aggregations: rows to one count per (run, cluster), then to one row per
    run, so the second works on cluster counts only.
    """
    counts = assignments.groupBy("cluster_run_id", "cluster_id").agg(F.count("*").alias("n"))
    real = F.when(F.col("cluster_id") >= 0, F.col("n"))
    return counts.groupBy("cluster_run_id").agg(
        F.count(real).alias("n_clusters"),
        (F.coalesce(F.sum(F.when(F.col("cluster_id") == -1, F.col("n"))), F.lit(0)) / F.sum("n")).alias(
            "noise_fraction"
        ),
        F.sum("n").alias("total_items"),
        F.coalesce(F.min(real), F.lit(0)).alias("size_min"),
        F.coalesce(F.max(real), F.lit(0)).alias("size_max"),
        F.coalesce(F.median(real), F.lit(0.0)).alias("size_median"),
    )


def _weighted_points(assignments: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Distinct (run, cluster, position) with its number of items, noise left out.

    Copies of one position always share their distances, so a hot position costs
    one row from here on.
    """
    return (
        assignments.filter("cluster_id >= 0")
        .join(coordinates.select("item_id", "coordinates"), "item_id")
        .groupBy("cluster_run_id", "cluster_id", "coordinates")
        .agg(F.count("*").alias("weight"), F.min("item_id").alias("point"))
    )


def _tile_sums(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Summed distance from each left point to the members of each cluster on the right."""
    if left.empty or right.empty:
        return pd.DataFrame({"point": [], "other": [], "total": []})
    a = np.stack(left["coordinates"].to_numpy()).astype(np.float64)
    clusters, code = np.unique(right["cluster_id"].to_numpy(), return_inverse=True)
    b = np.stack(right["coordinates"].to_numpy()).astype(np.float64)
    weights = np.zeros((len(b), len(clusters)))
    weights[np.arange(len(b)), code] = right["weight"].to_numpy()
    totals = np.empty((len(a), len(clusters)))
    step = max(1, 4_000_000 // max(1, b.size))
    for start in range(0, len(a), step):
        gap = a[start:start + step, None, :] - b[None, :, :]
        totals[start:start + step] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap)) @ weights
    return pd.DataFrame(
        {
            "point": np.repeat(left["point"].to_numpy(), len(clusters)),
            "other": np.tile(clusters, len(a)),
            "total": totals.ravel(),
        }
    )


def _centres(points: DataFrame) -> DataFrame:
    """(cluster_run_id, cluster_id, positions, mean, spread): ``spread`` is the items' mean squared distance from their mean."""
    vector = array_to_vector(V.as_doubles(F.col("coordinates")))
    weight = F.col("weight").cast("double")
    sums = points.groupBy("cluster_run_id", "cluster_id").agg(
        F.count("*").alias("positions"), Summarizer.metrics("mean").summary(vector, weight).alias("m"),
        (F.sum(weight * V.dot(F.col("coordinates"), F.col("coordinates"))) / F.sum(weight)).alias("square"))
    mean = vector_to_array("m.mean")
    return sums.select("cluster_run_id", "cluster_id", "positions", mean.alias("mean"), F.greatest(F.col("square") - V.dot(mean, mean), F.lit(0.0)).alias("spread"))


def _visits(shared):
    """For each point its own cluster and those that can be the nearest of the others.

    The mean distance to a cluster is at least the distance to its mean, and at most the root of the mean squared distance.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, part in batch.groupby("cluster_run_id"):
                clusters, means, spreads = shared.value[number]
                step = max(1, 4_000_000 // max(1, len(clusters)))
                for start in range(0, len(part), step):
                    rows = part.iloc[start:start + step]
                    x = np.stack(rows["coordinates"].to_numpy()).astype(np.float64)
                    squared = np.maximum((x * x).sum(1)[:, None] + (means * means).sum(1)[None, :] - 2 * x @ means.T, 0.0)
                    slack = 1e-6 * (1 + np.sqrt(squared.max()))
                    own = rows["cluster_id"].to_numpy()[:, None] == clusters[None, :]
                    most = np.where(own, np.inf, np.sqrt(squared + spreads[None, :]))
                    r, c = np.nonzero(own | (np.sqrt(squared) <= most.min(1)[:, None] + slack))
                    yield pd.DataFrame({"cluster_run_id": number, "point": rows["point"].to_numpy()[r], "coordinates": rows["coordinates"].to_numpy()[r], "other": clusters[c]})

    return run


def _member_sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Summed distance from each visiting point to the members of one block of a cluster."""
    if left.empty or right.empty:
        return pd.DataFrame({"cluster_run_id": [], "point": [], "other": [], "total": []})
    out = _tile_sums(None, left, right)
    out.insert(0, "cluster_run_id", left["cluster_run_id"].iloc[0])
    return out


def _pruned_sums(points: DataFrame, centres: DataFrame, block_rows: int) -> DataFrame:
    """(cluster_run_id, point, other, total) for the clusters that matter to a point; blocks of a cluster meet bounded chunks of its visitors."""
    held = centres.toPandas()
    table = {number: (part["cluster_id"].to_numpy(np.int64), np.stack(part["mean"].to_numpy()), part["spread"].to_numpy(float)) for number, part in held.groupby("cluster_run_id")}
    shared = points.sparkSession.sparkContext.broadcast(table)
    schema = "cluster_run_id long, point long, coordinates array<double>, other long"
    visits = written(points.select("cluster_run_id", "point", "cluster_id", V.as_doubles(F.col("coordinates")).alias("coordinates")).mapInPandas(_visits(shared), schema))
    blocks = F.ceil(F.col("positions") / block_rows).cast("int")
    tiles = visits.groupBy("cluster_run_id", "other").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("chunks")).join(
        centres.select("cluster_run_id", F.col("cluster_id").alias("other"), blocks.alias("blocks")), ["cluster_run_id", "other"])
    tiles = written(tiles)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda c: F.pmod(F.xxhash64("point"), F.col(c)).cast("int")
    left = visits.join(tiles, ["cluster_run_id", "other"]).withColumn("chunk", part("chunks")).withColumn("block", every("blocks"))
    right = points.withColumnRenamed("cluster_id", "other").join(tiles, ["cluster_run_id", "other"]).withColumn("block", part("blocks")).withColumn("chunk", every("chunks"))
    right = right.select("cluster_run_id", "other", "block", "chunk", F.col("other").alias("cluster_id"), "coordinates", "weight")
    tile = ["cluster_run_id", "other", "block", "chunk"]
    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInPandas(_member_sums, "cluster_run_id long, point long, other long, total double")


def _all_sums(points: DataFrame, block_rows: int) -> DataFrame:
    """(cluster_run_id, point, other, total) for every cluster of the run, where the clusters' means are too many to hold."""
    n_blocks = blocks_for(points, block_rows)
    points = points.withColumn("block", block_of(F.col("point"), n_blocks))
    left, right = pair_blocks(points, points, n_blocks)
    tile = ["cluster_run_id", "left_block", "right_block"]

    def sums(key, a, b):
        out = _tile_sums(key, a, b)
        out.insert(0, "cluster_run_id", key[0])
        return out

    schema = "cluster_run_id long, point long, other long, total double"
    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInPandas(sums, schema)


def silhouette(assignments: DataFrame, coordinates: DataFrame, block_rows: int = 4096, centre_bytes: int = CENTRE_BYTES) -> DataFrame:
    """Mean Euclidean silhouette of each run over its own coordinates, exact.

    A point needs its mean distance to its own cluster and to the nearest other one. Which others can be nearest follows from the
    clusters' means and spreads, so a point meets the members of its own and of a few clusters, in tiles of two
    bounded blocks, each of which sends back one sum per (point, cluster), never pairs. Within a cluster the work stays quadratic in its
    distinct positions; ``squared_silhouette`` is a linear, differently defined figure. Runs with fewer than two clusters, or with
    nothing but singletons, get null.
    """
    points = written(_weighted_points(assignments, coordinates))
    centres = written(_centres(points))
    held = centres.agg(F.sum(8 * (F.size("mean") + 2))).first()[0] or 0
    partial = _pruned_sums(points, centres, block_rows) if held <= centre_bytes else _all_sums(points, block_rows)
    totals = partial.groupBy("cluster_run_id", "point", "other").agg(F.sum("total").alias("total"))
    sizes = cluster_sizes(
        assignments.join(coordinates.select("item_id"), "item_id", "left_semi")
    ).withColumnRenamed("size", "n")
    own = F.col("other") == F.col("cluster_id")
    scored = (
        totals.join(sizes.withColumnRenamed("cluster_id", "other"), ["cluster_run_id", "other"])
        .join(points.select("cluster_run_id", "point", "cluster_id", "weight"), ["cluster_run_id", "point"])
        .groupBy("cluster_run_id", "point", "cluster_id", "weight")
        .agg(
            F.max(F.when(own, F.col("total"))).alias("inside"),
            F.max(F.when(own, F.col("n"))).alias("n"),
            F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"),
        )
        .withColumn("a", F.when(F.col("n") > 1, F.col("inside") / (F.col("n") - 1)))
        .withColumn(
            "s",
            F.when(F.col("a").isNull() | (F.greatest("a", "b") == 0), F.lit(0.0)).otherwise(
                (F.col("b") - F.col("a")) / F.greatest("a", "b")
            ),
        )
    )
    result = scored.groupBy("cluster_run_id").agg(
        (F.sum(F.col("s") * F.col("weight")) / F.sum("weight")).alias("value"),
        F.count_distinct("cluster_id").alias("k"),
        F.max("n").alias("largest"),
    )
    defined = (F.col("k") >= 2) & (F.col("largest") > 1)
    return result.select(
        "cluster_run_id", F.when(defined, F.round("value", SILHOUETTE_DECIMALS)).alias("silhouette")
    )


def squared_silhouette(assignments: DataFrame, coordinates: DataFrame) -> float | None:
    """Silhouette of one run under squared Euclidean distance, linear in the rows.

    A different figure from ``silhouette``: the mean squared distance from a
    point to a cluster follows from the cluster's size, mean and mean squared
    length, so points meet clusters and never other points.
    """
    data = (
        assignments.filter("cluster_id >= 0")
        .join(coordinates.select("item_id", "coordinates"), "item_id")
        .select(
            array_to_vector(V.as_doubles(F.col("coordinates"))).alias("features"),
            F.col("cluster_id").cast("int").alias("prediction"),
        )
    )
    if data.select("prediction").distinct().limit(2).count() < 2:
        return None
    return float(ClusteringEvaluator().evaluate(data))


def with_silhouette(metrics: DataFrame, scores: DataFrame) -> DataFrame:
    return metrics.join(scores, "cluster_run_id", "left")


def quality_band(score):
    """Display band of a critique score."""
    return F.when(score >= 0.7, "success").when(score >= 0.4, "warn").otherwise("danger")
