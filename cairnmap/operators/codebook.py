"""Two-level maps: cluster the nodes of a codebook, then give each item its cell's cluster."""

from __future__ import annotations

from inspect import signature

from pyspark.sql import DataFrame, functions as F

from cairnmap.operators.agglomerative import agglomerative, agglomerative_microclusters
from cairnmap.operators.hdbscan import hdbscan, hdbscan_microclusters

METHODS = {
    "hdbscan": hdbscan, "agglomerative": agglomerative,
    "hdbscan_microclusters": hdbscan_microclusters, "agglomerative_microclusters": agglomerative_microclusters,
}


def run_method(method: str, coordinates: DataFrame, params: dict) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown clustering method {method!r}")
    # parameters the method does not name are meant for others
    accepted = signature(METHODS[method]).parameters
    return METHODS[method](coordinates, **{k: v for k, v in params.items() if k in accepted})


def cluster_nodes(codebook: DataFrame, method: str, params: dict) -> DataFrame:
    """Cluster and probability per cell of the map."""
    nodes = codebook.select(F.col("node_index").alias("item_id"), F.col("weight").alias("coordinates"))
    found = run_method(method, nodes, params)
    return codebook.select("node_index", "grid_i", "grid_j").join(
        found.withColumnRenamed("item_id", "node_index"), "node_index"
    )


def propagate(coordinates: DataFrame, node_clusters: DataFrame) -> DataFrame:
    """Cluster of each item from its cell; the node side is one row per cell."""
    cells = coordinates.select(
        "item_id", F.col("coordinates")[0].cast("int").alias("grid_i"), F.col("coordinates")[1].cast("int").alias("grid_j")
    )
    return cells.join(
        node_clusters.select("grid_i", "grid_j", "cluster_id", "membership_probability"), ["grid_i", "grid_j"]
    ).select("item_id", "cluster_id", "membership_probability")


def cluster_codebook(coordinates: DataFrame, codebook: DataFrame, method: str, params: dict) -> DataFrame:
    return propagate(coordinates, cluster_nodes(codebook, method, params))
