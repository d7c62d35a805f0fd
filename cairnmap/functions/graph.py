"""Connected components as joins and aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cairnmap.session import written

# Edges that a task contracts at a time.
CONTRACT_EDGES = 1 << 20


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node each is connected to, by union-find."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    for x, y in zip(at[: len(a)].tolist(), at[len(a):].tolist()):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    for i, p in enumerate(parent):  # a parent is never larger than its child
        parent[i] = parent[p]
    return nodes, nodes[np.array(parent, np.int64)] if len(nodes) else nodes


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of a task as stars around the smallest node, a bounded number of edges at a time."""
    held: list[pd.DataFrame] = []
    size = 0

    def stars() -> pd.DataFrame:
        edges = pd.concat(held)
        nodes, root = roots(edges["a"].to_numpy(), edges["b"].to_numpy())
        other = nodes != root
        return pd.DataFrame({"a": nodes[other], "b": root[other]})

    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= CONTRACT_EDGES:
            yield stars()
            held, size = [], 0
    if size:
        yield stars()


def _together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every node of a bounded number of edges with its component."""
    held = [b for b in batches if len(b)]
    if held:
        edges = pd.concat(held)
        nodes, root = roots(edges["a"].to_numpy(), edges["b"].to_numpy())
        yield pd.DataFrame({"node": nodes, "component": root})


def connected_components(edges: DataFrame, left: str, right: str, together: int = CONTRACT_EDGES) -> DataFrame:
    """(node, component): each node (a long) of an edge between two nodes with the smallest node it is connected to.

    Tasks first contract their own edges to stars. Then, in every round, each node takes the smallest of itself and
    its neighbours, and what that one takes, and the edges are drawn anew between what their ends have become; ends that
    became the same drop out. Nodes and edges shrink from round to round; once at most ``together`` edges are left, one task
    joins them all. The rounds' maps are composed from the last, smallest one back. Edges are never gathered per node: minima are partial sums, and a
    hub's edges are an ordinary skewed join. Null ends and loops are ignored.
    """
    pairs = edges.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b")).filter("a <> b")
    maps: list[DataFrame] = []
    while True:
        stars = pairs.mapInPandas(_contract, "a long, b long").distinct()
        links = written(stars.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*"))
        if links.count() <= 2 * together:  # each edge stands in both directions
            maps.append(written(links.filter("a > b").repartition(1).mapInPandas(_together, "node long, component long")))
            break
        lowest = links.groupBy("a").agg(F.min("b").alias("_b")).select(F.col("a").alias("node"), F.least("a", "_b").alias("low"))
        hop = lowest.select(F.col("node").alias("_via"), F.col("low").alias("_far"))
        step = written(lowest.join(hop, lowest["low"] == hop["_via"]).select("node", F.col("_far").alias("component")))
        maps.append(step)
        one_way = links.filter("a > b")
        to_a, to_b = (step.select(F.col("node").alias(f"_n{x}"), F.col("component").alias(f"_c{x}")) for x in "ab")
        pairs = written(one_way.join(to_a, one_way["a"] == to_a["_na"]).join(to_b, one_way["b"] == to_b["_nb"]).filter("_ca <> _cb").select(
            F.col("_ca").alias("a"), F.col("_cb").alias("b")))
        if pairs.isEmpty():
            break
    found = maps.pop()
    while maps:
        step = maps.pop()
        later = found.select(F.col("node").alias("_via"), F.col("component").alias("_last"))
        found = written(step.join(later, step["component"] == later["_via"], "left").select("node", F.coalesce("_last", "component").alias("component")))
    return found
