"""The merges of a spanning tree in the order of its edges, contracted in weight ranges.

Edges are ranked once. A group of more edges than a task should hold is halved by rank: the components of the lighter half become
the nodes of the heavier one, named by their last merge, after which both halves stand alone. All groups of a level are halved
together, by one search for components, since no node is in two groups; there are as many levels as halvings from all edges
to ``group_edges``. Then every group is merged in one task, all of them in parallel.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cairnmap.functions.graph import connected_components
from cairnmap.functions.ranking import rank_rows
from cairnmap.session import written

GROUP_EDGES = 1 << 18

_MERGE = "node long, left long, right long, weight double, left_size long, right_size long"


def _merge_group(n: int):
    """Merges of a group's edges, in rank order; an edge's ends bear the size of what they stand for."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        ends, at = np.unique(np.concatenate([group["i"].to_numpy(), group["j"].to_numpy()]), return_inverse=True)
        at = at.reshape(2, -1)
        size = np.zeros(len(ends), np.int64)
        size[at[0]], size[at[1]] = group["i_size"].to_numpy(), group["j_size"].to_numpy()
        parent, top, size = list(range(len(ends))), ends.tolist(), size.tolist()

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        out = []
        for rank, i, j, w in zip(group["rank"].tolist(), at[0].tolist(), at[1].tolist(), group["weight"].tolist()):
            i, j = root(i), root(j)
            out.append((n + rank, top[i], top[j], w, size[i], size[j]))
            if size[i] < size[j]:
                i, j = j, i
            parent[j], top[i], size[i] = i, n + rank, size[i] + size[j]
        return pd.DataFrame(out, columns=[c.split()[0] for c in _MERGE.split(", ")])

    return run


def merges(tree: DataFrame, n: int, group_edges: int = GROUP_EDGES) -> DataFrame:
    """(node, left, right, weight, left_size, right_size) of each edge (i, j, weight) of a tree over the nodes 0 to n - 1.

    ``node`` is n plus the edge's rank by weight, then by its ends; ``left`` and ``right`` are what it joins: nodes or
    earlier merges, with the number of nodes in each.
    """
    edges = tree.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.col("weight").cast("double"))
    one = F.lit(1).cast("long")
    work = rank_rows(edges, [F.col("weight"), F.col("i"), F.col("j")], "rank", n - 1).withColumn("i_size", one).withColumn("j_size", one)
    halvings = max(0, math.ceil(math.log2(max(1, n - 1) / group_edges)))
    least = max(1, -(-(n - 1) // (1 << halvings)))
    for level in range(halvings - 1, -1, -1):
        width = least << level
        half = F.expr(f"(rank div {width}) % 2")
        light, heavy = work.filter(half == 0), work.filter(half == 1)
        found = connected_components(light, "i", "j")
        ends = light.select("i", F.col("i_size").alias("size")).union(light.select("j", "j_size")).distinct().withColumnRenamed("i", "node").join(found, "node")
        sizes = ends.groupBy("component").agg(F.sum("size").alias("_size"))
        last = light.join(found, light["i"] == found["node"]).groupBy("component").agg((F.max("rank") + n).alias("_to"))
        renamed = written(found.join(sizes, "component").join(last, "component").select("node", "_to", "_size"))
        for end in "ij":
            named = renamed.select(F.col("node").alias(end), F.col("_to").alias(f"_{end}"), F.col("_size").alias(f"_{end}_size"))
            heavy = heavy.join(named, end, "left").withColumn(end, F.coalesce(f"_{end}", end)).withColumn(f"{end}_size", F.coalesce(f"_{end}_size", f"{end}_size"))
        work = written(light.unionByName(heavy.select(*light.columns)))
    return written(work.groupBy(F.expr(f"rank div {least}")).applyInPandas(_merge_group(n), _MERGE))
