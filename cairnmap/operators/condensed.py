"""Condensed cluster trees as joins and sums.

A merge with at least ``min_size`` rows is large. Where both sides are large, two clusters become one; elsewhere the smaller side only joins. So the
clusters are the components of large merges linked to the merge above them, unless that unites two clusters. A row
leaves its cluster at the first large merge above it. Stabilities are sums over (cluster, density); the choice of clusters is a fold over the
cluster tree, made in one task while the tree is small and by rounds of joins beyond: nodes whose children are known are
finished, chains of nodes with one open child are doubled as functions x -> max(low, add + x).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cairnmap.functions.graph import connected_components
from cairnmap.session import written

# Clusters whose tree one task folds.
TREE_ROWS = 1 << 18


def density(weight: Column) -> Column:
    return F.when(weight <= 0, F.lit(math.inf)).otherwise(1.0 / weight)


def condense(merged: DataFrame, n: int, min_size: int) -> tuple[DataFrame, DataFrame]:
    """(cluster, parent, birth, stability, deepest) and (node, cluster, density) of the rows, from the ``merges`` of n >= min_size >= 2 rows.

    Clusters are named by their largest merge; the root has a null parent and birth 0.
    """
    side = lambda a, b: F.struct(F.col(a).alias("child"), F.col(f"{a}_size").alias("size"), F.col(f"{b}_size").alias("beside"))
    up = merged.select("node", "weight", F.explode(F.array(side("left", "right"), side("right", "left"))).alias("e")).select("node", "weight", "e.*")
    up = written(up.withColumn("total", F.col("size") + F.col("beside")))
    large = merged.filter(F.col("left_size") + F.col("right_size") >= min_size).select("node")
    # clusters: a large child belongs to the same one as the merge above it unless the other child is large as well
    chains = up.filter((F.col("size") >= min_size) & (F.col("beside") < min_size)).select("child", "node")
    found = connected_components(chains, "child", "node")
    tops = found.groupBy("component").agg(F.max("node").alias("cluster"))
    chained = found.join(tops, "component").select("node", "cluster")
    member = written(large.join(chained, "node", "left").select("node", F.coalesce("cluster", "node").alias("cluster")))
    # rows: up through small merges to the first large one
    small = up.filter(F.col("total") < min_size).select("child", "node")
    groups = connected_components(small, "child", "node")
    last = groups.groupBy("component").agg(F.max("node").alias("top"))
    through = groups.join(last, "component").filter(F.col("node") < n).select("node", "top")
    leaving = up.filter((F.col("size") < min_size) & (F.col("total") >= min_size)).select(F.col("child").alias("top"), F.col("node").alias("at"), density(F.col("weight")).alias("density"))
    alone = leaving.filter(F.col("top") < n).select(F.col("top").alias("node"), "at", "density")
    rows = through.join(leaving, "top").select("node", "at", "density").union(alone)
    rows = written(rows.join(member.select(F.col("node").alias("at"), "cluster"), "at").select("node", "cluster", "density"))

    above = up.filter((F.col("size") >= min_size) & (F.col("beside") >= min_size)).select(F.col("child").alias("cluster"), "size", F.col("node").alias("_above"), density(F.col("weight")).alias("birth"))
    born = above.join(member.select(F.col("node").alias("_above"), F.col("cluster").alias("parent")), "_above").drop("_above")
    clusters = written(member.select("cluster").distinct().join(born, "cluster", "left").select("cluster", "parent", F.coalesce("birth", F.lit(0.0)).alias("birth"), "size"))
    events = rows.groupBy("cluster", "density").agg(F.count("*").alias("count")).union(
        clusters.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("cluster"), F.col("birth").alias("density")).agg(F.sum("size").alias("count")))
    gained = (F.col("density") - F.col("birth")) * F.col("count")  # not a number where a cluster of copies begins and ends at once
    sums = events.join(clusters.select("cluster", "birth"), "cluster").groupBy("cluster").agg(
        F.sum(F.when(~F.isnan(gained), gained)).alias("stability"), F.max("density").alias("deepest"))
    return written(clusters.drop("size").join(sums, "cluster", "left").select(
        "cluster", "parent", "birth", F.coalesce("stability", F.lit(0.0)).alias("stability"), F.coalesce("deepest", F.lit(0.0)).alias("deepest"))), rows


class Tree:
    """A cluster tree in memory: parents before children, 0 is the root."""

    def __init__(self, parent: np.ndarray, birth: np.ndarray, stability: np.ndarray):
        self.parent, self.birth, self.stability = parent, birth, stability
        self.children: list[list[int]] = [[] for _ in parent]
        for c, p in enumerate(parent.tolist()):
            if p >= 0:
                self.children[p].append(c)


def select_clusters(tree: Tree, method: str = "eom", epsilon: float = 0.0) -> list[int]:
    """Clusters to report; the root never counts as one."""
    count = len(tree.parent)
    if method == "leaf":
        chosen = [c for c in range(1, count) if not tree.children[c]]
    else:
        value = list(tree.stability)
        keep = [True] * count
        for cluster in range(count - 1, 0, -1):
            below = sum(value[c] for c in tree.children[cluster])
            if tree.children[cluster] and below > value[cluster]:
                keep[cluster], value[cluster] = False, below
        chosen, stack = [], list(tree.children[0])
        while stack:
            cluster = stack.pop()
            if keep[cluster]:
                chosen.append(cluster)
            else:
                stack.extend(tree.children[cluster])
    if epsilon > 0:
        chosen = _merge_close(tree, chosen, epsilon)
    return sorted(chosen)


def _merge_close(tree: Tree, chosen: list[int], epsilon: float) -> list[int]:
    """Replace clusters born closer than ``epsilon`` by their first ancestor that is not."""
    out: set[int] = set()
    for cluster in chosen:
        while tree.birth[cluster] > 0 and 1.0 / tree.birth[cluster] < epsilon and tree.parent[cluster] > 0:
            cluster = int(tree.parent[cluster])
        out.add(cluster)

    def inside(cluster: int) -> bool:
        above = tree.parent[cluster]
        while above > 0:
            if above in out:
                return True
            above = tree.parent[above]
        return False

    return [c for c in out if not inside(c)]


def _owners_in_one_task(method: str, epsilon: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cluster", ascending=False)  # a merge lies above all smaller ones in its subtree
        names = group["cluster"].to_numpy(np.int64)
        above = group["parent"].fillna(-1).to_numpy(np.int64)
        parent = np.where(above < 0, -1, len(names) - 1 - np.searchsorted(names[::-1], above))
        tree = Tree(parent, group["birth"].to_numpy(float), group["stability"].to_numpy(float))
        owner, picked = np.full(len(names), -1, np.int64), set(select_clusters(tree, method, epsilon))
        for c in range(1, len(names)):
            owner[c] = c if c in picked else owner[parent[c]]
        mine = owner >= 0
        return pd.DataFrame({"cluster": names[mine], "owner": names[owner[mine]]})

    return run


def owners(clusters: DataFrame, method: str = "eom", epsilon: float = 0.0, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(cluster, owner): the chosen cluster that each cluster lies in or is; clusters outside any are left out.

    ``eom`` chooses by stability, ``leaf`` the clusters without children; clusters born at a distance below ``epsilon`` give way to their first ancestor
    that is not. The root is never chosen.
    """
    if method not in ("eom", "leaf"):
        raise ValueError(f"unknown cluster selection method {method!r}")
    slim = clusters.select("cluster", "parent", "birth", "stability")
    if slim.count() <= tree_rows:
        return slim.groupBy().applyInPandas(_owners_in_one_task(method, epsilon), "cluster long, owner long")
    inner = slim.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("cluster")).agg(F.min("cluster").alias("one"), F.max("cluster").alias("two"))
    tree = written(slim.join(inner, "cluster", "left"))
    if method == "leaf":
        kept = tree.select("cluster", "parent", F.col("one").isNull().alias("keep"))
    else:
        value = _values(tree)
        below = [value.select(F.col("cluster").alias(c), F.col("value").alias(f"{c}_value")) for c in ("one", "two")]
        kept = tree.join(below[0], "one", "left").join(below[1], "two", "left").select(
            "cluster", "parent", (F.col("one").isNull() | ~(F.col("one_value") + F.col("two_value") > F.col("stability"))).alias("keep"))
    own = _topmost(kept)
    if epsilon > 0:
        own = _topmost(_widened(tree, own.select(F.col("owner").alias("cluster")).distinct(), epsilon))
    return own


def _values(tree: DataFrame) -> DataFrame:
    """(cluster, value): the larger of a cluster's stability and the values of its two children together."""
    state = written(tree.select(
        "cluster", F.col("one").alias("a"), F.col("two").alias("b"), F.col("stability").alias("low"), F.lit(0.0).alias("add"),
        F.when(F.col("one").isNull(), F.col("stability")).alias("value")))
    while not state.filter("value IS NULL").isEmpty():
        look = lambda c: state.select(F.col("cluster").alias(c), F.col("value").alias(f"{c}_value"), F.col("a").alias(f"{c}_a"), F.col("b").alias(f"{c}_b"),
                                      F.col("low").alias(f"{c}_low"), F.col("add").alias(f"{c}_add"))
        open_ = state.filter("value IS NULL")
        # an open node has one open child (b is null) or two
        seen = open_.join(look("a"), "a").join(look("b"), "b", "left")
        single, first, second = F.col("b").isNull(), F.col("a_value"), F.col("b_value")
        value = F.when(single, F.greatest("low", F.col("add") + first)).otherwise(F.greatest("low", first + second))
        left_done, right_done = ~single & first.isNotNull() & second.isNull(), ~single & first.isNull() & second.isNotNull()
        chain = single & first.isNull() & F.col("a_b").isNull()
        after = seen.select(
            "cluster",
            F.when(left_done, F.col("b")).when(chain, F.col("a_a")).otherwise(F.col("a")).alias("a"),
            F.when(left_done | right_done, F.lit(None)).otherwise(F.col("b")).cast("long").alias("b"),
            F.when(chain, F.greatest("low", F.col("add") + F.col("a_low"))).otherwise(F.col("low")).alias("low"),
            F.when(chain, F.col("add") + F.col("a_add")).when(left_done, first).when(right_done, second).otherwise(F.col("add")).alias("add"),
            F.when(single & first.isNotNull() | ~single & first.isNotNull() & second.isNotNull(), value).alias("value"))
        state = written(state.filter("value IS NOT NULL").unionByName(after))
    return state.select("cluster", "value")


def _topmost(kept: DataFrame) -> DataFrame:
    """(cluster, owner): the highest kept cluster on the way from each cluster to the root, itself included, the root not."""
    inner = F.col("parent").isNotNull()
    state = written(kept.select("cluster", F.col("parent").alias("up"), F.when(F.col("keep") & inner, F.col("cluster")).alias("owner")))
    while not state.filter("up IS NOT NULL").isEmpty():
        above = state.select(F.col("cluster").alias("up"), F.col("up").alias("_up"), F.col("owner").alias("_owner"))
        state = written(state.join(above, "up", "left").select("cluster", F.col("_up").alias("up"), F.coalesce("_owner", "owner").alias("owner")))
    return state.filter("owner IS NOT NULL").select("cluster", "owner")


def _widened(tree: DataFrame, chosen: DataFrame, epsilon: float) -> DataFrame:
    """(cluster, parent, keep): the chosen clusters, each replaced by its first ancestor born no closer than ``epsilon``."""
    root = tree.filter("parent IS NULL").first()["cluster"]
    close = (F.col("birth") > 0) & (1.0 / F.col("birth") < epsilon) & (F.col("parent") != root)
    state = written(tree.select("cluster", F.when(close, F.col("parent")).alias("up"), F.col("cluster").alias("last")))
    while not state.filter("up IS NOT NULL").isEmpty():
        above = state.select(F.col("cluster").alias("up"), F.col("up").alias("_up"), F.col("last").alias("_last"))
        state = written(state.join(above, "up", "left").select("cluster", F.col("_up").alias("up"), F.coalesce("_last", "last").alias("last")))
    out = state.join(chosen, "cluster", "left_semi").select(F.col("last").alias("cluster")).distinct().withColumn("_kept", F.lit(True))
    return tree.select("cluster", "parent").join(out, "cluster", "left").select("cluster", "parent", F.coalesce("_kept", F.lit(False)).alias("keep"))
