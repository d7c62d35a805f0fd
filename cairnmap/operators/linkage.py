"""Spanning trees and the small steps that work on a bounded number of nodes.

The tree search runs in Spark tasks over index ranges; the points (checked to
fit a broadcast) and the component labels are shared with the tasks each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

_BLOCK = 512


def spatial_order(points: np.ndarray, size: int = _BLOCK) -> np.ndarray:
    """Order that keeps near points together: split at the median of the widest side."""
    stack, out = [np.arange(len(points))], []
    while stack:
        rows = stack.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        part = points[rows]
        side = int(np.argmax(part.max(0) - part.min(0)))
        half = len(rows) // 2
        order = np.argpartition(part[:, side], half)
        stack.append(rows[order[half:]])
        stack.append(rows[order[:half]])
    return np.concatenate(out) if out else np.arange(0)


def _boxes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = range(0, len(points), _BLOCK)
    return np.array([points[s:s + _BLOCK].min(0) for s in starts]), np.array([points[s:s + _BLOCK].max(0) for s in starts])


def _outgoing(block: int, x, core, radius, label, ids, low, high):
    """Cheapest edge from each point of a block to another component, ties by ids.

    Blocks are visited by the distance of their boxes and left out once that
    alone exceeds every best edge found so far.
    """
    first, last = block * _BLOCK, min((block + 1) * _BLOCK, len(x))
    a, own = x[first:last], label[first:last]
    best = np.full(len(a), np.inf)
    lo, hi, target = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), np.full(len(a), -1)
    gap = np.maximum(0.0, np.maximum(low - high[block], low[block] - high))
    bound = np.sqrt((gap * gap).sum(1)) - 2.0 * radius.max()
    one = own[0] if (own == own[0]).all() else None
    for other in np.argsort(bound, kind="stable"):
        if bound[other] > best.max() * (1 + 1e-9):
            break
        start, stop = other * _BLOCK, min((other + 1) * _BLOCK, len(x))
        theirs = label[start:stop]
        if one is not None and (theirs == one).all():
            continue
        diff = a[:, None, :] - x[None, start:stop, :]
        reach = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff)) - radius[first:last, None] - radius[None, start:stop]
        reach = np.maximum(reach, np.maximum(core[first:last, None], core[None, start:stop]))
        reach[own[:, None] == theirs[None, :]] = np.inf
        least = reach.min(1)
        for row in np.nonzero((least <= best) & np.isfinite(least))[0]:
            ties = np.nonzero(reach[row] == least[row])[0]
            mine, theirs_ids = ids[first + row], ids[start + ties]
            small, large = np.minimum(mine, theirs_ids), np.maximum(mine, theirs_ids)
            pick = np.lexsort((large, small))[0]
            if least[row] < best[row] or (small[pick], large[pick]) < (lo[row], hi[row]):
                best[row], lo[row], hi[row], target[row] = least[row], small[pick], large[pick], start + ties[pick]
    return best, lo, hi, target


def _find(parent: np.ndarray, node: int) -> int:
    while parent[node] != node:
        parent[node] = parent[parent[node]]
        node = parent[node]
    return node


def _roots(parent: np.ndarray) -> np.ndarray:
    """Root of every node by pointer doubling."""
    root = parent[parent]
    while not np.array_equal(root, root[root]):
        root = root[root]
    return root


def spanning_tree(spark: SparkSession, ids: np.ndarray, points: np.ndarray, core: np.ndarray | None = None,
                  radius: np.ndarray | None = None):
    """Minimum spanning tree under max(core, core, distance): (from, to, weight) by input position.

    A radius per point shortens its distances: points that stand for many rows
    are as far apart as their edges. Boruvka rounds: tasks look for the cheapest edge out of every component, the
    driver joins components. Equal weights are ordered by the ids of both ends,
    so the tree does not depend on how the work was cut.
    """
    n = len(points)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    order = spatial_order(points)
    x, who = points[order], np.asarray(ids)[order]
    reach = np.zeros(n) if core is None else np.asarray(core, float)[order]
    around = np.zeros(n) if radius is None else np.asarray(radius, float)[order]
    low, high = _boxes(x)
    n_blocks = len(low)
    context = spark.sparkContext
    fixed = context.broadcast((x, reach, around, who, low, high))
    parent = np.arange(n)
    label = np.arange(n)
    edges: list[tuple[int, int, float]] = []
    while len(edges) < n - 1:
        state = context.broadcast(label)

        def search(batches: Iterator[pd.DataFrame], state=state) -> Iterator[pd.DataFrame]:
            xs, cores, radii, names, lows, highs = fixed.value
            labels = state.value
            for batch in batches:
                for block in batch["id"]:
                    w, lo, hi, target = _outgoing(int(block), xs, cores, radii, labels, names, lows, highs)
                    at = np.arange(len(w)) + int(block) * _BLOCK
                    found = pd.DataFrame({"component": labels[at], "w": w, "lo": lo, "hi": hi, "a": at, "b": target})
                    found = found[found["b"] >= 0].sort_values(["component", "w", "lo", "hi"])
                    yield found.groupby("component", sort=False).head(1)

        tasks = min(n_blocks, max(2 * context.defaultParallelism, 1))
        found = spark.range(0, n_blocks, 1, tasks).mapInPandas(
            search, "component long, w double, lo long, hi long, a long, b long"
        ).toPandas()
        best = found.sort_values(["component", "w", "lo", "hi"]).groupby("component").head(1)
        for a, b, w in best.sort_values(["w", "lo", "hi"])[["a", "b", "w"]].itertuples(index=False):
            left, right = _find(parent, int(a)), _find(parent, int(b))
            if left != right:
                parent[max(left, right)] = min(left, right)
                edges.append((int(a), int(b), float(w)))
        label = _roots(parent)
        state.destroy()
    fixed.destroy()
    a, b, w = (np.array(c) for c in zip(*edges))
    return order[a], order[b], w


def tree_order(ids: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Edges from light to heavy, equal weights by the ids of their ends."""
    x, y = np.asarray(ids)[a], np.asarray(ids)[b]
    return np.lexsort((np.maximum(x, y), np.minimum(x, y), w))


def cut_tree(n: int, a: np.ndarray, b: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Component of each node when only the kept edges remain."""
    parent = np.arange(n)
    for left, right in zip(a[keep], b[keep]):
        left, right = _find(parent, int(left)), _find(parent, int(right))
        if left != right:
            parent[max(left, right)] = min(left, right)
    return _roots(parent)


def number_by_first_id(ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Renumber clusters 0, 1, ... by their smallest id; noise stays -1."""
    out = np.full(len(labels), -1, np.int64)
    seen: dict[int, int] = {}
    for row in np.argsort(ids, kind="stable"):
        if labels[row] >= 0:
            out[row] = seen.setdefault(int(labels[row]), len(seen))
    return out


def linkage_merges(points: np.ndarray, weights: np.ndarray, linkage: str) -> list[tuple[float, int, int]]:
    """(height, a, b) of the merges of a bounded number of weighted points by ward, complete or average linkage, by height; a < b stands for both afterwards.

    Nearest-neighbour chain with the Lance-Williams update; a node of weight w
    counts as w items at its place.
    """
    n = len(points)
    gap = points[:, None, :] - points[None, :, :] if n * n * points.shape[1] <= 20_000_000 else None
    if gap is not None:
        d = np.einsum("ijk,ijk->ij", gap, gap)
    else:
        d = np.vstack([((points - p) ** 2).sum(1) for p in points])
    size = weights.astype(float).copy()
    if linkage == "ward":
        d = d * 2.0 * size[:, None] * size[None, :] / (size[:, None] + size[None, :])
    else:
        d = np.sqrt(d)
    np.fill_diagonal(d, np.inf)
    alive = np.ones(n, bool)
    merges, chain = [], []
    while alive.sum() > 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        top = chain[-1]
        row = d[top]
        near = int(np.argmin(row))
        if len(chain) > 1 and row[chain[-2]] <= row[near]:
            near = chain[-2]
        if len(chain) > 1 and near == chain[-2]:
            chain.pop(), chain.pop()
            a, b = min(top, near), max(top, near)
            height = d[a, b]
            if linkage == "ward":
                new = ((size[a] + size) * d[a] + (size[b] + size) * d[b] - size * height) / (size[a] + size[b] + size)
            elif linkage == "average":
                new = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
            else:
                new = np.maximum(d[a], d[b])
            new[~alive] = np.inf
            new[[a, b]] = np.inf
            d[a], d[:, a] = new, new
            d[b], d[:, b] = np.inf, np.inf
            alive[b] = False
            size[a] += size[b]
            merges.append((height, a, b))
        else:
            chain.append(near)
    # The chain finds merges out of order; by height they form the same tree.
    return [merges[i] for i in np.argsort([m[0] for m in merges], kind="stable")]


def merge_by_linkage(points: np.ndarray, weights: np.ndarray, n_clusters: int, linkage: str) -> np.ndarray:
    """Cluster of each of a bounded number of weighted points; see ``linkage_merges``."""
    n = len(points)
    merges = linkage_merges(points, weights, linkage)
    kept = merges[: max(0, n - max(1, n_clusters))]
    return cut_tree(n, np.array([m[1] for m in kept], int), np.array([m[2] for m in kept], int), np.arange(len(kept)))
