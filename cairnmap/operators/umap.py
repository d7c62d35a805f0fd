"""UMAP-style layouts (McInnes et al. 2018).

``umap`` lays out all items together, at every size: positions and edges are tables, a round of epochs is a join of both and a
group per share of the items. Items move against the positions of the last round, and random draws are hashes, so the
result depends neither on partitions nor on how tasks were scheduled.

``umap_landmarks`` is a coarser operator: a seeded set of landmarks is laid out and every other item is placed against it: a weighted
mean of its nearest landmarks, then the same forces with the landmarks held still.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cairnmap import SEED
from cairnmap.functions import vectors as V
from cairnmap.operators.neighbours import collect_matrix, knn, matrix, nearest_rows
from cairnmap.operators.pca import pca
from cairnmap.operators.sampling import seeded_pick
from cairnmap.operators.spectral import spectral_vectors
from cairnmap.session import discard, written

N_NEIGHBORS = 15
MIN_DIST = 0.1
MAX_LANDMARKS = 20_000
NEGATIVES = 5

# Positions in the pool that random others are drawn from, edges of a task, and edges of a part of a vertex.
POOL_ROWS, GROUP_EDGES, HUB_EDGES = 20_000, 200_000, 65_536

_EPOCHS_PER_ROUND = 10
_CLIP = 4.0


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a, b of 1 / (1 + a d^(2b)) fitted to a plateau of ``min_dist`` with an exponential tail."""
    d = np.linspace(1e-6, spread * 3, 300)
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    p = np.array([1.0, 1.0])
    damping, last = 1e-3, np.inf
    for _ in range(200):
        power = d ** (2 * p[1])
        f = 1.0 / (1.0 + p[0] * power)
        miss = f - want
        if (error := miss @ miss) > last:
            p, damping = kept, damping * 10
        else:
            kept, last, damping = p.copy(), error, max(damping / 3, 1e-12)
        power = d ** (2 * p[1])
        f = 1.0 / (1.0 + p[0] * power)
        jacobian = np.stack([-power * f * f, -p[0] * power * 2 * np.log(d) * f * f], 1)
        normal = jacobian.T @ jacobian
        p = p - np.linalg.solve(normal + damping * np.diag(np.diag(normal)), jacobian.T @ (f - want))
        p = np.maximum(p, 1e-3)
    return float(kept[0]), float(kept[1])


def smooth_weights(distances: np.ndarray) -> np.ndarray:
    """Membership of each neighbour; rows hold ascending distances, missing ones are inf.

    The width is found by bisection so that a row's weights sum to log2 of the
    neighbourhood size; the nearest non-zero neighbour has weight 1.
    """
    finite = np.isfinite(distances)
    k = distances.shape[1] + 1
    target = math.log2(max(k, 2))
    positive = np.where(finite & (distances > 0), distances, np.inf)
    rho = positive.min(1)
    rho = np.where(np.isfinite(rho), rho, 0.0)
    gap = np.where(finite, np.maximum(distances - rho[:, None], 0.0), np.inf)
    low, high, mid = np.zeros(len(rho)), np.full(len(rho), np.inf), np.ones(len(rho))
    for _ in range(64):
        total = np.exp(-gap / mid[:, None]).sum(1)
        above = total > target
        high = np.where(above, mid, high)
        low = np.where(above, low, mid)
        mid = np.where(np.isinf(high), mid * 2, (low + high) / 2)
    mean = np.where(finite, distances, 0.0).sum(1) / np.maximum(finite.sum(1), 1)
    mid = np.maximum(mid, 1e-3 * np.where(rho > 0, mean, max(float(mean.mean()), 1e-12)))
    return np.exp(-gap / mid[:, None])


def fuzzy_graph(neighbours: DataFrame, k: int) -> DataFrame:
    """Undirected weights a + b - ab from neighbour lists (query_id, neighbor_id, distance, rank).

    One row per pair with item_id below other_id. A list has k entries, so the
    rows of one item always fit a task.
    """
    lists = neighbours.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "distance", "neighbor_id"))).alias("list")
    ).select(
        "query_id", F.transform("list", lambda e: e["distance"]).alias("distances"),
        F.transform("list", lambda e: e["neighbor_id"]).alias("others"),
    )

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            sizes = batch["distances"].map(len).to_numpy()
            padded = np.full((len(batch), k), np.inf)
            padded[np.arange(k)[None, :] < sizes[:, None]] = np.concatenate(batch["distances"].to_numpy())
            weights = smooth_weights(padded)[np.arange(k)[None, :] < sizes[:, None]]
            yield pd.DataFrame({
                "a": np.repeat(batch["query_id"].to_numpy(), sizes), "b": np.concatenate(batch["others"].to_numpy()), "w": weights,
            })

    directed = lists.mapInPandas(weigh, "a long, b long, w double")
    # At most two rows per pair; their product is only there when both directions are.
    product = F.when(F.count("*") == 2, F.max("w") * F.min("w")).otherwise(0.0)
    return directed.groupBy(F.least("a", "b").alias("item_id"), F.greatest("a", "b").alias("other_id")).agg(
        (F.sum("w") - product).alias("weight")
    )


def _start(placed: DataFrame, dims: int, seed: int) -> DataFrame:
    """(id, y): the coordinates of (item_id, coordinates) scaled to +-10, with a little noise from a hash of seed, id and axis.

    Sums over tasks differ in their last digits, so the scaled coordinates are rounded.
    """
    top = placed.agg(F.max(F.array_max(F.transform("coordinates", F.abs)))).first()[0] or 0.0
    scale = 10.0 / top if top > 1e-9 else 1.0
    filled = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.get("coordinates", i), F.lit(0.0)))

    def shifted(x, i):
        noise = F.pmod(F.xxhash64(F.lit(seed), F.col("item_id"), i), F.lit(1 << 20)) / float(1 << 20) - 0.5
        return F.round(x * scale, 4) + 2e-4 * noise

    return placed.select(F.col("item_id").alias("id"), F.transform(filled, shifted).alias("y"))


def _active(weight: np.ndarray, epoch: int) -> np.ndarray:
    """Edges due in an epoch: one of weight w is used w times as often as the heaviest."""
    return np.floor((epoch + 1) * weight) > np.floor(epoch * weight)


def _move(y, rows, targets, repel_from, alpha, a, b, rng, pull: float, attempts: int):
    """One step of some points: attracted along edges, repelled by random others."""
    force = np.zeros_like(y)
    gap = y[rows] - targets
    d2 = (gap * gap).sum(1)
    strength = np.where(d2 > 0, -2.0 * a * b * np.power(np.maximum(d2, 1e-12), b - 1.0) / (1.0 + a * np.power(d2, b)), 0.0)
    np.add.at(force, rows, np.clip(pull * strength[:, None] * gap, -_CLIP, _CLIP))
    heads = np.repeat(rows, attempts)
    gap = y[heads] - repel_from[rng.integers(len(repel_from), size=len(heads))]
    d2 = (gap * gap).sum(1)
    strength = np.where(d2 > 0, 2.0 * b / ((0.001 + d2) * (1.0 + a * np.power(d2, b))), 0.0)
    np.add.at(force, heads, np.clip(strength[:, None] * gap, -_CLIP, _CLIP))
    return y + alpha * force


def _advance(pool, begin: int, end: int, epochs: int, a: float, b: float, seed: int):
    """Some items (head, part) through the epochs: a row per edge with the place of its far end (at), and a row per item and part with its own (y)."""

    def run(edges: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        group = edges.merge(places[["head", "part", "y"]], on=["head", "part"]).sort_values(["head", "part", "tail"])
        if group.empty:
            return pd.DataFrame({"id": np.zeros(0, np.int64), "y": []})
        heads, part = group["head"].to_numpy(np.int64), group["part"].to_numpy()
        code = np.concatenate([[0], np.cumsum((heads[1:] != heads[:-1]) | (part[1:] != part[:-1]))])
        first = np.searchsorted(code, np.arange(code[-1] + 1))
        y, fixed, w, items = matrix(group["y"].iloc[first]), matrix(group["at"]), group["w"].to_numpy(), heads[first]
        for epoch in range(begin, end):
            on = _active(w, epoch)
            y = _move_each(y, items, code[on], fixed[on], pool.value[1], 1.0 - epoch / epochs, a, b, (seed, epoch), 2.0)
        return pd.DataFrame({"id": items, "y": list(y)})

    return run


def _layout(start: DataFrame, graph: DataFrame, n: int, a: float, b: float, epochs: int, seed: int,
            pool_rows: int = POOL_ROWS, group_edges: int = GROUP_EDGES, hub_edges: int = HUB_EDGES) -> DataFrame:
    """(id, y) after all epochs, from (id, y) and the undirected graph (item_id, other_id, weight).

    A round joins every directed edge with the position its far end had after the last round and moves each near end through some
    epochs against those; a task holds a bounded number of edges. Positions are moved by shuffles, as a broadcast would pass all of them through
    the driver in every round. Random others come from a pool of positions drawn anew each round by a
    hash of the ids (all of them, if that many are few); which one repels in an epoch is a hash of seed, epoch, item and edge. A vertex
    with more than ``hub_edges`` edges is moved in parts, each against a hashed share of them, and takes the mean of their places.
    """
    spark = start.sparkSession
    top = graph.agg(F.max("weight")).first()[0]
    ends = F.array(F.struct(F.col("item_id").alias("head"), F.col("other_id").alias("tail")), F.struct(F.col("other_id").alias("head"), F.col("item_id").alias("tail")))
    edges = graph.select(F.explode(ends).alias("e"), (F.col("weight") / F.lit(top)).alias("w")).select("e.*", "w")
    parts = edges.groupBy("head").agg(F.ceil(F.count("*") / hub_edges).cast("int").alias("parts"))
    edges = edges.join(parts, "head").withColumn("part", F.pmod(F.xxhash64("tail"), F.col("parts")).cast("int"))
    edges, parts = written(edges), written(parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("head", "part"))
    groups = max(spark.sparkContext.defaultParallelism if n > group_edges // 64 else 1, -(-edges.count() // group_edges))
    dims = len(start.first()["y"])
    state = start
    for begin in range(0, epochs, _EPOCHS_PER_ROUND):
        slot = F.pmod(F.xxhash64(F.lit(seed), F.lit(begin), "id"), F.lit(1 << 30))
        drawn = state if n <= pool_rows else state.filter(slot < int((1 << 30) * (pool_rows + 4 * math.sqrt(pool_rows)) / n)).orderBy(slot, "id").limit(pool_rows)
        rows = drawn.toPandas().sort_values("id")  # at most pool_rows
        pool = spark.sparkContext.broadcast((rows["id"].to_numpy(np.int64), matrix(rows["y"])))

        far = state.select(F.col("id").alias("tail"), F.col("y").alias("at")).hint("shuffle_hash")
        near = state.select(F.col("id").alias("head"), "y").hint("shuffle_hash")
        group = F.pmod(F.xxhash64("head", "part"), F.lit(groups))
        met, own = edges.join(far, "tail").withColumn("_group", group), parts.join(near, "head").withColumn("_group", group)
        moved = met.groupBy("_group").cogroup(own.groupBy("_group")).applyInPandas(_advance(pool, begin, min(begin + _EPOCHS_PER_ROUND, epochs), epochs, a, b, seed), "id long, y array<double>")
        # the mean of a hub's parts; others are one part
        axes = [F.avg(F.get("y", F.lit(i))).alias(f"y{i}") for i in range(dims)]
        joined = moved.groupBy("id").agg(*axes).select("id", F.array(*[f"y{i}" for i in range(dims)]).alias("y"))
        after = written(joined)
        if begin:
            discard(state)
        state = after
        pool.destroy()
    return state


def _place(others: DataFrame, ids, points, fitted, k: int, a, b, epochs: int, seed: int) -> DataFrame:
    """Coordinates of further items against landmarks that stay where they are."""
    shared = others.sparkSession.sparkContext.broadcast((ids, points, fitted))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks, base, at = shared.value
        for batch in batches:
            if not len(batch):
                continue
            items = batch["item_id"].to_numpy(np.int64)
            r, c, d = nearest_rows(matrix(batch["vector"]), marks, base, k)
            distances = d.reshape(len(batch), -1)
            near = c.reshape(len(batch), -1)
            w = smooth_weights(distances)
            share = w / w.sum(1, keepdims=True)
            y = np.einsum("ik,ikd->id", share, at[near])
            heads = np.repeat(np.arange(len(batch)), near.shape[1])
            scaled = (w / w.max()).ravel()
            for epoch in range(epochs):
                on = _active(scaled, epoch)
                # Draws depend on the item, not on the batch it came in.
                y = _move_each(y, items, heads[on], at[near.ravel()[on]], at, 1.0 - epoch / epochs, a, b, (seed, epoch))
            yield pd.DataFrame({"item_id": items, "coordinates": list(y)})

    return others.mapInPandas(place, "item_id long, coordinates array<double>")


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit integer hash (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _move_each(y, items, rows, targets, repel_from, alpha, a, b, salt, pull: float = 1.0):
    class Draws:
        """Random rows as a function of item, epoch and draw number."""

        @staticmethod
        def integers(high: int, size: int) -> np.ndarray:
            who = items[np.repeat(rows, NEGATIVES)].astype(np.uint64)
            number = np.arange(size, dtype=np.uint64)
            first = np.searchsorted(rows, rows, side="left").repeat(NEGATIVES).astype(np.uint64) * np.uint64(NEGATIVES)
            with np.errstate(over="ignore"):
                seedling = np.uint64(salt[0] * 1_000_003 + salt[1])
                key = _mix(who + np.uint64(0x9E3779B97F4A7C15) * (seedling + np.uint64(1)))
                return (_mix(key + number - first) % np.uint64(high)).astype(np.int64)

    return _move(y, rows, targets, repel_from, alpha, a, b, Draws, pull, NEGATIVES)


def umap(vectors: DataFrame, target_dimensions: int = 2, n_neighbors: int = N_NEIGHBORS, min_dist: float = MIN_DIST,
         random_state: int = SEED, epochs: int | None = None, init: str = "pca", **bounds) -> DataFrame:
    """item_id, coordinates: a layout of all items together. ``n_neighbors`` is capped at the number of items less one.

    ``init`` is where items start: at their first principal components, or at the graph's ``spectral`` vectors after the first.
    """
    if init not in ("pca", "spectral"):
        raise ValueError(f"unknown start {init!r}")
    data = written(vectors.select("item_id", V.as_doubles(F.col("vector")).alias("vector")))
    n = data.count()
    if n < 2:
        return data.select("item_id", F.array_repeat(F.lit(0.0), target_dimensions).alias("coordinates"))
    # The item itself counts as one of its neighbours.
    k = max(1, min(n_neighbors, n - 1) - 1)
    spread = data.repartition(data.sparkSession.sparkContext.defaultParallelism, "item_id")
    graph = written(fuzzy_graph(knn(spread, data, k, exclude_self=True), k))
    a, b = curve(min_dist)
    if init == "pca":
        first = pca(data, target_dimensions)
    else:
        found, _ = spectral_vectors(graph, target_dimensions + 1, random_state)
        first = found.select(F.col("id").alias("item_id"), F.slice("x", 2, target_dimensions).alias("coordinates"))
    laid = _layout(written(_start(written(first), target_dimensions, random_state)), graph, n, a, b, 200 if epochs is None else epochs, random_state, **bounds)
    return laid.select(F.col("id").alias("item_id"), F.col("y").alias("coordinates"))


def umap_landmarks(vectors: DataFrame, target_dimensions: int = 2, n_neighbors: int = N_NEIGHBORS, min_dist: float = MIN_DIST,
                   random_state: int = SEED, epochs: int | None = None, max_landmarks: int = MAX_LANDMARKS) -> DataFrame:
    """item_id, coordinates: a layout of a seeded set of landmarks, and every other item placed against it.

    A coarser operator than ``umap``: its cost past the landmarks is one narrow pass.
    """
    data = written(vectors.select("item_id", V.as_doubles(F.col("vector")).alias("vector")))
    n = data.count()
    if n <= max_landmarks:
        return umap(data, target_dimensions, n_neighbors, min_dist, random_state, epochs)
    landmarks = written(seeded_pick(data, n, max_landmarks, seed=random_state))
    laid = written(umap(landmarks, target_dimensions, n_neighbors, min_dist, random_state, epochs))
    ids, points = collect_matrix(landmarks, "item_id", "vector")
    _, fitted = collect_matrix(laid, "item_id", "coordinates")
    a, b = curve(min_dist)
    rest = data.join(F.broadcast(laid.select("item_id")), "item_id", "left_anti")
    rounds = 200 if epochs is None else epochs
    return laid.unionByName(_place(rest, ids, points, fitted, min(n_neighbors, len(ids)), a, b, max(rounds // 3, 1), random_state))
