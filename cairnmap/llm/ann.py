"""Nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

Vectors are lifted by one coordinate so that the largest inner product is the smallest distance. The tree
is fitted on a bounded sample; every row is sent to its leaf. A query walks the tree with a priority
queue of unexplored branches and visits its best leaves; how many it visits is widened until queries set aside
reach the wanted recall against brute force over all rows. The walk of those queries gives the order of all
leaves once, so widening only looks up at which visit each true answer turns up. Leaves that follow each other
in the tree are searched together, up to a bounded number of rows; a leaf with more is cut into blocks. A query
is sent once to each group of leaves it visits, with a bitmap of its leaves, and of equal vectors only the first
k + 1 ids can be answers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cairnmap.functions.frames import from_pandas
from cairnmap.functions.ranking import top_per_group
from cairnmap.session import written

# Rows that the tree is fitted on, branches of a node, and sample rows in a leaf at most.
SAMPLE_ROWS, BRANCHES, LEAF_SAMPLE = 20_000, 8, 48
# Queries that the number of visits is calibrated on, and the share of true neighbours they have to find.
CALIBRATION_QUERIES, RECALL = 200, 0.95
# Rows and queries that one task compares, and queries whose scores it holds at a time.
BLOCK_ROWS, BLOCK_QUERIES, HELD_QUERIES = 8_192, 16_384, 256


@dataclass
class Node:
    centers: np.ndarray
    children: list = field(default_factory=list)  # a Node or a leaf number


@dataclass
class Tree:
    """The root, the number of leaves and the lift: the largest squared norm the sample knows."""

    root: Node | int
    leaves: int
    top: float

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.top - (x * x).sum(axis=1), 0.0)
        return np.hstack([x, np.sqrt(rest)[:, None]])

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row, level by level."""
        lifted, out = self.lift(x), np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not isinstance(node, Node):
                out[rows] = node
            elif len(rows):
                near = _nearest(lifted[rows], node.centers)
                todo += [(child, rows[near == i]) for i, child in enumerate(node.children)]
        return out

    def best_leaves(self, query: np.ndarray, visits: int, counts: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The leaves a best-bin-first walk reaches, in order; a leaf's place in the queue is its centre's distance.

        The walk goes on past ``visits`` until the leaves hold ``least`` rows by their ``counts``.
        """
        q = np.append(query, 0.0)
        queue: list[tuple[float, int, Node | int]] = [(0.0, 0, self.root)]
        found, order, rows = [], 0, 0
        while queue and (len(found) < visits or rows < least):
            _, _, node = heapq.heappop(queue)
            if not isinstance(node, Node):
                found.append(node)
                rows += 0 if counts is None else int(counts[node])
                continue
            far = ((node.centers - q) ** 2).sum(axis=1)
            for d, child in zip(far, node.children):
                order += 1
                heapq.heappush(queue, (float(d), order, child))
        return found


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers * centers).sum(axis=1) - 2 * x @ centers.T).argmin(axis=1)


def build_tree(sample: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_SAMPLE, rounds: int = 10) -> Tree:
    """Split by k-means (seeded at evenly spaced rows of the sample's order) until a part is small or all one vector."""
    top = float((sample * sample).sum(axis=1).max()) if len(sample) else 0.0
    tree = Tree(0, 0, top)
    lifted = tree.lift(sample) if len(sample) else sample

    def split(rows: np.ndarray) -> Node | int:
        if len(rows) > leaf_rows:
            x = lifted[rows]
            centers = x[np.unique(np.linspace(0, len(rows) - 1, branches).astype(int))]
            for _ in range(rounds):
                near = _nearest(x, centers)
                centers = np.stack([x[near == i].mean(axis=0) if (near == i).any() else c for i, c in enumerate(centers)])
            near = _nearest(x, centers)
            parts = [i for i in range(len(centers)) if (near == i).any()]
            if len(parts) > 1:
                return Node(centers[parts], [split(rows[near == i]) for i in parts])
        tree.leaves += 1
        return tree.leaves - 1

    tree.root = split(np.arange(len(sample)))
    return tree


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _best(scores: np.ndarray, queries: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k best rows of each query (largest score, then smallest id), never the query itself."""
    scores = np.where(queries[:, None] == ids[None, :], -np.inf, scores)
    if scores.shape[1] > k:
        # everything at least as good as the k-th, so that ties are settled by id
        floor = np.partition(scores, -k, axis=1)[:, -k][:, None]
    else:
        floor = np.full((len(queries), 1), -np.inf)
    r, c = np.nonzero((scores >= floor) & np.isfinite(scores))
    out = pd.DataFrame({"query_id": queries[r], "vec_id": ids[c], "score": scores[r, c]})
    out = out.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return out.groupby("query_id", sort=False).head(k)


_FOUND = "query_id long, vec_id long, score double"


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products in double precision, the same however rows are batched."""
    return np.stack([np.einsum("ij,j->i", b, x) for x in a]) if len(a) else np.zeros((0, len(b)))


def _stack(x: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in x])


def merge_best(found: DataFrame, k: int) -> DataFrame:
    """Best k of each query over all tasks; a task sends at most k rows of a query."""
    ranked = top_per_group(found, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def brute_force(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """Exact answers for a bounded set of queries (id, v), which goes to every task, against all rows in blocks."""
    asked = queries.orderBy("id").toPandas()
    shared = base.sparkSession.sparkContext.broadcast((asked["id"].to_numpy(np.int64), _stack(asked["v"]) if len(asked) else None))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        for batch in batches:
            if len(batch) and len(ids):
                yield _best(_products(q, _stack(batch["v"])), ids, batch["id"].to_numpy(np.int64), k)

    return merge_best(base.select("id", "v").mapInPandas(run, _FOUND), k)


def leaf_groups(counts: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Group of each leaf and blocks of each group: leaves in tree order together up to ``block_rows``, larger ones alone."""
    group, blocks, held = np.zeros(len(counts), np.int64), [], None
    for leaf, n in enumerate(counts.tolist()):
        if n > block_rows or held is None or held + n > block_rows:
            blocks.append(max(1, -(-n // block_rows)))
            held = None if n > block_rows else n
        else:
            held += n
        group[leaf] = len(blocks) - 1
    return group, np.array(blocks, np.int64)


def block_scores(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    """The best k of each query (id, v, bitmap of leaves) among the rows (to_id, to_v, to_leaf) of leaves it visits."""
    rows = rows.sort_values(["to_leaf", "to_id"])
    base, ids, leaf = _stack(rows["to_v"]), rows["to_id"].to_numpy(np.int64), rows["to_leaf"].to_numpy(np.int64)
    cuts = np.append(np.flatnonzero(np.diff(leaf, prepend=-1)), len(leaf))
    for at in range(0, len(queries), HELD_QUERIES):
        some = queries.iloc[at:at + HELD_QUERIES]
        asked = _stack(some["v"])
        bits = np.stack([np.frombuffer(b, np.uint8) for b in some["bitmap"]])
        scores = np.full((len(some), len(ids)), -np.inf)
        for a, b in zip(cuts[:-1], cuts[1:]):
            here = np.flatnonzero(bits[:, leaf[a] >> 3] >> (7 - (leaf[a] & 7)) & 1)
            if len(here):
                scores[here, a:b] = _products(asked[here], base[a:b])
        yield _best(scores, some["id"].to_numpy(np.int64), ids, k)


def visit(queries: DataFrame, at: DataFrame, tree: Tree, counts: np.ndarray, visits: int, k: int,
          block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The best k of each query (id, v) among the rows of the ``visits`` leaves it reaches; ``at`` has id, v, leaf.

    ``counts`` are the rows of each leaf. What the driver holds has one entry per leaf, so the sample bounds it.
    """
    spark = at.sparkSession
    group, blocks = leaf_groups(counts, block_rows)
    shared = spark.sparkContext.broadcast((tree, group, counts))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, group, counts = shared.value
        for batch in batches:
            groups, bitmaps = [], []
            for v in batch["v"]:
                leaves = np.array(tree.best_leaves(np.asarray(v, np.float64), visits, counts, k + 1), np.int64)
                bits = np.zeros(tree.leaves, bool)
                bits[leaves] = True
                groups.append(np.unique(group[leaves]))
                bitmaps.append(np.packbits(bits).tobytes())
            yield pd.DataFrame({"id": batch["id"], "v": batch["v"], "groups": groups, "bitmap": bitmaps})

    vector = at.schema["v"].dataType.simpleString()
    walked = written(queries.select("id", "v").mapInPandas(walk, f"id long, v {vector}, groups array<long>, bitmap binary"))
    asking = {r["g"]: r["count"] for r in walked.select(F.explode("groups").alias("g")).groupBy("g").count().collect()}
    plan = [(g, int(n), -(-asking[g] // block_queries)) for g, n in enumerate(blocks) if g in asking]
    small = lambda rows, *names: F.broadcast(from_pandas(
        spark, pd.DataFrame(rows, columns=names, dtype="int64"), ", ".join(f"{n} long" for n in names)))
    plan, of_leaf = small(plan, "g", "blocks", "parts"), small(list(enumerate(group.tolist())), "leaf", "g")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    share = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    asked = walked.select("id", "v", "bitmap", F.explode("groups").alias("g")).join(plan, "g").select(
        "id", "v", "bitmap", "g", share("parts").alias("part"), copies("blocks").alias("block"))
    placed = at.join(of_leaf, "leaf").join(plan, "g").select(
        F.col("id").alias("to_id"), F.col("v").alias("to_v"), F.col("leaf").alias("to_leaf"), F.col("g").alias("to_g"),
        share("blocks").alias("to_block"), copies("parts").alias("to_part"))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        return pd.concat(block_scores(left, right, k))

    pairs = asked.groupBy("g", "block", "part").cogroup(placed.groupBy("to_g", "to_block", "to_part"))
    return merge_best(pairs.applyInPandas(score, _FOUND), k)


def needed_visits(trial: pd.DataFrame, truth: pd.DataFrame, tree: Tree, wanted: float) -> int:
    """The fewest visits at which the trial queries (id, v) have found ``wanted`` of their true answers (query_id, v).

    Both are of a bounded size. A visit more adds each query's next leaf, so the walks are looked up, not repeated.
    """
    if not len(truth):
        return min(1, tree.leaves)
    place = {i: np.argsort(tree.best_leaves(np.asarray(v, np.float64), tree.leaves)) for i, v in zip(trial["id"], trial["v"])}
    leaf = tree.leaf_of(_stack(truth["v"]))
    found_at = np.sort([place[q][at] for q, at in zip(truth["query_id"], leaf)])
    return int(found_at[int(np.ceil(wanted * len(found_at))) - 1]) + 1


def search(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
           wanted: float = RECALL, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest rows by inner product, ties to the smaller id.

    Rows whose vector is null, zero, or holds a null, NaN or infinite component take no part, nor do rows
    whose length is not the most common one (ties: the longer) or whose id is null; of rows that repeat an
    id one with the smallest vector counts. A query with fewer than k candidates gets all of those found. Visits
    are widened until the calibration queries (the first by a hash of the id) reach ``wanted``, at most all leaves,
    which is exact. An empty table gives an empty table; other columns are ignored.
    """
    kind = vectors.schema[vector].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"), is_query.alias("q"))
    rows = rows.filter(usable(F.col("v")) & F.col("id").isNotNull())
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    rows = rows.filter(F.size("v") == (width["w"] if width else 0))
    rows = written(rows.groupBy("id").agg(F.min(F.struct("v", "q")).alias("r")).select("id", "r.v", "r.q"))
    first = lambda df, n: df.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(n)
    sample = first(rows, sample_rows).select("v").toPandas()
    tree = build_tree(_stack(sample["v"]) if len(sample) else np.zeros((0, 1)))
    shared = rows.sparkSession.sparkContext.broadcast(tree)
    base = top_per_group(rows.withColumn("h", F.xxhash64("v")), ["h", "v"], [F.col("id")], k + 1, "copy").select("id", "v")

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"id": batch["id"], "v": batch["v"], "leaf": shared.value.leaf_of(_stack(batch["v"]))})

    at = written(base.mapInPandas(leaves, f"id long, v {kind}, leaf long"))
    counts = np.zeros(tree.leaves, np.int64)
    for r in at.groupBy("leaf").count().collect():
        counts[r["leaf"]] = r["count"]
    queries = rows.filter("q").select("id", "v")
    trial = written(first(queries, CALIBRATION_QUERIES).select("id", "v"))
    truth = brute_force(trial, at, k).select("query_id", "vec_id")
    truth = truth.hint("broadcast").join(at, F.col("vec_id") == F.col("id")).select("query_id", "v")  # k rows per trial query
    visits = needed_visits(trial.toPandas(), truth.toPandas(), tree, wanted)
    return visit(queries, at, tree, counts, visits, k)
