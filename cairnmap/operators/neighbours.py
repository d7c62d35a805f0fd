"""Exact k nearest neighbours under Euclidean distance.

Which way the work is laid out follows from sizes that are checked first:

* a base that fits a bounded broadcast goes to every task, queries stream past;
* queries that fit a bounded broadcast go to every task, each task keeps its
  own best k per query and the rest is one small merge;
* otherwise base and queries meet in cells around pivots (a Voronoi partition
  join, Lu et al. 2012). A query visits only the cells that can hold one of its
  k nearest rows by the triangle inequality; cells next to each other travel together.

Equal distances go to the lower id, and among equal vectors only the first
k + 1 ids can ever be answers, so copies beyond those are left out beforehand.
No result depends on the layout or on how the rows were partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from cairnmap.functions import vectors as V
from cairnmap.functions.partitions import widen
from cairnmap.functions.ranking import top_per_group
from cairnmap.operators import cells
from cairnmap.operators.linkage import spatial_order
from cairnmap.operators.sampling import seeded_pick
from cairnmap.session import written

# What one side may have to be sent to every task; the driver holds it several times over meanwhile.
BROADCAST_BYTES = 64 * 1024 * 1024
BLOCK_ROWS = 8192
# Rows of either side whose products are held at once.
QUERY_ROWS, BASE_ROWS = 256, 4096
MAX_PIVOTS = 4096

_RESULT = "query_id long, neighbor_id long, distance double"
_EMPTY = pd.DataFrame({"query_id": np.array([], "int64"), "neighbor_id": np.array([], "int64"), "distance": np.array([], "float64")})


def matrix(column: pd.Series) -> np.ndarray:
    """Array column as a float64 matrix."""
    if len(column) == 0:
        return np.empty((0, 0))
    return np.stack(column.to_numpy()).astype(np.float64)


def collect_matrix(df: DataFrame, id_col: str, vec_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and their vectors; callers check the size first."""
    got = df.select(F.col(id_col).alias("id"), V.as_doubles(F.col(vec_col)).alias("v")).toPandas()
    got = got.sort_values("id", kind="stable")
    return got["id"].to_numpy(np.int64), matrix(got["v"])


def nearest_rows(q: np.ndarray, b_ids: np.ndarray, b: np.ndarray, k: int, skip: np.ndarray | None = None):
    """(query row, base row, distance) of the k nearest base rows, ties by id; ``skip`` is a base id that each query leaves out.

    The matrix product only picks candidates: everything within its rounding error of the k-th distance is measured again by plain
    differences. Products are taken by bounded blocks, and of each only what may still be among the k nearest is kept.
    """
    if len(q) == 0 or len(b) == 0:
        return np.array([], int), np.array([], int), np.array([], float)
    b_sq = np.einsum("ij,ij->i", b, b)
    error = 1e-12 * b.shape[1]
    if skip is not None:
        order = np.argsort(b_ids, kind="stable")
        left, right = np.searchsorted(b_ids[order], skip, "left"), np.searchsorted(b_ids[order], skip, "right")
        own_row = np.repeat(np.arange(len(q)), right - left)
        own_col = order[np.arange(len(own_row)) - np.repeat(np.cumsum(right - left) - right, right - left)]
    rows, cols, dists = [], [], []
    for start in range(0, len(q), QUERY_ROWS):
        part = q[start:start + QUERY_ROWS]
        q_sq = np.einsum("ij,ij->i", part, part)
        slack = error * (q_sq + b_sq.max()) + 1e-300
        # squared distances less that of the query from the origin
        bound = np.full(len(part), np.inf)
        if skip is not None:
            at = slice(*np.searchsorted(own_row, [start, start + len(part)]))
            row, col = own_row[at] - start, own_col[at]
        r, c, near, fresh = np.array([], int), np.array([], int), np.array([], float), 0
        for first in range(0, len(b), BASE_ROWS):
            block = part @ (-2.0 * b[first:first + BASE_ROWS]).T
            block += b_sq[first:first + BASE_ROWS]
            if skip is not None:
                mine = (col >= first) & (col < first + block.shape[1])
                block[row[mine], col[mine] - first] = np.inf
            if not first and block.shape[1] > k:
                bound = np.partition(block, k - 1, axis=1)[:, k - 1] + slack
            x, y = np.nonzero(block <= bound[:, None])
            r, c, near = np.concatenate([r, x]), np.concatenate([c, y + first]), np.concatenate([near, block[x, y]])
            fresh += len(x)
            if fresh > k * len(part) or first + BASE_ROWS >= len(b):
                order = np.lexsort((near, r))
                r, c, near, fresh = r[order], c[order], near[order], 0
                ends = np.searchsorted(r, np.arange(len(part)), "left") + k - 1
                full = (ends < len(r)) & (r[np.minimum(ends, len(r) - 1)] == np.arange(len(part))) if len(r) else np.zeros(len(part), bool)
                bound[full] = np.minimum(bound[full], near[ends[full]] + slack[full])
                keep = (near <= bound[r]) & np.isfinite(near)
                r, c, near = r[keep], c[keep], near[keep]
        gap = part[r] - b[c]
        d = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        order = np.lexsort((b_ids[c], d, r))
        r, c, d = r[order], c[order], d[order]
        place = np.arange(len(r)) - np.searchsorted(r, r, side="left")
        keep = place < k
        rows.append(r[keep] + start)
        cols.append(c[keep])
        dists.append(d[keep])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dists)


def _answers(q_ids, q, b_ids, b, k, exclude_self) -> pd.DataFrame:
    r, c, d = nearest_rows(q, b_ids, b, k, q_ids if exclude_self else None)
    return pd.DataFrame({"query_id": q_ids[r], "neighbor_id": b_ids[c], "distance": d})


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return top_per_group(found, ["query_id"], [F.col("distance"), F.col("neighbor_id")], k)


def _first_copies(base: DataFrame, k: int) -> DataFrame:
    """At most k + 1 lowest ids per distinct vector."""
    return top_per_group(base, ["_vector"], [F.col("_id")], k + 1, "_copy").drop("_copy")


def knn(queries: DataFrame, base: DataFrame, k: int, exclude_self: bool = False, id_col: str = "item_id",
        vec_col: str = "vector", broadcast_bytes: int = BROADCAST_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest base rows of every query: query_id, neighbor_id, distance, rank.

    ``exclude_self`` leaves out the base row with the query's own id.
    """
    named = lambda df: df.select(F.col(id_col).cast("long").alias("_id"), V.as_doubles(F.col(vec_col)).alias("_vector"))
    q, b = named(queries), named(base)
    first = b.select(F.size("_vector")).first()
    if first is None:
        return queries.sparkSession.createDataFrame([], _RESULT + ", rank long")
    row_bytes = 8 * (first[0] + 1)
    if b.count() * row_bytes <= broadcast_bytes:
        return _ranked(_with_base_everywhere(q, b, k, exclude_self), k)
    if q.count() * row_bytes <= broadcast_bytes:
        return _ranked(_with_queries_everywhere(q, b, k, exclude_self), k)
    return _ranked(_in_cells(q, _first_copies(b, k), k, exclude_self, block_rows), k)


def _with_base_everywhere(q: DataFrame, b: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    ids, vectors = collect_matrix(_first_copies(b, k), "_id", "_vector")
    shared = q.sparkSession.sparkContext.broadcast((ids, vectors))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b_ids, b_vectors = shared.value
        for batch in batches:
            yield _answers(batch["_id"].to_numpy(np.int64), matrix(batch["_vector"]), b_ids, b_vectors, k, exclude_self)

    return widen(q).mapInPandas(search, _RESULT)


def _with_queries_everywhere(q: DataFrame, b: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    ids, vectors = collect_matrix(q, "_id", "_vector")
    shared = q.sparkSession.sparkContext.broadcast((ids, vectors))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q_vectors = shared.value
        best = _EMPTY
        for batch in batches:
            found = _answers(q_ids, q_vectors, batch["_id"].to_numpy(np.int64), matrix(batch["_vector"]), k, exclude_self)
            best = pd.concat([best, found]).sort_values(["query_id", "distance", "neighbor_id"]).groupby("query_id").head(k)
        yield best

    return widen(b).mapInPandas(search, _RESULT)


def _to_cells(df: DataFrame, pivots) -> DataFrame:
    """Nearest pivot of each row and the distance to it."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = pivots.value
        for batch in batches:
            r, c, d = nearest_rows(matrix(batch["_vector"]), np.arange(len(centres)), centres, 1)
            yield batch.assign(_cell=c.astype("int32"), _gap=d)

    return df.mapInPandas(assign, "_id long, _vector array<double>, _cell int, _gap double")


def _in_cells(q: DataFrame, b: DataFrame, k: int, exclude_self: bool, block_rows: int, region_rows: int | None = None) -> DataFrame:
    spark = q.sparkSession
    b = written(b)
    n_base = b.count()
    n_pivots = min(MAX_PIVOTS, max(2, math.ceil(n_base / block_rows)))
    _, centres = collect_matrix(seeded_pick(b, n_base, n_pivots, "_id"), "_id", "_vector")
    centres = np.unique(centres, axis=0)
    centres = centres[spatial_order(centres, 1)]
    pivots = spark.sparkContext.broadcast(centres)
    # Read several times below, and dear to compute.
    placed = written(_to_cells(b, pivots))

    # Bounded by the pivot count: radius, row count and the first k distances per cell.
    want = k + 1 if exclude_self else k
    shape = placed.groupBy("_cell").agg(F.count("*").alias("n"), F.max("_gap").alias("far")).toPandas()
    close = top_per_group(placed.select("_cell", "_gap", "_id"), ["_cell"], [F.col("_gap"), F.col("_id")], want).select(
        "_cell", "_gap"
    ).toPandas()
    n_cells = len(centres)
    count, far = np.zeros(n_cells, np.int64), np.full(n_cells, -np.inf)
    count[shape["_cell"]], far[shape["_cell"]] = shape["n"], shape["far"]
    between = np.vstack([np.sqrt(((centres - c) ** 2).sum(-1)) for c in centres])
    # From a row at distance g of pivot i, k rows lie within g + reach[i]; a few pivots at a time.
    at, gaps = close["_cell"].to_numpy(int), close["_gap"].to_numpy()
    reach = np.full(n_cells, np.inf)
    if len(at) >= want:
        step = max(1, 4_000_000 // len(at))
        for start in range(0, n_cells, step):
            known = between[start:start + step][:, at] + gaps[None, :]
            reach[start:start + step] = np.partition(known, want - 1, axis=1)[:, want - 1]
    rows = region_rows or cells.tile_rows(centres.shape[1], block_rows)
    regions = cells.packed(count, rows)
    plan = spark.sparkContext.broadcast((count, far, reach, regions))

    def distances(v: np.ndarray, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((v ** 2).sum(1)[:, None] + (points ** 2).sum(1)[None, :] - 2 * v @ points.T, 0.0))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, radius, within, groups = plan.value
        points = pivots.value
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.iloc[start:start + 512]
                d = distances(matrix(part["_vector"]), points)
                home = d.argmin(1)
                bound = d[np.arange(len(part)), home] + within[home]
                bound += 1e-6 * (1.0 + bound)
                asked = (n > 0)[None, :] & (d - radius[None, :] <= bound[:, None])
                yield pd.DataFrame({"_id": part["_id"], "_vector": part["_vector"], "_bound": bound, "_home": home.astype("int32"), "_regions": groups.hit(asked)})

    asking = q.mapInPandas(visit, "_id long, _vector array<double>, _bound double, _home int, _regions array<int>")
    stored = placed.select("_id", "_vector", "_cell", regions.of(F.col("_cell"), F.col("_id")).alias("_region"))

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return _EMPTY
        _, radius, *_ = plan.value
        # rows that ask from one cell together, stored ones by cell: few of them need all cells
        left, right = left.sort_values(["_home", "_id"]), right.sort_values(["_cell", "_id"])
        held, which = np.unique(right["_cell"].to_numpy(), return_inverse=True)
        b_ids, base, ids, v, bound = right["_id"].to_numpy(np.int64), matrix(right["_vector"]), left["_id"].to_numpy(np.int64), matrix(left["_vector"]), left["_bound"].to_numpy(float)
        points, out = pivots.value[held], [_EMPTY]
        for start in range(0, len(ids), QUERY_ROWS):
            some = slice(start, start + QUERY_ROWS)
            needed = (distances(v[some], points) - radius[held][None, :] <= bound[some, None]).any(0)[which]
            b_some, x = (b_ids, base) if needed.all() else (b_ids[needed], base[needed])
            r, c, d = nearest_rows(v[some], b_some, x, k, ids[some] if exclude_self else None)
            out.append(pd.DataFrame({"query_id": ids[some][r], "neighbor_id": b_some[c], "distance": d}))
        return pd.concat(out)

    return cells.meet(asking, stored, "_id", n_cells, rows, answer, _RESULT)


def approximate_knn(queries: DataFrame, base: DataFrame, k: int, bucket_length: float, tables: int = 4,
                    radius: float = math.inf, id_col: str = "item_id", vec_col: str = "vector", seed: int = 42, exclude_self: bool = False,
                    tile_rows: int | None = None) -> DataFrame:
    """Neighbours that share a random-projection bucket; misses some, and tells not how many. ``descent.nn_descent`` measures its recall.

    Pairs are not listed: the rows of a bucket meet in blocks of bounded size, which return k rows per query.
    """
    rows = lambda df: df.select(F.col(id_col).cast("long").alias("_id"), V.as_doubles(F.col(vec_col)).alias("_vector")).distinct()
    vec = lambda df: df.withColumn("features", array_to_vector("_vector"))
    model = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", bucketLength=bucket_length, numHashTables=tables, seed=seed
    ).fit(vec(rows(base)))

    def hashed(df: DataFrame) -> DataFrame:
        found = model.transform(vec(df)).select("_id", "_vector", F.posexplode("hashes").alias("_table", "_hash"))
        return written(found.select("_id", "_vector", "_table", vector_to_array("_hash")[0].alias("_bucket")))

    q, b = hashed(rows(queries)), hashed(_first_copies(rows(base), k))
    n, width = b.agg(F.count("*"), F.max(F.size("_vector"))).first()
    per_tile = tile_rows or cells.tile_rows(width or 1)
    bucket = ["_table", "_bucket"]
    cut = lambda df, name: df.groupBy(*bucket).agg(F.ceil(F.count("*") / per_tile).cast("int").alias(name))
    own, place = F.xxhash64(*bucket), F.pmod(F.xxhash64(*bucket), F.lit(-(-n // per_tile) or 1))
    # buckets that fit a task share one
    plan = written(cut(q, "_chunks").join(cut(b, "_blocks"), bucket).withColumn("_tile", F.when(F.col("_chunks") * F.col("_blocks") > 1, own).otherwise(place)))
    dealt = lambda name: F.pmod(F.xxhash64("_id"), F.col(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    asking = q.join(plan, bucket).withColumn("_chunk", dealt("_chunks")).withColumn("_block", every("_blocks")).drop("_chunks", "_blocks")
    stored = b.join(plan, bucket).withColumn("_block", dealt("_blocks")).withColumn("_chunk", every("_chunks")).drop("_chunks", "_blocks")
    # both sides have the plan's columns, so one gets new ones
    stored = stored.select(*[F.col(c).alias(c) for c in stored.columns])

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out, at = [_EMPTY], right.groupby(bucket).indices
        for key, mine in left.groupby(bucket).indices.items():
            if key in at:
                x, y = left.iloc[mine], right.iloc[at[key]]
                out.append(_answers(x["_id"].to_numpy(np.int64), matrix(x["_vector"]), y["_id"].to_numpy(np.int64), matrix(y["_vector"]), k, exclude_self))
        return pd.concat(out)

    tile = ["_tile", "_chunk", "_block"]
    found = asking.groupBy(*tile).cogroup(stored.groupBy(*tile)).applyInPandas(answer, _RESULT)
    return _ranked(found.filter(F.col("distance") < radius).distinct(), k)


def core_distances(points: DataFrame, min_samples: int, **options) -> DataFrame:
    """Distance of each item to its min_samples-th nearest other item.

    With fewer items than that, the farthest one stands in.
    """
    found = knn(points, points, max(min_samples, 1), exclude_self=True, **options)
    far = found.groupBy(F.col("query_id").alias("item_id")).agg(F.max("distance").alias("core"))
    return points.select("item_id").join(far, "item_id", "left").withColumn("core", F.coalesce("core", F.lit(0.0)))
