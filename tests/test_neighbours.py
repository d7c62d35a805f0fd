import tracemalloc

import numpy as np
import pytest

from cairnmap.operators import descent
from cairnmap.operators.neighbours import core_distances, knn

LAYOUTS = {
    "base everywhere": {},
    "cells": {"broadcast_bytes": 0, "block_rows": 40},
    "one cell": {"broadcast_bytes": 0, "block_rows": 100_000},
}


def brute(x, k, exclude_self):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    if exclude_self:
        np.fill_diagonal(d, np.inf)
    out = {}
    for i in range(len(x)):
        for r, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:k]):
            out[i, r + 1] = (int(j), round(float(d[i, j]), 9))
    return out


def rows(found):
    return {(r.query_id, r.rank): (r.neighbor_id, round(r.distance, 9)) for r in found.collect()}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    x[:150] = x[0]  # one position holds a third of the rows
    x[150:170] = x[200]
    return x


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("exclude_self", [True, False])
def test_exact_with_many_copies(points, data, layout, exclude_self):
    df = points(data, partitions=5)
    assert rows(knn(df, df, 4, exclude_self, **LAYOUTS[layout])) == brute(data, 4, exclude_self)


def test_few_queries(points, data):
    df = points(data)
    got = rows(knn(df.filter("item_id >= 390"), df, 7, broadcast_bytes=10 * 8 * 4))
    want = brute(data, 7, False)
    assert got == {key: want[key] for key in want if key[0] >= 390}


def test_fewer_rows_than_neighbours(points):
    df = points([[0.0], [1.0], [3.0]])
    got = rows(knn(df, df, 10, exclude_self=True))
    assert got[0, 1] == (1, 1.0) and got[0, 2] == (2, 3.0) and len(got) == 6


def test_core_distance(points, data):
    d = np.sqrt(((data[:, None] - data[None]) ** 2).sum(-1))
    want = np.sort(d, 1)[:, 5]
    got = {r.item_id: r.core for r in core_distances(points(data), 5).collect()}
    assert np.allclose([got[i] for i in range(len(data))], want)


def _exact(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return np.sort(d, 1)[:, :k]


def test_descent_reaches_its_recall(points):
    """Lists from small blocks become nearly exact; the recall it states is that of the brute force."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(900, 6)), rng.normal(size=(300, 6)) * 0.1 + 4])
    x[:30] = x[0]
    found = descent.nn_descent(points(x), 5, sample_rows=1200)
    rows = found.lists.toPandas().sort_values(["query_id", "rank"])
    assert (rows.groupby("query_id")["rank"].apply(list).map(tuple) == (1, 2, 3, 4, 5)).all() and (rows["query_id"] != rows["neighbor_id"]).all()
    gap = x[rows["query_id"]] - x[rows["neighbor_id"]]
    assert np.allclose(np.sqrt((gap * gap).sum(1)), rows["distance"])
    far = _exact(x, 5)[:, -1]
    hits = (rows["distance"].to_numpy() <= far[rows["query_id"]] + 1e-12).mean()
    assert found.recall >= 0.95 and abs(found.recall - hits) < 1e-9
    again = descent.nn_descent(points(x, partitions=8), 5, sample_rows=1200)
    assert again.recall == found.recall and again.rounds == found.rounds
    assert again.lists.toPandas().sort_values(["query_id", "rank"])["neighbor_id"].tolist() == rows["neighbor_id"].tolist()


def test_descent_of_few_rows(spark, points):
    assert descent.nn_descent(points([[1.0, 2.0]]), 3).lists.count() == 0
    few = descent.nn_descent(points([[0.0], [1.0], [5.0]]), 5)
    assert few.recall == 1.0 and {(r.query_id, r.neighbor_id, r["rank"]) for r in few.lists.collect()} == {(0, 1, 1), (0, 2, 2), (1, 0, 1), (1, 2, 2), (2, 1, 1), (2, 0, 2)}


def test_descent_sends_a_member_once_to_each_task(spark, points, monkeypatch):
    """Rows next to each other share members, so far fewer vectors are sent than there are entries of lists; small tasks and few held pairs change nothing."""
    rng = np.random.default_rng(11)
    x = (rng.normal(size=(12, 1, 8)) * 20 + rng.normal(size=(12, 50, 8))).reshape(-1, 8)
    sent = spark.sparkContext.accumulator(0)
    entries = spark.sparkContext.accumulator(0)
    whole = descent._introduced

    def counted(k):
        run = whole(k)

        def watch(table):
            sent.add(table.num_rows)
            entries.add(len(table.column("rows").combine_chunks().flatten()))
            return run(table)

        return watch

    lists = lambda f: f.lists.orderBy("query_id", "rank").toPandas()
    monkeypatch.setattr(descent, "_introduced", counted)
    monkeypatch.setattr(descent, "CELL_ROWS", 50)
    found = descent.nn_descent(points(x), 5, sample_rows=600)
    want = lists(found)
    assert found.recall >= 0.95 and 0 < sent.value * 4 < entries.value
    monkeypatch.setattr(descent, "_introduced", whole)
    monkeypatch.setattr(descent, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(descent, "HELD_PAIRS", 100)
    assert lists(descent.nn_descent(points(x), 5, sample_rows=600)).equals(want)


def test_descent_of_repeated_rows(points):
    """A repeated row is no neighbour of its copy, and nobody lists it twice."""
    x = np.random.default_rng(12).normal(size=(60, 4))
    found = descent.nn_descent(points(np.concatenate([x, x[:20]]), ids=[*range(60), *range(20)]), 5, sample_rows=60)
    rows = found.lists.toPandas()
    assert (rows["query_id"] != rows["neighbor_id"]).all() and not rows.duplicated(["query_id", "neighbor_id"]).any()
    assert (rows.groupby("query_id").size() == 5).all() and rows["query_id"].nunique() == 60
    gap = x[rows["query_id"]] - x[rows["neighbor_id"]]
    assert np.allclose(np.sqrt((gap * gap).sum(1)), rows["distance"])


@pytest.mark.parametrize("region_rows", [60, 150])
def test_cells_that_travel_in_regions(spark, points, data, region_rows):
    """A query goes to a region once, whatever number of its cells it visits."""
    from cairnmap.operators import cells, neighbours
    from pyspark.sql import functions as F

    asked = []
    whole = cells.meet

    def watched(asking, *rest):
        asked.append(asking)
        return whole(asking, *rest)

    q = points(data).select(F.col("item_id").alias("_id"), F.col("vector").alias("_vector"))
    cells.meet = watched
    try:
        found = neighbours._ranked(neighbours._in_cells(q, neighbours._first_copies(q, 4), 4, True, 20, region_rows), 4)
    finally:
        cells.meet = whole
    assert rows(found) == brute(data, 4, True)
    assert asked[0].count() == len(data)
    assert all(len(r._regions) == len(set(r._regions)) <= 400 // region_rows + 20 for r in asked[0].collect())


def test_groups_of_cells():
    from cairnmap.operators.cells import packed

    groups = packed(np.array([3, 0, 4, 25, 2, 9, 1, 0]), 10)
    assert groups.first.tolist() == [0, 0, 0, 1, 4, 5, 5, 5] and groups.parts.tolist() == [1, 1, 1, 3, 1, 1, 1, 1] and groups.n == 6
    marks = np.zeros((2, 8), bool)
    marks[0, [0, 3]] = marks[1, 7] = True
    assert [x.tolist() for x in groups.hit(marks)] == [[0, 1, 2, 3], [5]]


@pytest.mark.parametrize("tile_rows", [None, 30])
def test_buckets_meet_in_blocks(spark, points, data, tile_rows):
    """The same neighbours as a join of all pairs of a bucket, with copies and repeated rows, and no list of pairs."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from cairnmap.operators.neighbours import approximate_knn

    df = points(data)
    found = approximate_knn(df.union(df.limit(20)), df.union(df.limit(20)), 4, 0.7, exclude_self=True, tile_rows=tile_rows)
    vec = df.withColumn("features", array_to_vector("vector"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=0.7, numHashTables=4, seed=42).fit(vec)
    pairs = model.approxSimilarityJoin(vec, vec, float("inf"), "d").selectExpr("datasetA.item_id a", "datasetB.item_id b").filter("a <> b").toPandas()
    want = {}
    for i in range(len(data)):
        others = np.sort(pairs["b"][pairs["a"] == i].to_numpy())
        d = np.sqrt(((data[others] - data[i]) ** 2).sum(-1))
        for r, j in enumerate(np.lexsort((others, d))[:4]):
            want[i, r + 1] = (int(others[j]), round(float(d[j]), 9))
    assert rows(found) == want


@pytest.mark.parametrize("copies", [1, 15])
def test_products_are_held_in_bounded_blocks(copies):
    """What a task needs besides both sides doesn't grow with the base, neither with ties; all distances at once would be 960 MB."""
    from cairnmap.operators.neighbours import nearest_rows

    rng = np.random.default_rng(5)
    b = np.repeat(rng.normal(size=(60_000 // copies, 4)), copies, axis=0)
    q, ids = b[:: len(b) // 2000][:2000].copy(), np.arange(len(b))
    tracemalloc.start()
    try:
        r, c, d = nearest_rows(q, ids, b, 14, ids[:: len(b) // 2000][:2000])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(r) == 14 * len(q) and (d[r == 7][:14] == 0).all() == (copies > 1)
    assert peak < 48 << 20
