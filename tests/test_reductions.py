import numpy as np
from pyspark.sql import functions as F
import pytest

from cairnmap.operators import pca, som, spectral, umap
from cairnmap.session import written


def stacked(df, column="coordinates"):
    rows = sorted(df.collect(), key=lambda r: r.item_id)
    return np.array([r[column] for r in rows])


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 10)) * 5
    label = rng.integers(0, 4, 300)
    return centres[label] + rng.normal(size=(300, 10)), label


def test_pca_matches_svd(points, blobs):
    x, _ = blobs
    got = stacked(pca.pca(points(x), 4))
    centred = x - x.mean(0)
    u, s, vt = np.linalg.svd(centred, full_matrices=False)
    sign = np.where(vt[np.arange(4), np.abs(vt[:4]).argmax(1)] < 0, -1, 1)
    assert np.allclose(got, u[:, :4] * s[:4] * sign, atol=1e-8)
    assert np.allclose(got.mean(0), 0, atol=1e-9)


@pytest.mark.parametrize("n,d,k,width", [(5, 3, 50, 3), (2, 8, 50, 2), (1, 4, 2, 1)])
def test_pca_width_is_capped(points, n, d, k, width):
    x = np.random.default_rng(0).normal(size=(n, d))
    assert stacked(pca.pca(points(x), k)).shape == (n, width)


def test_wide_components_equal_the_exact_ones(points):
    """The block iteration at a small width: explained variance, axes up to a tolerance, and a block as wide as the vectors."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 64)) * np.linspace(4, 0.2, 64) + rng.normal(size=64)
    exact, wide = pca.fit_pca(points(x), 6), pca.fit_pca(points(x, partitions=7), 6, max_width=16)
    assert np.allclose(exact.explained, wide.explained, atol=1e-6) and np.allclose(exact.axes, wide.axes, atol=1e-2)
    assert np.allclose(wide.axes.T @ wide.axes, np.eye(6), atol=1e-9)
    whole = pca.fit_pca(points(x), 64, max_width=16)
    assert np.isclose(whole.explained.sum(), 1, atol=1e-9)
    assert pca.fit_pca(points(np.ones((5, 20))), 3, max_width=16).explained.tolist() == [0, 0, 0]


def test_components_past_the_widest_square(points):
    x = np.random.default_rng(4).normal(size=(60, 1)) @ np.random.default_rng(5).normal(size=(1, 9000))
    found = pca.fit_pca(points(x), 2)
    assert found.axes.shape == (9000, 2) and found.explained[0] > 0.999999


def test_curve():
    assert np.allclose(umap.curve(0.1), (1.577, 0.895), atol=0.01)
    assert np.allclose(umap.curve(0.5), (0.583, 1.334), atol=0.01)


def test_weights_sum_to_log2():
    d = np.sort(np.random.default_rng(0).uniform(0.1, 2, size=(20, 14)), 1)
    w = umap.smooth_weights(d)
    assert np.allclose(w.sum(1), np.log2(15), atol=1e-3) and np.allclose(w[:, 0], 1)


def test_fuzzy_union(spark):
    lists = spark.createDataFrame(
        [(0, 1, 1.0, 1), (0, 2, 2.0, 2), (1, 0, 1.0, 1), (1, 2, 1.5, 2), (2, 1, 1.5, 1), (2, 0, 2.0, 2)],
        "query_id long, neighbor_id long, distance double, rank long",
    )
    w = umap.smooth_weights(np.array([[1.0, 2.0], [1.0, 1.5], [1.5, 2.0]]))
    got = {(r.item_id, r.other_id): r.weight for r in umap.fuzzy_graph(lists, 2).collect()}
    join = lambda a, b: a + b - a * b
    want = {(0, 1): join(w[0, 0], w[1, 0]), (0, 2): join(w[0, 1], w[2, 1]), (1, 2): join(w[1, 1], w[2, 0])}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def agreement(y, label, k=10):
    d = ((y[:, None] - y[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    return (label[np.argsort(d, 1)[:, :k]] == label[:, None]).mean()


@pytest.mark.parametrize("landmarks", [10_000, 120])
def test_layout_keeps_neighbourhoods_and_repeats(points, blobs, landmarks):
    x, label = blobs
    lay = (lambda df: umap.umap(df, 2, epochs=60)) if landmarks > len(x) else (lambda df: umap.umap_landmarks(df, 2, epochs=60, max_landmarks=landmarks))
    first, again = stacked(lay(points(x))), stacked(lay(points(x, partitions=11)))
    assert first.shape == (300, 2) and np.isfinite(first).all()
    assert agreement(first, label) > 0.95
    assert np.array_equal(first, again)


def test_spectral_vectors_equal_the_exact_ones(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3)) + np.repeat([[0, 0, 0], [2, 0, 0], [0, 3, 0]], [80, 70, 50], axis=0)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    w = np.zeros((200, 200))
    for i in range(200):
        for j in np.argsort(d[i])[1:9]:
            w[i, j] = w[j, i] = np.exp(-d[i, j])
    edges = [(i, j, float(w[i, j])) for i in range(200) for j in range(i) if w[i, j] > 0]
    found, values = spectral.spectral_vectors(spark.createDataFrame(edges, "item_id long, other_id long, weight double").repartition(4), 3)
    exact, axes = np.linalg.eigh(w / np.sqrt(np.outer(w.sum(1), w.sum(1))))
    got = np.array([r.x for r in sorted(found.collect())])
    assert np.allclose(values, exact[::-1][:3], atol=1e-6)
    for i in range(3):
        assert abs(got[:, i] @ axes[:, -1 - i]) > 0.9999 and got[np.abs(got[:, i]).argmax(), i] > 0


def test_spectral_vectors_of_a_pair(spark):
    found, values = spectral.spectral_vectors(spark.createDataFrame([(1, 2, 0.5)], "item_id long, other_id long, weight double"), 3)
    assert np.allclose(values, [1, -1]) and np.allclose(np.abs([r.x for r in found.collect()]), 0.5 ** 0.5)


def test_layout_from_spectral_vectors(points, blobs):
    x, label = blobs
    y = stacked(umap.umap(points(x), 2, epochs=40, init="spectral"))
    assert np.isfinite(y).all() and agreement(y, label) > 0.95
    with pytest.raises(ValueError):
        umap.umap(points(x), 2, init="random")


def test_layout_does_not_depend_on_groups(points, blobs):
    """Many small groups of edges move the items as one group does; parts of hubs and a small pool still keep neighbourhoods."""
    x, label = blobs
    whole = stacked(umap.umap(points(x), 2, epochs=30))
    assert np.allclose(whole, stacked(umap.umap(points(x), 2, epochs=30, group_edges=300)))
    cut = stacked(umap.umap(points(x), 2, epochs=60, group_edges=500, hub_edges=20, pool_rows=100))
    assert np.isfinite(cut).all() and agreement(cut, label) > 0.95


@pytest.mark.parametrize("n", [1, 2, 5])
def test_small_layouts(points, n):
    y = stacked(umap.umap(points(np.random.default_rng(0).normal(size=(n, 4))), 3, n_neighbors=100, epochs=10))
    assert y.shape == (n, 3) and np.isfinite(y).all()


def test_auto_grid(spark):
    sides = [r.s for r in spark.createDataFrame([(1,), (1000,)], "n long").select(som.auto_grid_side(F.col("n")).alias("s")).collect()]
    assert sides[0] == 2 and 9 <= sides[1] <= 14


def test_map_is_ordered_and_repeats(points, blobs):
    x, label = blobs
    book = som.train_som(points(x), 4, 5).collect()
    assert [(r.node_index, r.grid_i, r.grid_j) for r in sorted(book)] == [(i, i // 5, i % 5) for i in range(20)]
    again = som.train_som(points(x, partitions=7), 4, 5).collect()
    assert np.allclose([r.weight for r in sorted(book)], [r.weight for r in sorted(again)], atol=1e-6)
    weights = np.array([r.weight for r in sorted(book)])
    error = np.sqrt(((x[:, None] - weights[None]) ** 2).sum(-1)).min(1).mean()
    assert error < 0.5 * np.sqrt(((x - x.mean(0)) ** 2).sum(1)).mean()


def test_cells_and_u_matrix(spark, points, blobs):
    x, _ = blobs
    book = som.train_som(points(x), 3, 6)
    placed = stacked(som.cell_coordinates(som.best_nodes(points(x), book)))
    assert placed.min() >= 0 and placed[:, 0].max() <= 2 and placed[:, 1].max() <= 5
    distances = [r.umatrix_dist for r in som.u_matrix(book).collect()]
    assert len(distances) == 18 and max(distances) == 1 and min(distances) >= 0


def test_positions_do_not_pass_the_driver(points, blobs, monkeypatch):
    x, _ = blobs
    plans = []
    monkeypatch.setattr(umap, "written", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), written(df))[1])
    umap.umap(points(x), 2, epochs=20).count()
    rounds = [p for p in plans if "GroupsInPandas" in p]
    assert rounds and not any("Broadcast" in p for p in rounds)
