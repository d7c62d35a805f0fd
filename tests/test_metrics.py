import numpy as np
import pytest

from cairnmap.operators import metrics


def brute(x, label):
    keep = label >= 0
    x, label = x[keep], label[keep]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    scores = []
    for i, c in enumerate(label):
        own = (label == c).sum()
        if own == 1:
            scores.append(0.0)
            continue
        a = d[i, label == c].sum() / (own - 1)
        b = min(d[i, label == o].mean() for o in set(label) - {c})
        scores.append(0.0 if max(a, b) == 0 else (b - a) / max(a, b))
    return round(float(np.mean(scores)), 3)


def assigned(spark, label, run=1):
    rows = [(run, i, int(c)) for i, c in enumerate(label)]
    return spark.createDataFrame(rows, "cluster_run_id long, item_id long, cluster_id long")


@pytest.mark.parametrize("block_rows,centre_bytes", [(4096, 1 << 20), (30, 1 << 20), (30, 0)])
def test_silhouette_is_exact(spark, points, block_rows, centre_bytes):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(150, 4))
    x[40:90] = x[0]  # copies share one position
    label = rng.integers(-1, 4, 150)
    label[5] = 9  # a singleton
    got = metrics.silhouette(assigned(spark, label), points(x, "coordinates"), block_rows, centre_bytes).first()
    assert got.silhouette == pytest.approx(brute(x, label), abs=0.0011)


def test_far_clusters_are_not_visited(spark, points):
    """Of many clusters in a row only the next ones can be nearest; the score is that of all pairs."""
    rng = np.random.default_rng(4)
    label = np.repeat(np.arange(12), 20)
    x = rng.normal(size=(240, 3)) * 0.3 + np.stack([label * 4.0, label * 0, label % 2], 1)
    rows = metrics._weighted_points(assigned(spark, label), points(x, "coordinates"))
    visited = metrics._pruned_sums(rows, metrics._centres(rows), 16).select("point", "other").distinct().count()
    assert visited < 240 * 4
    got = metrics.silhouette(assigned(spark, label), points(x, "coordinates"), 16).first()
    assert got.silhouette == pytest.approx(brute(x, label), abs=0.0011)


def test_silhouette_of_several_runs(spark, points):
    x = np.random.default_rng(1).normal(size=(60, 2))
    one, two = np.arange(60) % 3, np.zeros(60, int)
    both = assigned(spark, one, 1).unionByName(assigned(spark, two, 2))
    got = {r.cluster_run_id: r.silhouette for r in metrics.silhouette(both, points(x, "coordinates")).collect()}
    assert got == {1: pytest.approx(brute(x, one), abs=0.0011), 2: None}


def test_all_singletons_have_no_score(spark, points):
    x = np.arange(6.0).reshape(3, 2)
    assert metrics.silhouette(assigned(spark, np.arange(3)), points(x, "coordinates")).first().silhouette is None


def test_squared_silhouette(spark, points):
    x = np.random.default_rng(2).normal(size=(80, 3))
    label = (x[:, 0] > 0).astype(int)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    s = []
    for i, c in enumerate(label):
        a, b = d[i, label == c].sum() / ((label == c).sum() - 1), d[i, label != c].mean()
        s.append((b - a) / max(a, b))
    assert metrics.squared_silhouette(assigned(spark, label), points(x, "coordinates")) == pytest.approx(np.mean(s))


def test_run_metrics(spark):
    got = metrics.run_metrics(
        assigned(spark, [0, 0, 0, 1, 2, 2, 3, 3, -1, -1], 1).unionByName(assigned(spark, [-1, -1], 2))
    ).collect()
    one, two = sorted(got)
    assert tuple(one)[1:] == (4, 0.2, 10, 1, 3, 2.0)
    assert tuple(two)[1:] == (0, 1.0, 2, 0, 0, 0.0)
