import numpy as np

from cairnmap.operators import exemplars


def assigned(spark, labels):
    return spark.createDataFrame([(1, i, c) for i, c in labels.items()], "cluster_run_id long, item_id long, cluster_id long")


def test_core_and_edges(spark, points):
    vectors = [[1.0, 0.0], [0.99, 0.01], [0.98, 0.02], [1.0, 0.03], [0.97, 0.0], [-1.0, 1.0], [-0.8, 1.2]]
    picked = exemplars.select_exemplars(assigned(spark, {i: 0 for i in range(1, 8)}), points(vectors, ids=range(1, 8))).collect()
    centre = {r.item_id for r in picked if r.kind == "center"}
    outskirt = {r.item_id for r in picked if r.kind == "outskirt"}
    assert outskirt == {6, 7} and centre <= {1, 2, 3, 4, 5} and len(centre) == 3


def test_mean_similarity_is_the_mean_over_all_members(spark, points):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    labels = {i: i % 3 - 1 for i in range(60)}
    got = {r.item_id: r for r in exemplars.similarities(exemplars.members(assigned(spark, labels), points(x))).collect()}
    assert set(got) == {i for i, c in labels.items() if c >= 0}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for c in (0, 1):
        rows = [i for i in labels if labels[i] == c]
        pairs = unit[rows] @ unit[rows].T
        assert np.allclose([got[i].mean_similarity for i in rows], pairs.mean(1), atol=1e-8)


def test_small_clusters_and_ranks(spark, points):
    picked = exemplars.select_exemplars(assigned(spark, {0: 0, 1: 1, 2: 1, 3: -1}), points([[1, 0], [0, 1], [1, 1], [5, 5]])).collect()
    by_cluster = {}
    for r in picked:
        by_cluster.setdefault((r.cluster_id, r.kind), []).append(r.rank)
    assert {k: sorted(v) for k, v in by_cluster.items()} == {(0, "center"): [1], (1, "center"): [1, 2]}
    assert all(-1.000001 <= r.score <= 1.000001 for r in picked) and 3 not in {r.item_id for r in picked}


def test_partitioning_does_not_matter(spark, points):
    x = np.random.default_rng(1).normal(size=(200, 8))
    labels = assigned(spark, {i: i % 4 for i in range(200)})
    runs = [
        sorted((r.cluster_id, r.kind, r.rank, r.item_id) for r in exemplars.select_exemplars(labels, points(x, partitions=p)).collect())
        for p in (1, 4, 13)
    ]
    assert runs[0] == runs[1] == runs[2]


def test_groups_are_limited_before_the_shuffle(spark, points):
    plan = exemplars.select_exemplars(assigned(spark, {0: 0}), points([[1.0, 0.0]]))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
