import random

from cairnmap.functions.graph import connected_components


def _check(spark, edges, partitions):
    label = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in label and b in label and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    df = spark.createDataFrame(edges, "x long, y long").repartition(partitions)
    for together in (0, 1 << 20):
        assert {r.node: r.component for r in connected_components(df, "x", "y", together).collect()} == label


def test_components_of_paths_stars_and_random_graphs(spark):
    rng = random.Random(2)
    path = list(range(200))
    rng.shuffle(path)
    _check(spark, list(zip(path, path[1:])) + [(None, 1), (500, 500), (-3, -9)], 7)
    _check(spark, [(1_000, i) for i in range(50)] + [(rng.randrange(2_000, 2_400), rng.randrange(2_000, 2_400)) for _ in range(220)], 5)
    assert connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0
