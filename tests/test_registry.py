from cairnmap.operators.registry import export_layout


def test_newest_layout_without_pairing_runs_and_layouts(spark):
    """Runs of one embedding meet one row, not each of its layouts."""
    kinds = "reduction_id long, embedding_reference string, method string, target_dimensions int"
    rows = [(i, "e", "umap", 2) for i in range(60)] + [(60, "e", "umap", 3), (61, "e", "pca", 2), (62, "f", "umap", 2), (63, None, "umap", 2), (64, "g", "pca", 2)]
    reductions = spark.createDataFrame(rows, kinds)
    runs = reductions.selectExpr("reduction_id + 100 AS cluster_run_id", "reduction_id")
    found = export_layout(runs, reductions)
    assert {r.cluster_run_id: r.layout_id for r in found.collect()} == {**{i + 100: 59 for i in range(62)}, 162: 62}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join Inner, (embedding_reference")
    assert "Aggregate [embedding_reference" in plan[join:]
