"""Schemas of the stored tables."""

from __future__ import annotations

# Metadata is a map of strings: every CSV value stays a string.
ROWS = "row_id long, row_name string, metadata map<string,string>, source_row_number long"
ARTIFACTS = "artifact_id string, original_path string, stored_path string, mime_type string, bytes long"
ITEM_ARTIFACTS = "item_id long, artifact_id string, role string"
REPRESENTATIONS = (
    "representation_id long, item_id long, representation_type string, text string, text_hash string"
)
EMBEDDINGS = (
    "embedding_id long, representation_id long, item_id long, model_name string, "
    "dimensions int, vector array<float>"
)
REDUCTIONS = (
    "reduction_id long, embedding_reference string, method string, target_dimensions int, "
    "params string, fingerprint string"
)
COORDINATES = "reduction_id long, item_id long, coordinates array<double>"
SOM_NODES = (
    "reduction_id long, node_index long, grid_i int, grid_j int, weight array<double>, umatrix_dist double"
)
CLUSTER_RUNS = "cluster_run_id long, reduction_id long, method string, params string"
ASSIGNMENTS = "cluster_run_id long, item_id long, cluster_id long, membership_probability double"
EXEMPLARS = "cluster_run_id long, cluster_id long, item_id long, kind string, rank long, score double"
LABEL = "label string, short_label string, rationale string, keywords array<string>"
SUMMARIES = (
    "cluster_summary_id long, cluster_run_id long, cluster_id long, provider string, model string, "
    f"label string, detail struct<{', '.join(f.replace(' ', ': ', 1) for f in LABEL.split(', '))}, "
    "reconciled: boolean, reconcile_rationale: string, "
    f"original: struct<{', '.join(f.replace(' ', ': ', 1) for f in LABEL.split(', '))}>>"
)
CRITIQUE = "verdict string, quality_score double, recommendations array<string>"
METRICS = (
    "n_clusters long, noise_fraction double, total_items long, size_min long, size_max long, "
    "size_median double, silhouette double, squared_silhouette double"
)
CRITIQUES = (
    "critique_id long, cluster_run_id long, provider string, model string, "
    f"critique struct<{', '.join(f.replace(' ', ': ', 1) for f in CRITIQUE.split(', '))}>, "
    f"metrics struct<{', '.join(f.replace(' ', ': ', 1) for f in METRICS.split(', '))}>"
)
MODEL_CALLS = (
    "task_name string, request_id string, attempt int, call_number long, provider string, model string, "
    "prompt string, raw_text string, parsed string"
)
RUN_LOG = "log_id long, run_name string, stage string, level string, message string, payload string"
