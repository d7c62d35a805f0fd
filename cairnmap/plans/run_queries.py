"""Registered queries: runs, label versions, merges and the read side."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnmap.functions import prompts, vectors as V
from cairnmap.operators import labels, merge, metrics, registry, search_index, views
from cairnmap.operators.embed import item_vectors
from cairnmap.plans import inputs as I
from cairnmap.plans.catalog import over, query
from cairnmap.session import scratch_folder
from cairnmap.sources import artifacts
from cairnmap.sources.export import export_rows
from cairnmap.sources.store import Store

RUN = "cluster_run_id"


# Runs and their figures ---------------------------------------------------------------------------


@query("cluster_sizes", over("sizes_ord_", sql="SELECT * FROM sizes_ord_"))
def cluster_sizes(spark, sf):
    return metrics.cluster_sizes(I.order_assignments(spark, sf))


@query("run_metrics", over("asg_ord_", sql="""
    , n_ AS (SELECT cluster_run_id, cluster_id, count(*) AS n FROM asg_ord_ GROUP BY 1, 2)
    SELECT cluster_run_id, count(*) FILTER (cluster_id >= 0) AS n_clusters,
        round(coalesce(sum(n) FILTER (cluster_id = -1), 0) / sum(n), 6) AS noise_fraction, sum(n)::BIGINT AS total_items,
        coalesce(min(n) FILTER (cluster_id >= 0), 0) AS size_min, coalesce(max(n) FILTER (cluster_id >= 0), 0) AS size_max,
        coalesce(median(n) FILTER (cluster_id >= 0), 0) AS size_median FROM n_ GROUP BY 1"""))
def run_metrics(spark, sf):
    found = metrics.run_metrics(I.order_assignments(spark, sf))
    return found.withColumn("noise_fraction", F.round("noise_fraction", 6))


@query("silhouette", over("asg_vec_", "vec_", sql="""
    , p_ AS (SELECT cluster_id, item_id, v FROM asg_vec_ JOIN vec_ USING (item_id) WHERE cluster_id >= 0),
    n_ AS (SELECT cluster_id, count(*) AS n FROM p_ GROUP BY 1),
    d_ AS (SELECT a.item_id, a.cluster_id, b.cluster_id AS other, sum(list_distance(a.v, b.v)) AS t FROM p_ a, p_ b GROUP BY 1, 2, 3),
    ab_ AS (SELECT d.item_id, max(CASE WHEN d.cluster_id = other THEN t / nullif(n - 1, 0) END) AS a,
        min(CASE WHEN d.cluster_id <> other THEN t / n END) AS b FROM d_ d JOIN n_ ON n_.cluster_id = other GROUP BY 1)
    SELECT CAST(1 AS BIGINT) AS cluster_run_id, round(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 3) AS silhouette FROM ab_"""))
def silhouette(spark, sf):
    return metrics.silhouette(I.vector_assignments(spark, sf), I.whole_coordinates(spark, sf))


@query("squared_silhouette", over("asg_vec_", "vec_", sql="""
    , p_ AS (SELECT cluster_id, item_id, v FROM asg_vec_ JOIN vec_ USING (item_id) WHERE cluster_id >= 0),
    n_ AS (SELECT cluster_id, count(*) AS n FROM p_ GROUP BY 1),
    d_ AS (SELECT a.item_id, a.cluster_id, b.cluster_id AS other, sum(list_distance(a.v, b.v) ** 2) AS t FROM p_ a, p_ b GROUP BY 1, 2, 3),
    ab_ AS (SELECT d.item_id, max(CASE WHEN d.cluster_id = other THEN t / nullif(n - 1, 0) END) AS a,
        min(CASE WHEN d.cluster_id <> other THEN t / n END) AS b FROM d_ d JOIN n_ ON n_.cluster_id = other GROUP BY 1)
    SELECT CAST(1 AS BIGINT) AS cluster_run_id, (SELECT count(*) FROM embeddings) AS n_items,
        round(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS squared_silhouette FROM ab_"""))
def squared_silhouette(spark, sf):
    assigned, placed = I.vector_assignments(spark, sf), I.whole_coordinates(spark, sf)
    score = metrics.squared_silhouette(assigned, placed)
    return assigned.groupBy(RUN).agg(F.count("*").alias("n_items")).withColumn(
        "squared_silhouette", F.round(F.lit(score).cast("double"), 6)
    )


@query("fetch_row", over("rows_", sql="SELECT row_id, row_name, source FROM rows_ WHERE row_id = 11"))
def fetch_row(spark, sf):
    return views.by_id(I.rows(spark, sf), "row_id", 11).select("row_id", "row_name", F.col("metadata")["source"].alias("source"))


@query("stored_coordinates", over("vec_", sql="SELECT item_id, round(v[1], 6) AS x, round(v[2], 6) AS y FROM vec_"))
def stored_coordinates(spark, sf):
    """Two reductions in the partitioned store; reading one scans only its own files."""
    store = Store(spark, scratch_folder(spark, "store"))
    for number, dims in ((1, 8), (2, 2)):
        placed = I.coordinates(spark, sf, dims).withColumn("reduction_id", F.lit(number).cast("long"))
        store.append("coordinates", placed)
    one = store.read("coordinates").filter("reduction_id = 2")
    return one.select("item_id", *[F.round(F.col("coordinates")[i], 6).alias(n) for i, n in enumerate("xy")])


@query("model_vectors", over("vec_", sql="""
    SELECT item_id, round(list_sum(v), 5) AS total FROM vec_ JOIN embeddings ON vec_id = item_id WHERE label % 2 = 0"""))
def model_vectors(spark, sf):
    """Vectors of one model from a table that holds several."""
    stored = I.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("model_name"),
        F.col("embedding").alias("vector"),
    )
    return item_vectors(stored, "even").select("item_id", F.round(V.total(V.as_doubles(F.col("vector"))), 5).alias("total"))


@query("find_reduction", over("reds_", sql="""
    SELECT max(reduction_id) AS reduction_id FROM reds_ WHERE method = 'umap' AND target_dimensions = 4"""))
def find_reduction(spark, sf):
    return registry.find_reduction(I.reductions(spark, sf), *registry.parse_reference("umap_4d"))


@query("new_reductions", over("reds_", sql="""
    SELECT w.embedding_reference, w.method, w.target_dimensions, w.fingerprint, count(*) AS n FROM
        (SELECT embedding_reference, method, target_dimensions, grid, CASE WHEN reduction_id % 5 = 0 THEN 'changed' ELSE fingerprint END AS fingerprint FROM reds_) w
    WHERE fingerprint = 'changed' GROUP BY 1, 2, 3, 4"""))
def new_reductions(spark, sf):
    stored = I.reductions(spark, sf)
    wanted = stored.withColumn(
        "fingerprint", F.when(F.col("reduction_id") % 5 == 0, "changed").otherwise(F.col("fingerprint"))
    )
    fresh = registry.new_reductions(wanted, stored.drop("reduction_id"))
    return fresh.groupBy("embedding_reference", "method", "target_dimensions", "fingerprint").agg(F.count("*").alias("n"))


@query("new_runs", over("reds_", sql="""
    SELECT reduction_id, method FROM reds_ WHERE reduction_id % 2 = 1"""))
def new_runs(spark, sf):
    wanted = I.reductions(spark, sf).select("reduction_id", "method", "params")
    return registry.new_runs(wanted, wanted.filter("reduction_id % 2 = 0")).select("reduction_id", "method")


@query("export_layouts", over("reds_", "runs_", sql="""
    SELECT r.reduction_id AS cluster_run_id, max(b.reduction_id) AS layout_id FROM reds_ r JOIN reds_ b USING (embedding_reference)
    WHERE b.method = 'umap' AND b.target_dimensions = 2 GROUP BY 1"""))
def export_layouts(spark, sf):
    reds = I.reductions(spark, sf)
    return registry.export_layout(reds.select(F.col("reduction_id").alias(RUN), "reduction_id"), reds)


@query("export_run", over("asg_doc_", "rows_", "vec_", sql="""
    SELECT row_id, row_name, cluster_id, coalesce(label, '') AS cluster_label, round(v[1], 6) AS umap2_x, round(v[2], 6) AS umap2_y,
        CAST(json_object('lang', lang, 'source', source, 'n_chars', n_chars) AS VARCHAR) AS metadata
    FROM asg_doc_ JOIN rows_ ON row_id = item_id
    LEFT JOIN (SELECT (c_custkey // 25) % 40 - 1 AS cluster_id, c_mktsegment || ' ' || c_nationkey AS label FROM customer
        WHERE c_custkey % 25 + 1 = 2 QUALIFY row_number() OVER (PARTITION BY (c_custkey // 25) % 40 ORDER BY c_custkey DESC) = 1) USING (cluster_id)
    LEFT JOIN (SELECT * FROM vec_ WHERE item_id % 2 = 0) USING (item_id)"""))
def export_run(spark, sf):
    placed = I.coordinates(spark, sf).withColumn("reduction_id", F.col("item_id") % 2 + 3)
    key = F.col("n_nationkey").cast("long")
    layouts = I.table(spark, sf, "nation").select(key.alias(RUN), (key + 1).alias("layout_id"))
    out = export_rows(
        I.rows(spark, sf), I.document_assignments(spark, sf), I.summaries(spark, sf), placed, layouts
    )
    number = lambda c: F.round(F.when(F.col(c) != "", F.col(c)).cast("double"), 6).alias(c)
    return out.select("row_id", "row_name", "cluster_id", "cluster_label", number("umap2_x"), number("umap2_y"), "metadata")


# Labels -------------------------------------------------------------------------------------------


@query("latest_labels", over("latest_", sql="SELECT cluster_run_id, cluster_id, cluster_summary_id, label FROM latest_"))
def latest_labels(spark, sf):
    return labels.latest_labels(I.summaries(spark, sf)).select(RUN, "cluster_id", "cluster_summary_id", "label")


@query("pending_labels", over("sizes_ord_", "sums_", sql="""
    SELECT cluster_run_id, cluster_id, size FROM sizes_ord_ s WHERE NOT EXISTS (SELECT 1 FROM sums_ u
        WHERE u.cluster_run_id = s.cluster_run_id AND u.cluster_id = s.cluster_id AND provider = 'p0' AND model = 'm1')"""))
def pending_labels(spark, sf):
    return labels.pending_labels(
        metrics.cluster_sizes(I.order_assignments(spark, sf)), I.summaries(spark, sf), "p0", "m1"
    )


@query("reconcilable_runs", over("sums_", sql="""
    SELECT cluster_run_id, count(DISTINCT cluster_id) FILTER (cluster_id >= 0) AS n_clusters FROM sums_
    GROUP BY 1 HAVING NOT bool_or(reconciled) AND count(DISTINCT cluster_id) FILTER (cluster_id >= 0) >= 2"""))
def reconcilable_runs(spark, sf):
    return labels.reconcilable_runs(I.summaries(spark, sf))


@query("reconcile_prompts", over("latest_", "sizes_ord_", sql=f"""
    SELECT cluster_run_id, n_clusters, replace(replace('{prompts.RECONCILE_REQUEST.replace("%s", "@1", 1).replace("%s", "@2", 1)}',
        '@1', CAST(n_clusters AS VARCHAR)), '@2', body) AS prompt FROM (
    SELECT cluster_run_id, count(*) AS n_clusters, string_agg('Cluster ' || cluster_id || ' (size ' || coalesce(size, 0) || '):' || chr(10) ||
        '  label: ' || label || chr(10) || '  short_label: ' || coalesce(short_label, '') || chr(10) || '  keywords: ' || keywords || chr(10) ||
        '  rationale: ' || rationale, chr(10) || chr(10) ORDER BY cluster_id) AS body
    FROM latest_ LEFT JOIN sizes_ord_ USING (cluster_run_id, cluster_id) WHERE cluster_id >= 0 GROUP BY 1)"""))
def reconcile_prompts(spark, sf):
    return prompts.reconcile_prompts(labels.label_info(I.order_assignments(spark, sf), I.summaries(spark, sf)))


@query("reconcile_apply", over("latest_", sql="""
    , new_ AS (SELECT s_suppkey % 25 + 1 AS cluster_run_id, (s_suppkey // 25) % 40 AS cluster_id, s_name, s_nationkey FROM supplier
        QUALIFY row_number() OVER (PARTITION BY cluster_run_id, cluster_id ORDER BY s_suppkey DESC) = 1)
    SELECT cluster_run_id, cluster_id, coalesce(s_name, label) AS label, CASE WHEN s_name IS NULL THEN coalesce(short_label, '') ELSE 's' || s_nationkey END AS short_label,
        rationale, CASE WHEN s_name IS NULL THEN keywords ELSE 'k' || s_nationkey END AS keywords, true AS reconciled,
        CASE WHEN s_name IS NULL THEN 'unchanged' ELSE 'renamed' END AS reconcile_rationale, label AS original_label
    FROM latest_ LEFT JOIN new_ USING (cluster_run_id, cluster_id)"""))
def reconcile_apply(spark, sf):
    revised = I.table(spark, sf, "supplier").select(
        (F.col("s_suppkey") % 25 + 1).alias(RUN), F.expr("(s_suppkey div 25) % 40").alias("cluster_id"),
        F.col("s_suppkey").alias("pos"), F.col("s_name").alias("label"),
        F.concat(F.lit("s"), F.col("s_nationkey")).alias("short_label"),
        F.array(F.concat(F.lit("k"), F.col("s_nationkey"))).alias("keywords"), F.lit("renamed").alias("reconcile_rationale"),
    )
    done = labels.reconcile(labels.latest_labels(I.summaries(spark, sf)), revised)
    return done.select(
        RUN, "cluster_id", "label", "detail.short_label", "detail.rationale",
        F.array_join("detail.keywords", ", ").alias("keywords"), "detail.reconciled", "detail.reconcile_rationale",
        F.col("detail.original.label").alias("original_label"),
    )


@query("critique_prompts", over("asg_ord_", "latest_", sql=f"""
    , n_ AS (SELECT cluster_run_id, cluster_id, count(*) AS n FROM asg_ord_ GROUP BY 1, 2),
    k_ AS (SELECT cluster_run_id, count(*) FILTER (cluster_id >= 0) AS k, coalesce(sum(n) FILTER (cluster_id = -1), 0) / sum(n) AS noise, sum(n)::BIGINT AS t,
        min(n) FILTER (cluster_id >= 0) AS lo, max(n) FILTER (cluster_id >= 0) AS hi, median(n) FILTER (cluster_id >= 0) AS mid FROM n_ GROUP BY 1),
    l_ AS (SELECT cluster_run_id, string_agg('- Cluster ' || cluster_id || ': ' || label, chr(10) ORDER BY cluster_id) AS body FROM latest_ GROUP BY 1)
    SELECT cluster_run_id, replace(replace('{prompts.CRITIQUE_REQUEST.replace("%s", "@1", 1).replace("%s", "@2", 1)}', '@1',
        printf('clusters: %d%snoise: %.2f%%%sitems: %d%ssizes: min %d, max %d, median %.1f%ssilhouette: N/A', k, chr(10), noise * 100, chr(10), t, chr(10), lo, hi, mid, chr(10))),
        '@2', coalesce(body, '(no labels available)')) AS prompt FROM k_ LEFT JOIN l_ USING (cluster_run_id)"""))
def critique_prompts(spark, sf):
    figures = metrics.run_metrics(I.order_assignments(spark, sf)).withColumn("silhouette", F.lit(None).cast("double"))
    return prompts.critique_prompts(figures, labels.latest_labels(I.summaries(spark, sf)))


@query("pending_critiques", over("runs_", "crits_", sql="""
    SELECT cluster_run_id FROM runs_ WHERE cluster_run_id NOT IN (SELECT cluster_run_id FROM crits_ WHERE provider = 'p0' AND model = 'm0')"""))
def pending_critiques(spark, sf):
    return labels.pending_critiques(I.runs(spark, sf).select(RUN), I.critiques(spark, sf), "p0", "m0")


# Merges -------------------------------------------------------------------------------------------


def _valid(spark, sf):
    return merge.valid_clusters(I.order_assignments(spark, sf))


def _kept(spark, sf):
    valid = _valid(spark, sf)
    return valid, merge.apply_floor(merge.sanitize(I.decisions(spark, sf), valid), valid)


def _flat(groups):
    return groups.select(
        RUN, "group_no", F.size("cluster_ids").cast("long").alias("n"), F.array_join(
            F.transform("cluster_ids", lambda c: c.cast("string")), ",").alias("cluster_ids"), "rationale",
    )


@query("gather_clusters", over("latest_", "sizes_ord_", sql="""
    SELECT cluster_run_id, cluster_id, size, label, rationale, keywords FROM sizes_ord_ JOIN latest_ USING (cluster_run_id, cluster_id)"""))
def gather_clusters(spark, sf):
    found = merge.gather_clusters(I.order_assignments(spark, sf), I.summaries(spark, sf))
    return found.withColumn("keywords", F.array_join("keywords", ", "))


@query("merge_prompts", over("latest_", "sizes_ord_", sql=f"""
    SELECT cluster_run_id, count(*) AS n_clusters, replace('{prompts.MERGE_REQUEST.replace("%s", "@1")}', '@1',
        string_agg('- Cluster ' || cluster_id || ' (size ' || size || '): ' || label || chr(10) || '    rationale: ' || rationale || chr(10) ||
        '    keywords: ' || keywords, chr(10) ORDER BY cluster_id)) AS prompt
    FROM sizes_ord_ JOIN latest_ USING (cluster_run_id, cluster_id) GROUP BY 1"""))
def merge_prompts(spark, sf):
    return prompts.merge_prompts(merge.gather_clusters(I.order_assignments(spark, sf), I.summaries(spark, sf)))


@query("merge_sanitize", over("groups_", sql="SELECT cluster_run_id, group_no, n, cluster_ids FROM groups_"))
def merge_sanitize(spark, sf):
    return _flat(merge.sanitize(I.decisions(spark, sf), _valid(spark, sf))).drop("rationale")


@query("merge_floor", over("kept_", sql="SELECT cluster_run_id, group_no, n, cluster_ids FROM kept_"))
def merge_floor(spark, sf):
    return _flat(_kept(spark, sf)[1]).drop("rationale")


@query("merge_id_map", over("map_", sql="SELECT * FROM map_"))
def merge_id_map(spark, sf):
    return merge.id_map(*_kept(spark, sf))


@query("merge_assignments", over("asg_ord_", "map_", sql="""
    SELECT cluster_run_id, item_id, CASE WHEN cluster_id < 0 THEN -1 ELSE new_cluster_id END AS cluster_id, membership_probability
    FROM asg_ord_ LEFT JOIN map_ USING (cluster_run_id, cluster_id)"""))
def merge_assignments(spark, sf):
    return merge.rewrite_assignments(I.order_assignments(spark, sf), merge.id_map(*_kept(spark, sf)))


@query("merge_log", over("kept_", "map_", sql="""
    SELECT k.cluster_run_id AS parent_cluster_run_id, new_cluster_id, cluster_ids AS source_cluster_ids
    FROM kept_ k JOIN map_ m ON m.cluster_run_id = k.cluster_run_id AND m.cluster_id = k.anchor"""))
def merge_log(spark, sf):
    valid, kept = _kept(spark, sf)
    log = merge.merge_log(kept, merge.id_map(valid, kept))
    return log.select(
        "parent_cluster_run_id", "new_cluster_id",
        F.array_join(F.transform("source_cluster_ids", lambda c: c.cast("string")), ",").alias("source_cluster_ids"),
    )


@query("merged_child", over("runs_", sql="""
    SELECT max(cluster_run_id) AS cluster_run_id FROM runs_ WHERE method = 'merged' AND json_extract_string(params, '$.model') = 'm1'"""))
def merged_child(spark, sf):
    return merge.merged_child(I.runs(spark, sf), 1, "p", "m1")


# Read side ----------------------------------------------------------------------------------------


@query("run_list", over("runs_", "asg_ord_", sql="""
    SELECT r.cluster_run_id, any_value(reduction_id) AS reduction_id, any_value(method) AS method, any_value(params) AS params,
        count(DISTINCT cluster_id) FILTER (cluster_id >= 0) AS n_clusters, count(item_id) AS n_items,
        count(*) FILTER (cluster_id < 0) AS n_noise,
        round(CASE WHEN count(item_id) > 0 THEN count(*) FILTER (cluster_id < 0) / count(item_id) END, 6) AS noise_share
    FROM runs_ r LEFT JOIN asg_ord_ USING (cluster_run_id) GROUP BY 1"""))
def run_list(spark, sf):
    listed = views.run_list(I.runs(spark, sf), I.order_assignments(spark, sf))
    return listed.withColumn("noise_share", F.round("noise_share", 6)).orderBy(F.col(RUN).desc())


@query("run_detail", over("latest_", "asg_ord_", sql="""
    SELECT cluster_run_id, cluster_id, item_id, membership_probability, label FROM asg_ord_
    LEFT JOIN latest_ USING (cluster_run_id, cluster_id) WHERE cluster_run_id = 7"""))
def run_detail(spark, sf):
    return views.run_assignments(I.order_assignments(spark, sf), I.summaries(spark, sf), 7)


@query("cluster_details", over("latest_", "asg_ord_", sql="""
    SELECT l.cluster_run_id, l.cluster_id, label, coalesce(n, 0) AS size, coalesce(short_label, '') AS short_label, rationale, keywords, provider, model
    FROM latest_ l LEFT JOIN (SELECT cluster_run_id, cluster_id, count(*) AS n FROM asg_ord_ GROUP BY 1, 2) USING (cluster_run_id, cluster_id)"""))
def cluster_details(spark, sf):
    found = views.cluster_details(I.order_assignments(spark, sf), I.summaries(spark, sf))
    return found.withColumn("keywords", F.array_join("keywords", ", "))


@query("label_fields", """
    SELECT doc_id AS request_id, CASE WHEN doc_id % 6 IN (0, 3) THEN source ELSE '' END AS short_label,
        CASE WHEN doc_id % 6 IN (0, 3) THEN lang || ', ' || source ELSE '' END AS keywords FROM documents""")
def label_fields(spark, sf):
    return I.replies(spark, sf).select("request_id", *views.label_fields(F.col("raw_text"))).select(
        "request_id", "short_label", F.array_join("keywords", ", ").alias("keywords")
    )


@query("cluster_search", over("latest_", sql="""
    SELECT cluster_run_id, cluster_id, label FROM latest_ WHERE contains(lower(label), 'build')"""))
def cluster_search(spark, sf):
    return views.clusters_named(labels.latest_labels(I.summaries(spark, sf)), " Build ").select(RUN, "cluster_id", "label")


@query("latest_critique", over("crits_", sql="""
    SELECT * FROM crits_ QUALIFY row_number() OVER (PARTITION BY cluster_run_id ORDER BY critique_id DESC) = 1"""))
def latest_critique(spark, sf):
    return views.latest_critique(I.critiques(spark, sf))


@query("quality_band", over("crits_", sql="""
    SELECT critique_id, CASE WHEN quality_score >= 0.7 THEN 'success' WHEN quality_score >= 0.4 THEN 'warn' ELSE 'danger' END AS band FROM crits_"""))
def quality_band(spark, sf):
    return I.critiques(spark, sf).select("critique_id", metrics.quality_band(F.col("quality_score")).alias("band"))


@query("layouts", over("reds_", "runs_", sql="""
    , l_ AS (SELECT reduction_id, method, target_dimensions AS dims, CASE method WHEN 'som' THEN 'SOM grid' WHEN 'umap' THEN 'UMAP' ELSE 'PCA' END AS label
        FROM reds_ WHERE target_dimensions = 2)
    SELECT *, reduction_id = (SELECT reduction_id FROM l_ ORDER BY CASE
        WHEN reduction_id = (SELECT reduction_id FROM runs_ WHERE cluster_run_id = 3) THEN 0 WHEN method = 'umap' THEN 1 ELSE 2 END, reduction_id LIMIT 1) AS is_default FROM l_"""))
def layouts(spark, sf):
    return views.layouts(views.by_id(I.runs(spark, sf), RUN, 3), I.reductions(spark, sf))


@query("layout_points", over("asg_vec_", "vec_", "reps_", "rows_", "arts_", sql="""
    SELECT a.item_id, round(v[1], 6) AS x, round(v[2], 6) AS y, cluster_id, row_name AS record_name, sha256(p.text) AS embedding_text,
        lang, image_artifact_id FROM asg_vec_ a JOIN vec_ USING (item_id) JOIN reps_ p USING (item_id) JOIN rows_ ON row_id = a.item_id
    LEFT JOIN (SELECT l.item_id, min(artifact_id) AS image_artifact_id FROM links_ l JOIN arts_ USING (artifact_id)
        WHERE mime_type LIKE 'image/%' GROUP BY 1) USING (item_id)"""))
def layout_points(spark, sf):
    points = views.layout_points(
        I.rows(spark, sf), I.representations(spark, sf), I.coordinates(spark, sf), I.vector_assignments(spark, sf), _images(spark, sf)
    )
    return points.select(
        "item_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "cluster_id", "record_name",
        F.sha2("embedding_text", 256).alias("embedding_text"), F.col("metadata")["lang"].alias("lang"), "image_artifact_id",
    )


def _images(spark, sf):
    links = artifacts.addressed(I.page_files(spark, sf))
    return artifacts.first_images(artifacts.item_artifacts(links), artifacts.artifacts(links))


@query("first_images", over("arts_", sql="""
    SELECT l.item_id, min(artifact_id) AS image_artifact_id FROM links_ l JOIN arts_ USING (artifact_id) WHERE mime_type LIKE 'image/%' GROUP BY 1"""))
def first_images(spark, sf):
    return _images(spark, sf)


@query("item_detail", over("rows_", "reps_", sql="""
    SELECT row_id AS item_id, row_name AS record_name, source, sha256(p.text) AS text_hash FROM rows_ JOIN reps_ p ON p.item_id = row_id"""))
def item_detail(spark, sf):
    found = views.item_detail(I.rows(spark, sf), I.representations(spark, sf))
    return found.select(
        "item_id", "record_name", F.col("metadata")["source"].alias("source"), F.sha2("embedding_text", 256).alias("text_hash")
    )


_MATCH = "contains(lower(row_name || ' ' || p.text), 'the') AND contains(lower(row_name || ' ' || p.text), 'doc-') AND contains(lower(source), 'rc1')"


def _searched(spark, sf):
    joined = views.item_detail(I.rows(spark, sf), I.representations(spark, sf))
    matches = views.search_match(
        " The doc- ", {"source": " RC1 ", "": "x", "lang": ""}, F.col("record_name"), F.col("embedding_text"), F.col("metadata")
    )
    return joined, matches


@query("search_filter", over("rows_", "reps_", sql=f"SELECT row_id AS item_id FROM rows_ JOIN reps_ p ON p.item_id = row_id WHERE {_MATCH}"))
def search_filter(spark, sf):
    joined, matches = _searched(spark, sf)
    return joined.filter(matches).select("item_id")


@query("search_indexed", over("rows_", "reps_", sql=f"SELECT row_id AS item_id FROM rows_ JOIN reps_ p ON p.item_id = row_id WHERE {_MATCH}"))
def search_indexed(spark, sf):
    """The same search through a stored index of three-character grams."""
    joined, _ = _searched(spark, sf)
    items = joined.select("item_id", F.col("record_name").alias("name"), F.col("embedding_text").alias("text"), "metadata")
    folder = scratch_folder(spark, "grams")
    search_index.add_to_index(folder, items)
    return search_index.search(items, folder, " The doc- ", {"source": " RC1 ", "": "x", "lang": ""}).select("item_id")


@query("visibility", over("rows_", "reps_", "asg_doc_", sql=f"""
    SELECT row_id AS item_id, CASE WHEN {_MATCH} AND cluster_id = 3 THEN 'full' ELSE 'faded' END AS shown
    FROM rows_ JOIN reps_ p ON p.item_id = row_id JOIN asg_doc_ a ON a.item_id = row_id"""))
def visibility(spark, sf):
    joined, matches = _searched(spark, sf)
    return joined.join(I.document_assignments(spark, sf), "item_id").select(
        "item_id", views.visibility(matches, F.col("cluster_id"), 3).alias("shown")
    )


@query("facet_keys", "SELECT DISTINCT unnest(['lang', 'source', 'n_chars']) AS key FROM documents")
def facet_keys(spark, sf):
    return views.facet_keys(I.rows(spark, sf)).orderBy("key")


@query("facet_values", over("rows_", sql="""
    SELECT key, value, count(*) AS n_items FROM (SELECT unnest(['lang', 'source', 'n_chars']) AS key, unnest([lang, source, n_chars]) AS value FROM rows_)
    WHERE value <> '' GROUP BY 1, 2"""))
def facet_values(spark, sf):
    return views.facet_values(I.rows(spark, sf)).orderBy("key", "value")


@query("plot_bounds", over("vec_", sql="""
    SELECT round(min(v[1]) - s1 * 0.05, 6) AS min_x, round(max(v[1]) + s1 * 0.05, 6) AS max_x, round(min(v[2]) - s2 * 0.05, 6) AS min_y, round(max(v[2]) + s2 * 0.05, 6) AS max_y
    FROM vec_, (SELECT max(v[1]) - min(v[1]) AS s1, max(v[2]) - min(v[2]) AS s2 FROM vec_) GROUP BY s1, s2"""))
def plot_bounds(spark, sf):
    points = I.coordinates(spark, sf).select(F.col("coordinates")[0].alias("x"), F.col("coordinates")[1].alias("y"))
    return views.plot_bounds(points).select(*[F.round(c, 6).alias(c) for c in ("min_x", "max_x", "min_y", "max_y")])


@query("recent_logs", "SELECT event_id AS log_id, event_type AS stage FROM events ORDER BY event_id DESC LIMIT 50")
def recent_logs(spark, sf):
    return views.recent(I.run_log(spark, sf), "log_id", views.RECENT_LOG_LIMIT).select("log_id", "stage")


@query("run_logs", "SELECT event_id AS log_id, props AS payload FROM events WHERE user_id = 8 ORDER BY event_id LIMIT 200")
def run_logs(spark, sf):
    return views.log_of(I.run_log(spark, sf), "run-8").select("log_id", "payload")


@query("recent_runs", """
    SELECT 'run-' || user_id AS run_name, count(*) AS entries, max(event_id) AS last_entry FROM events GROUP BY 1 ORDER BY last_entry DESC LIMIT 20""")
def recent_runs(spark, sf):
    per_run = I.run_log(spark, sf).groupBy("run_name").agg(F.count("*").alias("entries"), F.max("log_id").alias("last_entry"))
    return views.recent(per_run, "last_entry", views.JOB_LIMIT)
