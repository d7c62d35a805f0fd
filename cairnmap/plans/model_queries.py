"""Registered queries: neighbours, reductions, clusterings, CSV input and streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cairnmap.functions.frames import from_pandas
from cairnmap.operators import agglomerative, codebook, descent, hdbscan, neighbours, pca, registry, som, spanning, spectral, umap, views
from cairnmap.plans import inputs as I
from cairnmap.plans.catalog import over, query
from cairnmap.session import scratch_folder
from cairnmap.sources.csv_rows import read_csv_rows
from cairnmap.streaming import incremental


def _rounded(df, decimals: int = 4):
    return df.select(
        "item_id", F.posexplode("coordinates").alias("dim", "x")
    ).select("item_id", "dim", F.round("x", decimals).alias("x"))


# Input --------------------------------------------------------------------------------------------


@query("csv_rows", """
    SELECT row_number() OVER (ORDER BY c_custkey) AS row_id, c_name AS row_name, CAST(c_custkey AS VARCHAR) AS custkey,
        c_mktsegment || ', "' || c_nationkey || '"' || chr(10) || 'x' AS note, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'n' END AS maybe FROM customer""")
def csv_rows(spark, sf):
    """Customers written as CSV files with quotes and line breaks, read back as rows."""
    folder = scratch_folder(spark, "csv")
    note = F.concat("c_mktsegment", F.lit(', "'), "c_nationkey", F.lit('"\nx'))
    I.table(spark, sf, "customer").orderBy("c_custkey").select(
        F.col("c_name").alias("name"), F.col("c_custkey").cast("string").alias("custkey"), note.alias("note"),
        F.when(F.col("c_custkey") % 3 == 0, "").otherwise("n").alias("maybe"),
    ).write.option("header", True).option("escape", '"').csv(folder)
    rows = read_csv_rows(spark, folder)
    return rows.select("row_id", "row_name", *[F.col("metadata")[c].alias(c) for c in ("custkey", "note", "maybe")])


@query("stream_texts", over("reps_", sql="SELECT item_id, sha256(text) AS text_hash FROM reps_"))
def stream_texts(spark, sf):
    """Documents arriving as a stream; a second run over the same files adds nothing."""
    folder = scratch_folder(spark, "texts")
    docs = incremental.watch_table(spark, f"{sf}/documents.parquet", I.table(spark, sf, "documents").schema)
    name = F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat(F.lit("doc-"), F.col("doc_id")))
    source = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("source"))
    rows = docs.select(
        F.col("doc_id").alias("row_id"), name.alias("row_name"),
        F.create_map(
            F.lit("lang"), F.col("lang"), F.lit("source"), source, F.lit("n_chars"), F.col("n_chars").cast("string")
        ).alias("metadata"),
        F.col("text").alias("extracted_text"),
    )
    texts = incremental.first_of_key(incremental.text_stream(rows), "item_id")
    for _ in range(2):
        incremental.run_available(texts, incremental.write_batches(f"{folder}/out"), f"{folder}/progress")
    return spark.read.parquet(f"{folder}/out").select("item_id", "text_hash")


@query("stream_cells", over("bmu_", sql="SELECT item_id, node_index FROM bmu_"))
def stream_cells(spark, sf):
    folder = scratch_folder(spark, "cells")
    arriving = incremental.watch_table(spark, f"{sf}/embeddings.parquet", I.table(spark, sf, "embeddings").schema)
    vectors = arriving.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    cells = incremental.cell_stream(vectors, I.codebook(spark, sf))
    incremental.run_available(incremental.first_of_key(cells, "item_id"), incremental.write_batches(f"{folder}/out"), f"{folder}/progress")
    return spark.read.parquet(f"{folder}/out").select("item_id", "node_index")


# Neighbours ---------------------------------------------------------------------------------------

_KNN = """SELECT query_id, neighbor_id, rank, round(distance, 6) AS distance FROM (
    SELECT a.item_id AS query_id, b.item_id AS neighbor_id, list_distance(a.v, b.v) AS distance,
        row_number() OVER (PARTITION BY a.item_id ORDER BY list_distance(a.v, b.v), b.item_id) AS rank
    FROM vec_ a, vec_ b WHERE a.item_id <> b.item_id) WHERE rank <= 5"""


@query("knn", over("vec_", sql=_KNN))
def knn(spark, sf):
    points = I.vectors(spark, sf)
    found = neighbours.knn(points, points, 5, exclude_self=True)
    return found.withColumn("distance", F.round("distance", 6))


@query("knn_cells", over("vec_", sql=_KNN))
def knn_cells(spark, sf):
    """The same search laid out as for a base that fits no broadcast."""
    points = I.vectors(spark, sf)
    found = neighbours.knn(points, points, 5, exclude_self=True, broadcast_bytes=0, block_rows=256)
    return found.withColumn("distance", F.round("distance", 6))


@query("knn_search", over("nodes_", sql="""
    SELECT query_id, neighbor_id, rank, round(distance, 6) AS distance FROM (
    SELECT c.node_index AS query_id, b.item_id AS neighbor_id, list_distance(c.weight, b.v) AS distance,
        row_number() OVER (PARTITION BY c.node_index ORDER BY list_distance(c.weight, b.v), b.item_id) AS rank
    FROM nodes_ c, vec_ b) WHERE rank <= 10"""))
def knn_search(spark, sf):
    """Few queries against all vectors: queries are broadcast, the base is scanned once."""
    queries = I.codebook(spark, sf).select(F.col("node_index").alias("item_id"), F.col("weight").alias("vector"))
    found = neighbours.knn(queries, I.vectors(spark, sf), 10, broadcast_bytes=16 * 8 * 65)
    return found.withColumn("distance", F.round("distance", 6))


@query("knn_lsh")
def knn_lsh(spark, sf):
    points = I.vectors(spark, sf)
    found = neighbours.approximate_knn(points, points, 5, bucket_length=2.0, exclude_self=True)
    return found.withColumn("distance", F.round("distance", 6))


@query("knn_descent")
def knn_descent(spark, sf):
    """Approximate neighbours with the recall that a sample reached."""
    found = descent.nn_descent(I.vectors(spark, sf), 5)
    return found.lists.withColumn("distance", F.round("distance", 6)).withColumn("recall", F.lit(found.recall))


@query("core_distance", over("vec_", sql="""
    SELECT item_id, round(distance, 6) AS core FROM (SELECT a.item_id, list_distance(a.v, b.v) AS distance,
        row_number() OVER (PARTITION BY a.item_id ORDER BY list_distance(a.v, b.v), b.item_id) AS rank
    FROM vec_ a, vec_ b WHERE a.item_id <> b.item_id) WHERE rank = 5"""))
def core_distance(spark, sf):
    return neighbours.core_distances(I.vectors(spark, sf), 5).withColumn("core", F.round("core", 6))


# Reductions ---------------------------------------------------------------------------------------


@query("covariance", over("vec_", sql="""
    , x_ AS (SELECT item_id, unnest(v) AS x, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS pos FROM vec_)
    SELECT a.pos AS i, b.pos AS j, round(covar_samp(a.x, b.x), 8) AS covariance FROM x_ a JOIN x_ b USING (item_id) WHERE a.pos <= b.pos GROUP BY 1, 2"""))
def covariance(spark, sf):
    return pca.covariance(I.vectors(spark, sf)).withColumn("covariance", F.round("covariance", 8))


@query("pca")
def pca_coordinates(spark, sf):
    return _rounded(pca.pca(I.vectors(spark, sf), 10))


@query("pca_variance", over("vec_", sql="""
    SELECT round(sum(v), 6) AS variance FROM (SELECT pos, var_samp(x) AS v FROM (
        SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM vec_) GROUP BY 1)"""))
def pca_variance(spark, sf):
    """All components together keep the total variance of the input."""
    full = pca.pca(I.vectors(spark, sf), 1 << 20)
    per_dim = full.select(F.posexplode("coordinates").alias("dim", "x")).groupBy("dim").agg(F.var_samp("x").alias("v"))
    return per_dim.agg(F.round(F.sum("v"), 6).alias("variance"))


@query("pca_wide_variance", over("vec_", sql="""
    SELECT round(sum(v), 6) AS variance FROM (SELECT pos, var_samp(x) AS v FROM (
        SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM vec_) GROUP BY 1)"""))
def pca_wide_variance(spark, sf):
    """The same total from components that the search for wide vectors finds."""
    points = I.vectors(spark, sf)
    full = pca.project(points, pca.fit_pca(points, 1 << 20, max_width=16))
    per_dim = full.select(F.posexplode("coordinates").alias("dim", "x")).groupBy("dim").agg(F.var_samp("x").alias("v"))
    return per_dim.agg(F.round(F.sum("v"), 6).alias("variance"))


@query("pca_explained")
def pca_explained(spark, sf):
    fitted = pca.fit_pca(I.vectors(spark, sf), 10)
    return from_pandas(
        spark, pd.DataFrame({"component": np.arange(fitted.width), "share": np.round(fitted.explained, 6)}), "component int, share double"
    )


@query("som_grid_size", """
    SELECT lang, source, CAST(greatest(2, round_even(sqrt(5 * sqrt(greatest(count(*), 1))), 0)) AS INTEGER) AS side FROM documents GROUP BY 1, 2""")
def som_grid_size(spark, sf):
    counts = I.table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return counts.select("lang", "source", som.auto_grid_side(F.col("n")).alias("side"))


@query("som_train")
def som_train(spark, sf):
    trained = som.train_som(I.vectors(spark, sf))
    return trained.select("node_index", "grid_i", "grid_j", F.posexplode("weight").alias("pos", "x")).withColumn("x", F.round("x", 4))


@query("som_bmu", over("bmu_", sql="SELECT item_id, node_index, grid_i, grid_j FROM bmu_"))
def som_bmu(spark, sf):
    return som.best_nodes(I.vectors(spark, sf), I.codebook(spark, sf)).drop("distance")


_UMATRIX = """
    , u0_ AS (SELECT a.node_index, a.grid_i, a.grid_j, sum(list_distance(a.weight, b.weight)) AS s FROM nodes_ a, nodes_ b
        WHERE abs(a.grid_i - b.grid_i) <= 1 AND abs(a.grid_j - b.grid_j) <= 1 AND a.node_index <> b.node_index GROUP BY 1, 2, 3),
    u_ AS (SELECT node_index, grid_i, grid_j, s / (SELECT max(s) FROM u0_) AS umatrix_dist FROM u0_)"""


@query("som_umatrix", over("nodes_", sql=f"{_UMATRIX} SELECT node_index, grid_i, grid_j, round(umatrix_dist, 6) AS umatrix_dist FROM u_"))
def som_umatrix(spark, sf):
    return som.u_matrix(I.codebook(spark, sf)).withColumn("umatrix_dist", F.round("umatrix_dist", 6))


@query("som_grid", over("nodes_", "reds_", sql=f"""{_UMATRIX}
    SELECT reduction_id, grid AS grid_x, grid AS grid_y, node_index, grid_i, grid_j, round(umatrix_dist, 6) AS umatrix_dist
    FROM u_ JOIN reds_ ON reduction_id % 16 = node_index WHERE method = 'som' AND grid IS NOT NULL"""))
def som_grid(spark, sf):
    reductions = I.reductions(spark, sf)
    nodes = som.u_matrix(I.codebook(spark, sf)).join(
        reductions.select("reduction_id", (F.col("reduction_id") % 16).alias("node_index")), "node_index"
    )
    return views.som_grid(reductions, nodes).withColumn("umatrix_dist", F.round("umatrix_dist", 6))


@query("som_cells", over("bmu_", "asg_vec_", sql=f"""{_UMATRIX},
    p_ AS (SELECT node_index, cluster_id, count(*) AS n, min(item_id) AS f FROM bmu_ JOIN asg_vec_ USING (item_id) GROUP BY 1, 2),
    c_ AS (SELECT node_index, sum(n)::BIGINT AS n_items, arg_min(cluster_id, (-n, f)) AS dominant_cluster FROM p_ GROUP BY 1)
    SELECT node_index, grid_i, grid_j, round(umatrix_dist, 6) AS umatrix_dist, coalesce(n_items, 0) AS n_items, dominant_cluster,
        round(0.35 + 0.65 * (n_items / (SELECT max(n_items) FROM c_)), 6) AS intensity FROM u_ LEFT JOIN c_ USING (node_index)"""))
def som_cells(spark, sf):
    book = I.codebook(spark, sf)
    placed = som.cell_coordinates(som.best_nodes(I.vectors(spark, sf), book))
    points = placed.join(I.vector_assignments(spark, sf), "item_id").select(
        "item_id", "cluster_id", F.col("coordinates")[0].alias("x"), F.col("coordinates")[1].alias("y")
    )
    cells = views.som_cells(som.u_matrix(book), points)
    return cells.withColumn("umatrix_dist", F.round("umatrix_dist", 6)).withColumn("intensity", F.round("intensity", 6))


@query("fuzzy_graph")
def fuzzy_graph(spark, sf):
    points = I.vectors(spark, sf)
    graph = umap.fuzzy_graph(neighbours.knn(points, points, 14, exclude_self=True), 14)
    return graph.withColumn("weight", F.round("weight", 6))


@query("spectral_start")
def spectral_start(spark, sf):
    """Leading eigenvectors of the neighbour graph."""
    points = I.vectors(spark, sf)
    graph = umap.fuzzy_graph(neighbours.knn(points, points, 14, exclude_self=True), 14)
    found, _ = spectral.spectral_vectors(graph, 3)
    return found.select(F.col("id").alias("item_id"), F.posexplode("x").alias("dim", "x")).withColumn("x", F.round("x", 3))


@query("umap_2d")
def umap_2d(spark, sf):
    return _rounded(umap.umap(I.vectors(spark, sf), 2))


@query("umap_8d")
def umap_8d(spark, sf):
    return _rounded(umap.umap(I.vectors(spark, sf), 8))


@query("umap_landmarks")
def umap_landmarks(spark, sf):
    """A small landmark set, every other vector placed against it."""
    return _rounded(umap.umap_landmarks(I.vectors(spark, sf), 2, max_landmarks=256))


@query("fingerprint")
def fingerprint(spark, sf):
    return registry.fingerprint(I.vectors(spark, sf))


# Clusterings --------------------------------------------------------------------------------------


def _assigned(df):
    return df.withColumn("membership_probability", F.round("membership_probability", 6))


_TREE = """
    , d_ AS MATERIALIZED (SELECT a.item_id AS a, b.item_id AS b, list_distance(a.v, b.v) AS d FROM vec_ a, vec_ b),
    p_ AS (WITH RECURSIVE prim AS (
        SELECT 0 AS step, b AS node, d AS w, a AS src, a = b AS inside FROM d_ WHERE a = (SELECT min(item_id) FROM vec_)
        UNION ALL
        SELECT step + 1, node, CASE WHEN NOT inside AND node <> pick AND d < w THEN d ELSE w END,
            CASE WHEN NOT inside AND node <> pick AND d < w THEN pick ELSE src END, inside OR node = pick
        FROM (SELECT *, arg_min(node, (w, node)) FILTER (NOT inside) OVER () AS pick FROM prim) JOIN d_ ON a = pick AND b = node)
        SELECT * FROM prim WHERE step = (SELECT max(step) FROM prim)),
    t_ AS MATERIALIZED (SELECT least(node, src) AS a, greatest(node, src) AS b, w FROM p_ WHERE node <> (SELECT min(item_id) FROM vec_))"""


@query("spanning_tree", over("vec_", sql=f"{_TREE} SELECT a, b, round(w, 6) AS weight FROM t_"))
def spanning_tree(spark, sf):
    """Laid out as for points that fit neither one block nor a broadcast."""
    tree = spanning.spanning_tree(I.vectors(spark, sf), block_rows=256, broadcast_bytes=0)
    return tree.withColumn("weight", F.round("weight", 6))


@query("hdbscan")
def hdbscan_exact(spark, sf):
    return _assigned(hdbscan.hdbscan(I.whole_coordinates(spark, sf)))


@query("hdbscan_leaf")
def hdbscan_leaf(spark, sf):
    return _assigned(hdbscan.hdbscan(I.whole_coordinates(spark, sf), 10, 5, "leaf", 0.01))


@query("hdbscan_microclusters")
def hdbscan_micro(spark, sf):
    return _assigned(hdbscan.hdbscan_microclusters(I.whole_coordinates(spark, sf), micro_clusters=64))


@query("agglomerative_ward")
def ward(spark, sf):
    return agglomerative.agglomerative(I.whole_coordinates(spark, sf))


@query("agglomerative_complete")
def complete(spark, sf):
    return agglomerative.agglomerative(I.whole_coordinates(spark, sf), linkage="complete")


@query("agglomerative_average")
def average(spark, sf):
    return agglomerative.agglomerative(I.whole_coordinates(spark, sf), linkage="average")


@query("agglomerative_single", over("vec_", sql=f"""{_TREE},
    kept_t_ AS MATERIALIZED (SELECT a, b FROM t_ QUALIFY row_number() OVER (ORDER BY w, a, b) <= (SELECT count(*) FROM vec_) - 8),
    both_ AS (SELECT a, b FROM kept_t_ UNION ALL SELECT b, a FROM kept_t_),
    c_ AS (WITH RECURSIVE reach(item, low) AS (SELECT item_id, item_id FROM vec_ UNION SELECT b, low FROM reach JOIN both_ ON a = item AND low < b)
        SELECT item, min(low) AS low FROM reach GROUP BY 1)
    SELECT item AS item_id, CAST(dense_rank() OVER (ORDER BY low) - 1 AS BIGINT) AS cluster_id, CAST(1 AS DOUBLE) AS membership_probability FROM c_"""))
def single(spark, sf):
    return agglomerative.agglomerative(I.whole_coordinates(spark, sf), linkage="single")


@query("agglomerative_microclusters")
def ward_micro(spark, sf):
    return agglomerative.agglomerative_microclusters(I.whole_coordinates(spark, sf), micro_clusters=64)


@query("codebook_propagate", over("bmu_", sql="""
    SELECT item_id, node_index % 3 - 1 AS cluster_id, round(node_index / 16, 6) AS membership_probability FROM bmu_"""))
def codebook_propagate(spark, sf):
    book = I.codebook(spark, sf)
    nodes = book.withColumn("cluster_id", F.col("node_index") % 3 - 1).withColumn(
        "membership_probability", F.col("node_index") / 16
    )
    return _assigned(codebook.propagate(som.cell_coordinates(som.best_nodes(I.vectors(spark, sf), book)), nodes))


@query("codebook_clusters")
def codebook_clusters(spark, sf):
    book = I.codebook(spark, sf)
    placed = som.cell_coordinates(som.best_nodes(I.vectors(spark, sf), book))
    return codebook.cluster_codebook(placed, book, "agglomerative", {"n_clusters": 4, "linkage": "average"})
