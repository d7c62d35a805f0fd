"""The engine's tables seen through the given ones, for the registered queries.

Every function reads whole tables; nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairnmap.functions import vectors as V
from cairnmap.operators import materialize
from cairnmap.sources.csv_rows import rows_from_table


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rows(spark, sf) -> DataFrame:
    """Documents as rows: some without a name, some without a source."""
    docs = table(spark, sf, "documents").withColumn(
        "source", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("source"))
    )
    name = F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat(F.lit("doc-"), F.col("doc_id")))
    return rows_from_table(docs, "doc_id", name, ["lang", "source", "n_chars"])


def extracted(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("extracted_text"))


def representations(spark, sf) -> DataFrame:
    return materialize.representations(rows(spark, sf), extracted(spark, sf))


def plain_texts(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text")


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))


def whole_coordinates(spark, sf) -> DataFrame:
    """Every component of each vector as coordinates."""
    return vectors(spark, sf).select("item_id", V.as_doubles(F.col("vector")).alias("coordinates"))


def coordinates(spark, sf, dims: int = 2) -> DataFrame:
    """First components of each vector, for queries about points in the plane."""
    return vectors(spark, sf).select(
        "item_id", F.slice(V.as_doubles(F.col("vector")), 1, dims).alias("coordinates")
    )


def vector_assignments(spark, sf) -> DataFrame:
    """One run over the vectors: the label is the cluster, every 17th item is noise."""
    return table(spark, sf, "embeddings").select(
        F.lit(1).cast("long").alias("cluster_run_id"), F.col("vec_id").alias("item_id"),
        F.when(F.col("vec_id") % 17 == 0, -1).otherwise(F.col("label")).cast("long").alias("cluster_id"),
        F.when(F.col("vec_id") % 17 == 0, 0.0).otherwise(1.0).alias("membership_probability"),
    )


def document_assignments(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.lit(2).cast("long").alias("cluster_run_id"), F.col("doc_id").alias("item_id"),
        (F.col("n_chars") % 13 - 1).alias("cluster_id"), F.lit(1.0).alias("membership_probability"),
    )


def order_assignments(spark, sf) -> DataFrame:
    """Many runs: orders are the items, customers decide run and cluster."""
    return table(spark, sf, "orders").select(
        (F.col("o_custkey") % 25 + 1).alias("cluster_run_id"), F.col("o_orderkey").alias("item_id"),
        F.expr("(o_custkey div 25) % 40 - 1").alias("cluster_id"),
        F.round(F.col("o_totalprice") / 1000000, 4).alias("membership_probability"),
    )


def runs(spark, sf) -> DataFrame:
    """A run per nation with assignments and one per region without any."""
    nations = table(spark, sf, "nation").select(
        (F.col("n_nationkey") + 1).cast("long").alias("cluster_run_id"), F.col("n_regionkey").cast("long").alias("reduction_id"),
        F.when(F.col("n_nationkey") % 2 == 0, "hdbscan").otherwise("agglomerative").alias("method"),
        F.concat(F.lit('{"k": '), F.col("n_nationkey"), F.lit("}")).alias("params"),
    )
    regions = table(spark, sf, "region").select(
        (F.col("r_regionkey") + 26).cast("long").alias("cluster_run_id"), F.col("r_regionkey").cast("long").alias("reduction_id"),
        F.lit("merged").alias("method"),
        F.concat(
            F.lit('{"model": "m'), F.col("r_regionkey") % 2, F.lit('", "parent_cluster_run_id": 1, "provider": "p"}')
        ).alias("params"),
    )
    return nations.unionByName(regions)


def summaries(spark, sf) -> DataFrame:
    """Label versions from customers; the higher key is the newer one."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("cluster_summary_id"), (F.col("c_custkey") % 25 + 1).alias("cluster_run_id"),
        F.expr("(c_custkey div 25) % 40 - 1").alias("cluster_id"),
        F.when(F.col("c_custkey") % 2 == 0, "p0").otherwise("p1").alias("provider"),
        F.concat(F.lit("m"), F.col("c_custkey") % 3).alias("model"),
        F.concat_ws(" ", "c_mktsegment", "c_nationkey").alias("label"),
        F.struct(
            F.concat_ws(" ", "c_mktsegment", "c_nationkey").alias("label"),
            F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")).alias("short_label"),
            F.col("c_name").alias("rationale"),
            F.array(F.col("c_mktsegment"), F.concat(F.lit("n"), F.col("c_nationkey"))).alias("keywords"),
            (F.col("c_custkey") % 625 == 24).alias("reconciled"),
            F.lit(None).cast("string").alias("reconcile_rationale"),
        ).alias("detail"),
    )


def decisions(spark, sf) -> DataFrame:
    """Merge proposals from customers; some ids are noise, unknown or named twice."""
    run = F.col("c_custkey") % 25 + 1
    return table(spark, sf, "customer").select(
        run.alias("cluster_run_id"), (F.col("c_nationkey") % (run % 6 + 1)).cast("long").alias("group_no"),
        F.col("c_custkey").alias("pos"), F.expr("(c_custkey div 25) % 44 - 1").alias("cluster_id"),
        F.col("c_name").alias("rationale"),
    )


def critiques(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("critique_id"), (F.col("s_suppkey") % 30 + 1).alias("cluster_run_id"),
        F.when(F.col("s_suppkey") % 2 == 0, "p0").otherwise("p1").alias("provider"), F.lit("m0").alias("model"),
        F.col("s_name").alias("verdict"), F.round(F.abs("s_acctbal") / 10000, 3).alias("quality_score"),
    )


def reductions(spark, sf) -> DataFrame:
    """A registry of reductions from parts."""
    kind = F.col("p_partkey") % 3
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("reduction_id"), F.col("p_brand").alias("embedding_reference"),
        F.when(kind == 0, "pca").when(kind == 1, "umap").otherwise("som").alias("method"),
        F.when(kind == 2, 2).otherwise(F.col("p_size") % 4 + 1).cast("int").alias("target_dimensions"),
        F.when(F.col("p_partkey") % 4 == 0, "{}").otherwise(F.format_string('{"grid_x": %d, "grid_y": %d}', "p_size", "p_size")).alias("params"),
        F.concat(F.lit("f"), F.col("p_size") % 7).alias("fingerprint"),
    )


def codebook(spark, sf, side: int = 4) -> DataFrame:
    """A square grid of nodes whose weights are the mean vectors of hashed item groups."""
    node = F.col("item_id") % (side * side)
    return (
        vectors(spark, sf).groupBy(node.alias("node_index")).agg(V.mean_vector(F.col("vector")).alias("weight"))
        .select(
            "node_index", F.floor(F.col("node_index") / side).cast("int").alias("grid_i"),
            (F.col("node_index") % side).cast("int").alias("grid_j"), "weight",
        )
    )


def page_files(spark, sf) -> DataFrame:
    """Pages as attached files: several items may carry one page, types follow the path."""
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".html", ".txt", ".png", ".JPG", ".tar.gz", "")]), F.col("page_id").cast("int") % 6 + 1)
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("item_id"), F.col("page_id").alias("source_row_number"),
        F.concat(F.lit("/files/p"), F.col("page_id"), suffix).alias("original_path"),
        F.encode("html", "UTF-8").alias("content"),
    )


def run_log(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("log_id"), F.concat(F.lit("run-"), F.col("user_id")).alias("run_name"),
        F.col("event_type").alias("stage"), F.lit("info").alias("level"), "ts", F.col("props").alias("payload"),
    )


def replies(spark, sf) -> DataFrame:
    """Model replies made from documents: plain, fenced, padded, cut off, or incomplete JSON."""
    good = F.to_json(F.struct(
        F.col("lang").alias("label"), F.col("source").alias("short_label"),
        F.col("text").alias("rationale"), F.array("lang", "source").alias("keywords"),
    ))
    kind = F.col("doc_id") % 6
    body = (
        F.when(kind == 0, good)
        .when(kind == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("  \n```\n"), good, F.lit("\n```  \n")))
        .when(kind == 3, F.concat(F.lit("\n  "), good, F.lit("  ")))
        .when(kind == 4, F.substr(good, F.lit(1), F.length(good) - 1))
        .otherwise(F.to_json(F.struct(F.col("lang").alias("label"))))
    )
    return table(spark, sf, "documents").select(F.col("doc_id").alias("request_id"), body.alias("raw_text"))
