"""Labels of clusters: offline keywords, stored versions, reconciled versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairnmap.functions.partitions import widen
from cairnmap.functions.ranking import latest, top_per_group
from cairnmap.operators.metrics import cluster_sizes

CLUSTER = ["cluster_run_id", "cluster_id"]
AUTHOR = ["provider", "model"]
_DETAIL = (
    "struct<label:string,short_label:string,rationale:string,keywords:array<string>,"
    "reconciled:boolean,reconcile_rationale:string,"
    "original:struct<label:string,short_label:string,rationale:string,keywords:array<string>>>"
)
_PLAIN = "struct<label:string,short_label:string,rationale:string,keywords:array<string>>"
_TIE_DECIMALS = 9

OFFLINE = ("offline", "class-tfidf")


def latest_labels(summaries: DataFrame) -> DataFrame:
    """The newest label version of every cluster."""
    return latest(summaries, CLUSTER, "cluster_summary_id")


def words(text: Column, min_length: int = 3) -> Column:
    """Lower-case runs of letters and digits of at least ``min_length`` characters."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(found, lambda w: F.length(w) >= min_length)


def cluster_keywords(assignments: DataFrame, texts: DataFrame, k: int = 5) -> DataFrame:
    """Top words per cluster by class-based TF-IDF (Grootendorst 2022).

    score = share of the word in the cluster * ln(1 + mean words per cluster / count of the word).
    """
    terms = (
        assignments.filter("cluster_id >= 0")
        .join(widen(texts.select("item_id", "text")), "item_id")
        .select(*CLUSTER, F.explode(words(F.col("text"))).alias("term"))
        .groupBy(*CLUSTER, "term")
        .agg(F.count("*").alias("n"))
    )
    # One row per cluster, so the mean over a run's clusters is a small window.
    per_cluster = terms.groupBy(*CLUSTER).agg(F.sum("n").alias("cluster_words")).withColumn(
        "mean_words", F.avg("cluster_words").over(Window.partitionBy("cluster_run_id"))
    )
    per_term = terms.groupBy("cluster_run_id", "term").agg(F.sum("n").alias("term_words"))
    scored = (
        terms.join(per_term, ["cluster_run_id", "term"])
        .join(per_cluster, CLUSTER)
        .select(
            *CLUSTER, "term",
            (F.col("n") / F.col("cluster_words") * F.log1p(F.col("mean_words") / F.col("term_words"))).alias("score"),
        )
    )
    return top_per_group(scored, CLUSTER, [F.round("score", _TIE_DECIMALS).desc(), F.col("term")], k)


def offline_labels(keywords: DataFrame) -> DataFrame:
    """A label record per cluster made from its keywords, for use without a model."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda e: e["term"])
    return keywords.groupBy(*CLUSTER).agg(ordered.alias("keywords")).select(
        *CLUSTER,
        F.array_join(F.slice("keywords", 1, 3), " ").alias("label"),
        F.element_at("keywords", 1).alias("short_label"),
        F.concat(F.lit("Most distinctive words: "), F.array_join("keywords", ", ")).alias("rationale"),
        "keywords",
    )


def pending_labels(clusters: DataFrame, summaries: DataFrame, provider: str, model: str) -> DataFrame:
    """Clusters this provider and model has not labelled yet."""
    done = summaries.filter((F.col("provider") == provider) & (F.col("model") == model))
    return clusters.join(done.select(*CLUSTER), CLUSTER, "left_anti")


def label_versions(labels: DataFrame, provider: str, model: str) -> DataFrame:
    """Summary rows (without id) for new labels with columns label, short_label, rationale, keywords."""
    return labels.select(
        *CLUSTER, F.lit(provider).alias("provider"), F.lit(model).alias("model"), "label",
        F.struct(
            "label", "short_label", "rationale", "keywords",
            F.lit(False).alias("reconciled"), F.lit(None).cast("string").alias("reconcile_rationale"),
            F.lit(None).cast(_PLAIN).alias("original"),
        ).cast(_DETAIL).alias("detail"),
    )


def label_info(assignments: DataFrame, summaries: DataFrame) -> DataFrame:
    """Latest label with the cluster's size (0 when nothing is assigned), noise left out."""
    return (
        latest_labels(summaries.filter("cluster_id >= 0"))
        .join(cluster_sizes(assignments), CLUSTER, "left")
        .withColumn("size", F.coalesce("size", F.lit(0).cast("long")))
    )


def reconcilable_runs(summaries: DataFrame) -> DataFrame:
    """Runs with two or more labelled clusters of which none was reconciled."""
    return (
        summaries.groupBy("cluster_run_id")
        .agg(
            F.coalesce(F.bool_or("detail.reconciled"), F.lit(False)).alias("_done"),
            F.count_distinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("n_clusters"),
        )
        .filter(~F.col("_done") & (F.col("n_clusters") >= 2))
        .drop("_done")
    )


def reconcile(current: DataFrame, revised: DataFrame) -> DataFrame:
    """New label versions: revised where the reply names the cluster, else kept as "unchanged".

    ``revised`` has pos, label, short_label, keywords and reconcile_rationale per
    cluster; the last entry for a cluster counts. The rationale stays and the
    former label is kept under ``original``.
    """
    last = latest(revised, CLUSTER, "pos").select(
        *CLUSTER, F.struct("label", "short_label", "keywords", "reconcile_rationale").alias("_new")
    )
    empty = F.array().cast("array<string>")
    old = lambda name, default: F.coalesce(F.col(f"detail.{name}"), default)
    pick = lambda name, default: F.when(F.col("_new").isNotNull(), F.col(f"_new.{name}")).otherwise(
        old(name, default)
    )
    label = pick("label", F.lit(""))
    return current.join(last, CLUSTER, "left").select(
        *CLUSTER, *AUTHOR, label.alias("label"),
        F.struct(
            label.alias("label"),
            pick("short_label", F.lit("")).alias("short_label"),
            old("rationale", F.lit("")).alias("rationale"),
            pick("keywords", empty).alias("keywords"),
            F.lit(True).alias("reconciled"),
            F.when(F.col("_new").isNotNull(), F.col("_new.reconcile_rationale"))
            .otherwise(F.lit("unchanged")).alias("reconcile_rationale"),
            F.struct("detail.label", "detail.short_label", "detail.rationale", "detail.keywords").alias("original"),
        ).cast(_DETAIL).alias("detail"),
    )


def pending_critiques(runs: DataFrame, critiques: DataFrame, provider: str, model: str) -> DataFrame:
    done = critiques.filter((F.col("provider") == provider) & (F.col("model") == model))
    return runs.join(done.select("cluster_run_id"), "cluster_run_id", "left_anti")
