"""Derived runs: fold clusters of a labelled run together without touching it.

Decisions come as rows ``(cluster_run_id, group_no, pos, cluster_id, rationale)``:
one row per cluster id a reply put into a group, in reply order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cairnmap.functions.ranking import latest, rank_by_id
from cairnmap.operators.metrics import cluster_sizes

# A merge never leaves fewer clusters than this.
MIN_RESULTING_CLUSTERS = 2

RUN = "cluster_run_id"


def gather_clusters(assignments: DataFrame, summaries: DataFrame) -> DataFrame:
    """Size and latest label of each labelled non-noise cluster."""
    labels = latest(summaries, [RUN, "cluster_id"], "cluster_summary_id")
    return cluster_sizes(assignments).join(labels, [RUN, "cluster_id"]).select(
        RUN, "cluster_id", "size", "label",
        F.coalesce("detail.rationale", F.lit("")).alias("rationale"),
        F.coalesce("detail.keywords", F.array().cast("array<string>")).alias("keywords"),
    )


def first_use(decisions: DataFrame, valid: DataFrame) -> DataFrame:
    """Known ids only, each in the first group that names it.

    An id is used up by that group even when the group is dropped later.
    """
    known = decisions.join(valid.select(RUN, "cluster_id"), [RUN, "cluster_id"], "left_semi")
    return known.groupBy(RUN, "cluster_id").agg(
        F.min_by(F.struct("group_no", "rationale"), F.struct("group_no", "pos")).alias("_first")
    ).select(RUN, "cluster_id", "_first.group_no", "_first.rationale")


def sanitize(decisions: DataFrame, valid: DataFrame) -> DataFrame:
    """Groups of two or more ids after the id rules, before the floor."""
    return (
        first_use(decisions, valid)
        .groupBy(RUN, "group_no")
        .agg(
            F.array_sort(F.collect_list("cluster_id")).alias("cluster_ids"),
            F.max("rationale").alias("rationale"),
        )
        .filter(F.size("cluster_ids") >= 2)
    )


def apply_floor(groups: DataFrame, valid: DataFrame, minimum: int = MIN_RESULTING_CLUSTERS) -> DataFrame:
    """Drop groups, largest first, until ``minimum`` clusters would remain.

    Groups of one size form a class. Each class keeps as many of its last groups
    as the clusters left by the smaller classes allow; that is a sum over the
    few distinct sizes instead of a running sum over all groups.
    """
    sized = groups.withColumn("_shrink", F.size("cluster_ids").cast("long") - 1)
    totals = valid.groupBy(RUN).agg(F.count_distinct("cluster_id").alias("_n"))
    smaller = Window.partitionBy(RUN).orderBy("_shrink").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("_n") - F.lit(minimum) - F.col("_below")
    classes = (
        sized.groupBy(RUN, "_shrink").agg(F.count("*").alias("_groups"))
        .withColumn("_below", F.coalesce(F.sum(F.col("_shrink") * F.col("_groups")).over(smaller), F.lit(0)))
        .join(totals, RUN)
        .select(
            RUN, "_shrink", "_groups",
            F.greatest(F.lit(0), F.least(F.col("_groups"), F.floor(room / F.col("_shrink")))).alias("_keep"),
        )
    )
    ranked = rank_by_id(sized, "group_no", [RUN, "_shrink"], "_position")
    return (
        ranked.join(classes, [RUN, "_shrink"])
        .filter(F.col("_position") > F.col("_groups") - F.col("_keep"))
        .select(*groups.columns)
    )


def id_map(valid: DataFrame, groups: DataFrame) -> DataFrame:
    """Old id to new id: groups collapse to their smallest member, ids stay contiguous."""
    anchors = groups.select(
        RUN, F.explode("cluster_ids").alias("cluster_id"), F.element_at("cluster_ids", 1).alias("_anchor")
    )
    rooted = (
        valid.select(RUN, "cluster_id").distinct()
        .join(anchors, [RUN, "cluster_id"], "left")
        .withColumn("_anchor", F.coalesce("_anchor", "cluster_id"))
    )
    # Every anchor maps to itself, so the anchors are the rows where both agree.
    new_ids = rank_by_id(
        rooted.filter(F.col("cluster_id") == F.col("_anchor")).select(RUN, "_anchor"), "_anchor", [RUN], "_rank"
    )
    return rooted.join(new_ids, [RUN, "_anchor"]).select(
        RUN, "cluster_id", (F.col("_rank") - 1).alias("new_cluster_id")
    )


def rewrite_assignments(assignments: DataFrame, ids: DataFrame, new_run_id=None) -> DataFrame:
    """Assignments of the derived run; noise stays noise, probabilities are kept."""
    moved = assignments.join(ids, [RUN, "cluster_id"], "left").select(
        (F.col(RUN) if new_run_id is None else F.lit(new_run_id).cast("long")).alias(RUN),
        "item_id",
        F.when(F.col("cluster_id") < 0, F.lit(-1)).otherwise(F.col("new_cluster_id")).alias("cluster_id"),
        "membership_probability",
    )
    return moved


def merge_log(groups: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per applied group: its new id, sorted sources and rationale."""
    return (
        groups.withColumn("cluster_id", F.element_at("cluster_ids", 1))
        .join(ids, [RUN, "cluster_id"])
        .select(
            F.col(RUN).alias("parent_cluster_run_id"), "new_cluster_id",
            F.col("cluster_ids").alias("source_cluster_ids"), "rationale",
        )
    )


def valid_clusters(assignments: DataFrame) -> DataFrame:
    """All non-noise clusters; one without a label keeps its own unmerged id."""
    return assignments.filter("cluster_id >= 0").select(RUN, "cluster_id").distinct()


def merged_child(runs: DataFrame, parent: int, provider: str, model: str) -> DataFrame:
    """Newest merged run of a parent by one provider and model (no row if none)."""
    field = lambda name: F.get_json_object("params", f"$.{name}")
    return runs.filter(
        (F.col("method") == "merged")
        & (field("parent_cluster_run_id").cast("long") == parent)
        & (field("provider") == provider)
        & (field("model") == model)
    ).agg(F.max(RUN).alias(RUN)).filter(F.col(RUN).isNotNull())
