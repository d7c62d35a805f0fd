"""Centre and outskirt exemplars of each cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cairnmap.functions import vectors as V
from cairnmap.functions.ranking import top_per_group

N_CANDIDATES = 20
TOP_K = 3
OUTSKIRTS_K = 2

# Similarities closer than this many decimals are ties and go to the lower item id,
# so the picks do not depend on how the rows were partitioned.
_TIE_DECIMALS = 9
_NORM_EPSILON = 1e-10

# A cluster's members meet its direction in this many tasks, so one cluster can be most of the data.
_SALTS = 64

CLUSTER = ["cluster_run_id", "cluster_id"]


def members(assignments: DataFrame, vectors: DataFrame) -> DataFrame:
    """Non-noise assignments with the vector of each item."""
    return assignments.filter("cluster_id >= 0").select(*CLUSTER, "item_id").join(
        vectors.select("item_id", "vector"), "item_id"
    )


def _unit(vector):
    return V.l2_normalize(vector, 0.0, _NORM_EPSILON)


def centroids(member_vectors: DataFrame) -> DataFrame:
    """Per cluster: size, mean vector, and mean of the members' unit vectors."""
    return member_vectors.groupBy(*CLUSTER).agg(
        F.count("*").alias("size"),
        V.mean_vector(F.col("vector")).alias("centroid"),
        V.mean_vector(_unit(F.col("vector"))).alias("mean_direction"),
    )


def similarities(member_vectors: DataFrame) -> DataFrame:
    """Cosine of each member to its centroid, and its mean cosine to all members.

    The mean cosine is the dot product with the mean unit vector, so it needs
    no pairs: cost grows linearly with the cluster.
    """
    direction = centroids(member_vectors).select(
        *CLUSTER, _unit(F.col("centroid")).alias("_centroid"), F.col("mean_direction").alias("_mean"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))).alias("_salt"),
    )
    unit = F.col("_unit")
    return (
        member_vectors.withColumn("_unit", _unit(F.col("vector")))
        .withColumn("_salt", F.pmod(F.xxhash64("item_id"), F.lit(_SALTS)))
        .join(direction, [*CLUSTER, "_salt"])
        .select(
            *CLUSTER,
            "item_id",
            V.dot(unit, F.col("_centroid")).alias("centroid_similarity"),
            V.dot(unit, F.col("_mean")).alias("mean_similarity"),
        )
    )


def select_exemplars(
    assignments: DataFrame,
    vectors: DataFrame,
    n_candidates: int = N_CANDIDATES,
    top_k: int = TOP_K,
    outskirts_k: int = OUTSKIRTS_K,
) -> DataFrame:
    """Exemplars of every cluster of every run given.

    Centre: of the candidates nearest to the centroid, those with the highest
    mean similarity to all members. Outskirt: lowest centroid similarity among
    the members that are not centre picks.
    """
    scored = similarities(members(assignments, vectors))
    # The centre picks can take at most top_k of the lowest rows, so this many suffice.
    n_lowest = outskirts_k + top_k
    # Both ends of each cluster in one pass: every row competes once from each side.
    similarity = F.round("centroid_similarity", _TIE_DECIMALS)
    sides = F.explode(F.array(
        F.struct(F.lit("near").alias("side"), (-similarity).alias("key")), F.struct(F.lit("far").alias("side"), similarity.alias("key"))
    ))
    ends = top_per_group(
        scored.withColumn("_end", sides).select("*", "_end.side", "_end.key").drop("_end"),
        [*CLUSTER, "side"], [F.col("key"), F.col("item_id")], max(n_candidates, n_lowest), "_place",
    )
    candidates = ends.filter((F.col("side") == "near") & (F.col("_place") <= n_candidates))
    centre = top_per_group(
        candidates, CLUSTER, [F.round("mean_similarity", _TIE_DECIMALS).desc(), F.col("_place")], top_k
    ).select(*CLUSTER, "item_id", F.lit("center").alias("kind"), "rank", F.col("mean_similarity").alias("score"))
    lowest = ends.filter((F.col("side") == "far") & (F.col("_place") <= n_lowest))
    outskirt = top_per_group(
        lowest.join(centre, [*CLUSTER, "item_id"], "left_anti"), CLUSTER, [F.col("_place")], outskirts_k
    ).select(
        *CLUSTER, "item_id", F.lit("outskirt").alias("kind"), "rank", F.col("centroid_similarity").alias("score")
    )
    return centre.unionByName(outskirt)


def missing_runs(assignments: DataFrame, exemplars: DataFrame) -> DataFrame:
    """Assignments of the runs that have no exemplars yet."""
    return assignments.join(exemplars.select("cluster_run_id").distinct(), "cluster_run_id", "left_anti")
