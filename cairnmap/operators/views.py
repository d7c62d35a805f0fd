"""Read queries over stored runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cairnmap.functions.ranking import latest

RUN = "cluster_run_id"
JOB_LIMIT = 20
RECENT_LOG_LIMIT = 50
LOG_LIMIT = 200


def run_list(runs: DataFrame, assignments: DataFrame) -> DataFrame:
    """Every run with its cluster, item and noise counts, from one aggregation."""
    per_cluster = assignments.groupBy(RUN, "cluster_id").agg(F.count("*").alias("n"))
    counts = per_cluster.groupBy(RUN).agg(
        F.count_if(F.col("cluster_id") >= 0).alias("n_clusters"),
        F.sum("n").alias("n_items"),
        F.sum(F.when(F.col("cluster_id") < 0, F.col("n")).otherwise(0)).alias("n_noise"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return runs.join(counts, RUN, "left").select(
        *runs.columns, zero("n_clusters"), zero("n_items"), zero("n_noise"),
        F.when(F.col("n_items") > 0, F.col("n_noise") / F.col("n_items")).alias("noise_share"),
    )


def run_assignments(assignments: DataFrame, summaries: DataFrame, run_id: int) -> DataFrame:
    """Assignments of one run in (cluster, item) order with the latest label."""
    labels = latest(summaries.filter(F.col(RUN) == run_id), [RUN, "cluster_id"], "cluster_summary_id")
    return (
        assignments.filter(F.col(RUN) == run_id)
        .join(labels.select(RUN, "cluster_id", "label"), [RUN, "cluster_id"], "left")
        .orderBy("cluster_id", "item_id")
    )


def cluster_details(assignments: DataFrame, summaries: DataFrame) -> DataFrame:
    """Latest label of each cluster with its size; absent fields get empty defaults."""
    labels = latest(summaries, [RUN, "cluster_id"], "cluster_summary_id")
    sizes = assignments.groupBy(RUN, "cluster_id").agg(F.count("*").alias("size"))
    return labels.join(sizes, [RUN, "cluster_id"], "left").select(
        RUN, "cluster_id", "label", F.coalesce("size", F.lit(0).cast("long")).alias("size"),
        F.coalesce("detail.short_label", F.lit("")).alias("short_label"),
        F.coalesce("detail.rationale", F.lit("")).alias("rationale"),
        F.coalesce("detail.keywords", F.array().cast("array<string>")).alias("keywords"),
        "provider", "model",
    )


def label_fields(label_json: Column) -> list[Column]:
    """Short label, rationale and keywords of stored JSON; bad JSON or types give empty defaults."""
    parsed = F.from_json(label_json, "short_label string, rationale string, keywords array<string>")
    return [
        F.coalesce(parsed["short_label"], F.lit("")).alias("short_label"),
        F.coalesce(parsed["rationale"], F.lit("")).alias("rationale"),
        F.coalesce(parsed["keywords"], F.array().cast("array<string>")).alias("keywords"),
    ]


def latest_critique(critiques: DataFrame) -> DataFrame:
    return latest(critiques, [RUN], "critique_id")


def layout_label(method: Column, dims: Column) -> Column:
    return (
        F.when(method == "som", "SOM grid").when(method == "umap", "UMAP").when(method == "pca", "PCA")
        .otherwise(F.concat(method, F.lit(" "), dims.cast("string"), F.lit("d")))
    )


def layouts(run: DataFrame, reductions: DataFrame) -> DataFrame:
    """Layouts of one run (a single row): all 2-D reductions, or its own one when there is none.

    Default: its own if 2-D, else the first UMAP, else the first.
    """
    registry = reductions.select("reduction_id", "method", F.col("target_dimensions").alias("dims"))
    own = F.col("reduction_id") == run.select("reduction_id").scalar()
    any_flat = registry.agg(F.coalesce(F.bool_or(F.col("dims") == 2), F.lit(False))).scalar()
    shown = registry.withColumn("_own", own).withColumn("_any_flat", any_flat).filter(
        F.when(F.col("_any_flat"), F.col("dims") == 2).otherwise(F.col("_own"))
    )
    choice = F.struct(
        F.when(F.col("_own"), 0).when(F.col("method") == "umap", 1).otherwise(2).alias("preference"), "reduction_id"
    )
    default = shown.agg(F.min(choice)["reduction_id"]).scalar()
    return shown.select(
        "reduction_id", "method", "dims", layout_label(F.col("method"), F.col("dims")).alias("label"),
        (F.col("reduction_id") == default).alias("is_default"),
    )


def layout_points(rows: DataFrame, representations: DataFrame, coordinates: DataFrame, assignments: DataFrame,
                  images: DataFrame | None = None) -> DataFrame:
    """Points of a layout: first two coordinates, cluster, name, text, metadata, image.

    ``coordinates`` and ``assignments`` are those of one reduction and one run.
    """
    points = (
        assignments.select("item_id", "cluster_id")
        .join(coordinates.select("item_id", "coordinates"), "item_id")
        .join(representations.filter("representation_type = 'embedding_text'").select("item_id", "text"), "item_id")
        .join(rows.select(F.col("row_id").alias("item_id"), "row_name", "metadata"), "item_id")
    )
    if images is None:
        points = points.withColumn("image_artifact_id", F.lit(None).cast("string"))
    else:
        points = points.join(images, "item_id", "left")
    return points.select(
        "item_id", F.get("coordinates", F.lit(0)).alias("x"), F.get("coordinates", F.lit(1)).alias("y"),
        "cluster_id", F.coalesce("row_name", F.lit("")).alias("record_name"), F.col("text").alias("embedding_text"),
        "metadata", "image_artifact_id",
    )


def som_grid(reductions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Grid size and node distances of SOM reductions that record their size."""
    size = lambda name: F.get_json_object("params", f"$.{name}").cast("int")
    sized = (
        reductions.filter("method = 'som'")
        .select("reduction_id", size("grid_x").alias("grid_x"), size("grid_y").alias("grid_y"))
        .filter("grid_x is not null and grid_y is not null")
    )
    return nodes.join(sized, "reduction_id").select(
        "reduction_id", "grid_x", "grid_y", "node_index", "grid_i", "grid_j", "umatrix_dist"
    )


def som_cells(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """Every cell with its count, dominant cluster and shade; empty cells too.

    Ties between clusters go to the one with the lowest item id. A cell's rows
    are first reduced to one per cluster, so a crowded cell costs no more.
    """
    per_cluster = points.groupBy(
        F.col("x").cast("int").alias("grid_i"), F.col("y").cast("int").alias("grid_j"), "cluster_id"
    ).agg(F.count("*").alias("n"), F.min("item_id").alias("_first"))
    per_cell = per_cluster.groupBy("grid_i", "grid_j").agg(
        F.sum("n").alias("n_items"), F.min_by("cluster_id", F.struct(-F.col("n"), "_first")).alias("dominant_cluster")
    )
    filled = nodes.select("node_index", "grid_i", "grid_j", "umatrix_dist").join(
        per_cell, ["grid_i", "grid_j"], "left"
    ).withColumn("n_items", F.coalesce("n_items", F.lit(0).cast("long")))
    shade = 0.35 + 0.65 * (F.col("n_items") / per_cell.agg(F.max("n_items")).scalar())
    return filled.select(
        "node_index", "grid_i", "grid_j", "umatrix_dist", "n_items", "dominant_cluster",
        F.when(F.col("n_items") > 0, shade).alias("intensity"),
    )


def item_detail(rows: DataFrame, representations: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Name, metadata, text and first image per item."""
    texts = representations.filter("representation_type = 'embedding_text'").select("item_id", "text")
    detail = rows.withColumnRenamed("row_id", "item_id").join(texts, "item_id")
    detail = detail.join(images, "item_id", "left") if images is not None else detail.withColumn(
        "image_artifact_id", F.lit(None).cast("string")
    )
    return detail.select(
        "item_id", F.coalesce("row_name", F.lit("")).alias("record_name"), "metadata",
        F.col("text").alias("embedding_text"), "image_artifact_id",
    )


def by_id(df: DataFrame, column: str, value: int) -> DataFrame:
    """The row with an id; raises when there is none."""
    found = df.filter(F.col(column) == value)
    if found.isEmpty():
        raise LookupError(f"{column} {value} not found")
    return found


def search_match(query: str, filters: dict[str, str], name: Column, text: Column, metadata: Column) -> Column:
    """Whether an item has all words of the query and all metadata substrings; case is ignored."""
    haystack = F.lower(F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))
    tests = [haystack.contains(word) for word in query.lower().split()]
    for key, value in filters.items():
        if key and value.strip():
            field = F.lower(F.coalesce(F.try_element_at(metadata, F.lit(key)), F.lit("")))
            tests.append(field.contains(value.strip().lower()))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def visibility(matches: Column, cluster_id: Column, focus: int | None = None, mode: str = "fade") -> Column:
    """full, faded or hidden from the search match and the focused cluster."""
    shown = matches if focus is None else matches & (cluster_id == focus)
    return F.when(shown, "full").otherwise("hidden" if mode == "hide" else "faded")


def facet_keys(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(F.map_keys("metadata")).alias("key")).distinct()


def facet_values(rows: DataFrame) -> DataFrame:
    """Distinct non-empty values per metadata key with their counts."""
    return (
        rows.select(F.explode("metadata").alias("key", "value"))
        .filter(F.coalesce("value", F.lit("")) != "")
        .groupBy("key", "value").agg(F.count("*").alias("n_items"))
    )


def plot_bounds(points: DataFrame) -> DataFrame:
    """Extent of the points with a margin of 5 %; a zero span counts as 1, no points give 0..1."""
    span = points.agg(*[f("x").alias(f"{n}_x") for n, f in (("min", F.min), ("max", F.max))],
                      *[f("y").alias(f"{n}_y") for n, f in (("min", F.min), ("max", F.max))])

    def edge(axis: str, end: str) -> Column:
        low, high = F.col(f"min_{axis}"), F.col(f"max_{axis}")
        margin = F.when(high == low, 1.0).otherwise(high - low) * 0.05
        value = low - margin if end == "min" else high + margin
        return F.coalesce(value, F.lit(0.0 if end == "min" else 1.0)).alias(f"{end}_{axis}")

    return span.select(edge("x", "min"), edge("x", "max"), edge("y", "min"), edge("y", "max"))


def clusters_named(details: DataFrame, search: str) -> DataFrame:
    """Clusters whose label contains the text; blank text keeps all."""
    wanted = search.strip().lower()
    return details if not wanted else details.filter(F.lower("label").contains(wanted))


def recent(log: DataFrame, order: str, limit: int) -> DataFrame:
    """The newest entries; a top-k, so only ``limit`` rows per task travel."""
    return log.orderBy(F.col(order).desc()).limit(limit)


def log_of(log: DataFrame, run_name: str, limit: int = LOG_LIMIT) -> DataFrame:
    return log.filter(F.col("run_name") == run_name).orderBy("log_id").limit(limit)
