"""Mixing sources to target weights along a curriculum, in DataFrame functions only.

Each source has a weight schedule over training time 0..1. The integral of the schedule says which share
of the source's words has been asked for by a time; inverting it gives every word offset of the source
its time. A source is read in a fixed pseudo-random order, as often as its target asks for, and each
copy of a document is placed at the time its middle word is asked for. Offsets are prefix sums in two
levels (hash buckets, then rows), so a hot source is spread over all buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairnmap.session import written

WORD = r"[^\x20\x09-\x0D]+"
# Weights by the rank of a source, repeating, and the most often a source is read.
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
# Hex digits of the order key that name a bucket: 4,096 buckets per source.
BUCKET_DIGITS = 3
# Weight over time as (time, weight) knots, by the rank of a source, repeating: late, even and early sources.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, source: str, size: str, weights: Sequence[int] = WEIGHTS,
                   epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_rank, source_size, target) from rows of (source, size).

    Targets share all words by weight; no target exceeds ``epochs`` times its source, the excess going to
    the others by weight. Such a sharing fills every source up to level * weight or its cap, so sources
    in the order of cap / weight are capped up to some point: prefix sums over the sources find it.
    One row per source is ranked in one place (the pre-aggregated table, not the documents).
    """
    totals = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    ranked = totals.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    caps = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * epochs)
    up = Window.orderBy(F.col("_cap") / F.col("_w"), "source_rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(up), F.lit(0))) / (
        F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(up), F.lit(0)))
    levels = caps.withColumn("_level", level)
    # the level at the first source that stays below its cap holds for all the later ones
    final = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), "source_rank", "_level"))).over(everything)
    return levels.withColumn("_final", final["_level"]).select(
        "source", "source_rank", "source_size",
        F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_final") * F.col("_w"), F.col("_cap").cast("double"))).alias("target"))


def order_key(doc_id: Column) -> Column:
    """Fixed pseudo-random reading order."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def _segments(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float, float]]:
    """(share before, share after, start, length, weight at start, weight at end), shares being normalised integrals."""
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    total, done, out = sum(area), 0.0, []
    if total <= 0 or any(w < 0 for _, w in knots):
        raise ValueError("a schedule needs weights of at least 0 and some weight")
    for part, a, b in zip(area, knots, knots[1:]):
        if part > 0:
            out.append((done / total, (done + part) / total, a[0], b[0] - a[0], a[1], b[1]))
        done += part
    return out


def time_of(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time by which the integral of a piecewise linear schedule reaches ``share``."""
    out = F.lit(float(knots[-1][0]))
    for low, high, start, length, left, right in reversed(_segments(knots)):
        part = F.least(F.greatest((share - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * ((left + right) / 2)
        # left * x + (right - left) * x^2 / 2 = part, solved without cancellation
        root = F.sqrt(F.greatest(F.lit(left * left) + 2 * (right - left) * part, F.lit(0.0)))
        x = F.when(part <= 0, 0.0).otherwise(2 * part / (left + root))
        out = F.when(share <= high, start + length * x).otherwise(out)
    return out


def plan_mix(docs: DataFrame, size: str, source: str = "source", doc_id: str = "doc_id",
             weights: Sequence[int] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``_rank``, ``_source_size``, ``_target``, ``_from`` (word offset in one pass over the source) and ``_copies``.

    Copy c (from 0) of a row is taken when its middle word, c * source_size + _from + size / 2, lies below
    the target: whole documents only, so a source's taken words miss its target by half a document at
    most, and never more than ``epochs`` copies. Rows without words are taken ceil(target / source_size)
    times at most by the same rule; they add no words. Equal rows are interchangeable, so repeated rows
    and ties in the order key leave the result the same.
    """
    keyed = docs.withColumn("_key", order_key(F.col(doc_id))).withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
    per_bucket = written(keyed.groupBy(F.col(source).alias("source"), "_bucket").agg(F.sum(size).alias("_words")))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("source", F.col("_bucket").alias("_b"), F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_offset"))
    targets = source_targets(per_bucket, "source", "_words", weights, epochs)
    starts = offsets.join(targets, offsets["source"].eqNullSafe(targets["source"])).select(
        offsets["source"].alias("_source"), "_b", "_offset", F.col("source_rank").alias("_rank"),
        F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    inside = Window.partitionBy(source, "_bucket").orderBy("_key", doc_id, size).rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    joined = placed.join(starts, placed[source].eqNullSafe(starts["_source"]) & (F.col("_bucket") == F.col("_b")))
    middle = F.col("_offset") + F.col("_inside") + F.col(size) / 2
    copies = sum((F.when((c * F.col("_source_size") + middle) < F.col("_target"), 1).otherwise(0) for c in range(epochs)), F.lit(0))
    return joined.select(*[placed[c] for c in docs.columns], "_rank", "_source_size", "_target",
                         (F.col("_offset") + F.col("_inside")).alias("_from"), copies.alias("_copies"))


def _position(copy: Column, schedules) -> Column:
    """The training time of a planned row's copy: when its source's schedule has asked for the words up to its middle."""
    share = (copy * F.col("_source_size") + F.col("_from") + F.col("_size") / 2) / F.col("_target")
    position = F.lit(None).cast("double")
    for i, knots in enumerate(schedules):
        position = F.when(F.col("_rank") % len(schedules) == i, time_of(share, knots)).otherwise(position)
    return position


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
                weights: Sequence[int] = WEIGHTS, epochs: int = MAX_EPOCHS, schedules=SCHEDULES) -> DataFrame:
    """The training order: a row per taken copy with all columns of ``docs``, ``copy`` and ``position`` (0..1), range-sorted.

    A null source is a source of its own, ranked last; null texts have no words. If no row has a word
    every target is 0 and nothing is taken. An empty table gives an empty table. Columns of ``docs`` with
    the names ``copy`` and ``position`` are replaced.
    """
    rest = [c for c in docs.columns if c not in ("copy", "position")]
    planned = plan_mix(docs.select(*rest, word_count(F.col(text)).alias("_size")), "_size", source, doc_id, weights, epochs)
    taken = planned.filter("_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    placed = taken.select(*rest, "copy", _position(F.col("copy"), schedules).alias("position"))
    return placed.repartitionByRange("position", doc_id).sortWithinPartitions("position", doc_id, "copy")


def mix_report(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
               weights: Sequence[int] = WEIGHTS, epochs: int = MAX_EPOCHS, schedules=SCHEDULES) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken (words, repeats counted; see ``plan_mix``), copies and position.

    ``position`` is the training time of the first copy, null for rows that are not taken.
    """
    sized = written(docs.select(doc_id, source, word_count(F.col(text)).alias("_size")))
    planned = plan_mix(sized, "_size", source, doc_id, weights, epochs)
    return planned.select(F.col(doc_id).alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                          F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"), F.col("_copies").cast("long").alias("copies"),
                          F.when(F.col("_copies") > 0, F.round(_position(F.lit(0), schedules), 9)).alias("position"))


def _time_sql(share: str, knots: Sequence[tuple[float, float]]) -> str:
    """``time_of`` in SQL."""
    out = str(float(knots[-1][0]))
    for low, high, start, length, left, right in reversed(_segments(knots)):
        part = f"(least(greatest(({share} - {low!r}::DOUBLE) / {high - low!r}::DOUBLE, 0), 1) * {(left + right) / 2!r}::DOUBLE)"
        x = f"(CASE WHEN {part} <= 0 THEN 0 ELSE 2 * {part} / ({left!r}::DOUBLE + sqrt(greatest({left * left!r}::DOUBLE + {2 * (right - left)!r}::DOUBLE * {part}, 0))) END)"
        out = f"CASE WHEN {share} <= {high!r}::DOUBLE THEN {start!r}::DOUBLE + {length!r}::DOUBLE * {x} ELSE {out} END"
    return out


_TIMES = " ".join(f"WHEN {i} THEN {_time_sql('(mid / target)', knots)}" for i, knots in enumerate(SCHEDULES))

ORACLE = f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
        md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
    s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY 1),
    c AS (SELECT *, r % 3 + 1 AS w, 3 * source_size AS cap FROM s),
    l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER up, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER up, 0)) AS lev
        FROM c WINDOW up AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    f AS (SELECT lev AS level FROM l WHERE lev * w <= cap ORDER BY cap / w, r LIMIT 1),
    t AS (SELECT source, source_size, r, least(CAST(cap AS DOUBLE), coalesce((SELECT level FROM f) * w, cap)) AS target FROM l),
    p AS (SELECT d.*, source_size, target, t.r, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 AS mid
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(size * n AS BIGINT) AS taken, CAST(n AS BIGINT) AS copies,
        CASE WHEN n > 0 THEN round(CASE r % {len(SCHEDULES)} {_TIMES} END, 9) END AS position
    FROM (SELECT *, (mid < target)::INT + (mid + source_size < target)::INT + (mid + 2 * source_size < target)::INT AS n FROM p)"""
