"""Seeded stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cairnmap import SEED
from cairnmap.functions.ranking import top_per_group


def seeded_key(id_col: Column, seed: int = SEED) -> Column:
    """A pseudo-random sort key that any engine can recompute."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), id_col.cast("string")))


def stratified_sample(df: DataFrame, stratum: str, id_col: str, k: int = 50, seed: int = SEED) -> DataFrame:
    """At most ``k`` rows per stratum, the same ones for the same seed."""
    keyed = df.withColumn("_key", seeded_key(F.col(id_col), seed))
    return top_per_group(keyed, [stratum], [F.col("_key"), F.col(id_col)], k).drop("_key")


def strata_counts(df: DataFrame, stratum: str) -> DataFrame:
    return df.groupBy(stratum).agg(F.count("*").alias("n"))


_SLOTS = 1_000_003


def seeded_pick(df: DataFrame, n: int, k: int, id_col: str = "item_id", seed: int = SEED) -> DataFrame:
    """About ``k`` of ``n`` rows, never more, the same ones for the same seed.

    A hash filter first leaves a small multiple of ``k`` over the whole table,
    so the ordered pick never gathers ``k`` rows from every task.
    """
    slot = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(_SLOTS))
    share = min(1.0, (4.0 * k + 64) / max(n, 1))
    return df.filter(slot <= int(share * _SLOTS)).orderBy(slot, id_col).limit(k)
