"""How many tasks a step gets."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Above this a scan has enough splits of its own.
SMALL_BYTES = 1 << 30


def widen(df: DataFrame) -> DataFrame:
    """Spread a small input over all cores before costly per-row work.

    A small file is read by one task. Only the optimizer's size estimate is
    looked at, nothing is run, and larger inputs are left as they are.
    """
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(estimate)) > SMALL_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
