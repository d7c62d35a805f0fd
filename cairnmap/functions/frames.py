"""Small driver-side results to DataFrames."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def from_pandas(spark: SparkSession, frame: pd.DataFrame, schema: str) -> DataFrame:
    """Through Arrow whatever the session's settings, so array columns keep working."""
    return spark.createDataFrame(pa.Table.from_pandas(frame, preserve_index=False), schema)
