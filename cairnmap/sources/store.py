"""Parquet tables under one folder; rows are only ever added."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from cairnmap import schema

TABLES = {
    "rows": schema.ROWS,
    "artifacts": schema.ARTIFACTS,
    "item_artifacts": schema.ITEM_ARTIFACTS,
    "representations": schema.REPRESENTATIONS,
    "embeddings": schema.EMBEDDINGS,
    "reductions": schema.REDUCTIONS,
    "coordinates": schema.COORDINATES,
    "som_nodes": schema.SOM_NODES,
    "cluster_runs": schema.CLUSTER_RUNS,
    "assignments": schema.ASSIGNMENTS,
    "exemplars": schema.EXEMPLARS,
    "summaries": schema.SUMMARIES,
    "critiques": schema.CRITIQUES,
    "model_calls": schema.MODEL_CALLS,
    "run_log": schema.RUN_LOG,
}

# A run or reduction is read alone, so its rows lie in their own folder.
PARTITIONS = {
    "coordinates": ["reduction_id"],
    "som_nodes": ["reduction_id"],
    "assignments": ["cluster_run_id"],
    "exemplars": ["cluster_run_id"],
}


class Store:
    """Named tables of one project."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def read(self, table: str) -> DataFrame:
        try:
            # A known schema spares the inference job and keeps partition columns long.
            return self.spark.read.schema(TABLES[table]).parquet(self.path(table))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], TABLES[table])

    def append(self, table: str, df: DataFrame) -> None:
        names = self.spark.createDataFrame([], TABLES[table]).schema
        aligned = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in names])
        writer = aligned.write.mode("append")
        if table in PARTITIONS:
            writer = writer.partitionBy(*PARTITIONS[table])
        writer.parquet(self.path(table))

    def next_id(self, table: str, column: str) -> int:
        """One above the highest id; parquet answers this from column statistics."""
        highest = self.read(table).agg(F.max(column)).first()[0]
        return 1 if highest is None else int(highest) + 1

    def unused_id(self, column: str, registry: str, *tables: str) -> int:
        """One above the highest id of a registry and of the tables whose rows bear it.

        Those rows are written before their registry row, so a job that dies in between leaves rows that no registry
        row names; their number is never given out again.
        """
        return max(self.next_id(t, column) for t in (registry, *tables))
