"""Session settings and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "cairnmap", **conf) -> SparkSession:
    """A session with adaptive execution on and UTC timestamps.

    On a cluster ``master`` and the sizes come from spark-submit; nothing here
    overrides what the cluster already set.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Point reliable checkpoints at the shared folder the cluster names.

    Only a local master may fall back to a temporary folder: executors of a
    cluster do not see each other's disks.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="cairnmap-checkpoint-")
    context.setCheckpointDir(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative result; survives the loss of executors."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of any session.

    For sessions started without ``--py-files``; done once per application.
    """
    context = spark.sparkContext
    if getattr(context, "_cairnmap_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="cairnmap-package-")) / "cairnmap.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._cairnmap_shipped = True


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared checkpoint folder."""
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str = "step") -> DataFrame:
    """``df`` as a table in the shared folder: its lineage is cut, and later plans know its size.

    Unlike after a checkpoint, the optimizer starts from the files alone, so plans of iterative steps stay small.
    """
    folder = scratch_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    table = df.sparkSession.read.schema(df.schema).parquet(folder)
    table._written_to = folder
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` returned; only for those that no later plan reads, not even after the loss of an executor."""
    for table in tables:
        context = table.sparkSession.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(table._written_to)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
