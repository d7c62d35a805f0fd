"""Principal components with explicit centring and a fixed sign."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from cairnmap import SEED
from cairnmap.functions import vectors as V
from cairnmap.operators.neighbours import matrix

TARGET_DIMENSIONS = 50
# Up to this width the covariance matrix, which is square in it, lives on the driver; beyond, only a few columns of it.
MAX_WIDTH = 8192
# Columns of the wide search besides those asked for, passes at most, and the relative change of the explained variance that ends it.
EXTRA, PASSES, TOLERANCE = 10, 60, 1e-10


@dataclass(frozen=True)
class Components:
    mean: np.ndarray
    axes: np.ndarray
    explained: np.ndarray

    @property
    def width(self) -> int:
        return self.axes.shape[1]


def _signed(axes: np.ndarray) -> np.ndarray:
    """The largest loading of every component is made positive, so a refit gives the same signs."""
    return axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)


def fit_pca(vectors: DataFrame, target: int = TARGET_DIMENSIONS, max_width: int = MAX_WIDTH) -> Components:
    """Components of the vectors; the target is capped by rows and width.

    Up to ``max_width`` columns only d and d x d figures reach the driver; beyond, d figures for each component searched for, found by ``fit_wide``.
    """
    data = vectors.select(array_to_vector(V.as_doubles(F.col("vector"))).alias("features"))
    summary = data.agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("features")).alias("s")).select("s.*").first()
    n, mean = int(summary["count"]), summary["mean"].toArray()
    k = min(target, n, len(mean))
    if n < 2:
        return Components(mean, np.zeros((len(mean), k)), np.zeros(k))
    if len(mean) > max_width:
        return fit_wide(vectors, n, mean, float(summary["variance"].toArray().sum()), k)
    model = PCA(k=k, inputCol="features", outputCol="components").fit(data)
    return Components(mean, _signed(model.pc.toArray()), model.explainedVariance.toArray())


def fit_wide(vectors: DataFrame, n: int, mean: np.ndarray, total: float, k: int, extra: int = EXTRA, passes: int = PASSES,
             tolerance: float = TOLERANCE, seed: int = SEED) -> Components:
    """The k leading components by block iteration: no matrix is square in the width, and no row leaves its task.

    From seeded random columns, every pass multiplies the covariance with an orthonormal block of k + ``extra`` columns: a task adds up
    x (x' W) over its rows, Spark adds up the tasks' columns, and the driver makes the block orthonormal again. It ends when
    the variance that the first k columns explain stands still.
    """
    width = len(mean)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, min(width, k + extra))))[0]
    doubles, context = vectors.select(V.as_doubles(F.col("vector")).alias("vector")), vectors.sparkSession.sparkContext
    before = -1.0
    for _ in range(passes):
        shared = context.broadcast((mean, block))
        columns = doubles.mapInPandas(_products(shared), "number int, x array<double>").groupBy("number").agg(
            Summarizer.sum(array_to_vector("x")).alias("x")).collect()
        product = np.zeros_like(block)
        for row in columns:  # one per column of the block
            product[:, row["number"]] = row["x"].toArray()
        product /= n - 1
        shared.destroy()
        values, turn = np.linalg.eigh((block.T @ product + product.T @ block) / 2)
        values, turn = np.maximum(values[::-1], 0.0), turn[:, ::-1]
        axes, explained = block @ turn, float(values[:k].sum())
        if abs(explained - before) <= tolerance * max(explained, 1e-300) or block.shape[1] == width:
            break
        before = explained
        block = np.linalg.qr(product)[0]
    return Components(mean, _signed(axes[:, :k]), values[:k] / total if total > 0 else np.zeros(k))


def _products(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mean, block = shared.value
        total = np.zeros_like(block)
        for batch in batches:
            if len(batch):
                x = matrix(batch["vector"]) - mean
                total += x.T @ (x @ block)
        yield pd.DataFrame({"number": np.arange(block.shape[1], dtype=np.int32), "x": list(total.T)})

    return run


def project(vectors: DataFrame, components: Components) -> DataFrame:
    """Coordinates of each item on the components; a narrow step, no shuffle."""
    shared = vectors.sparkSession.sparkContext.broadcast((components.mean, components.axes))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mean, axes = shared.value
        for batch in batches:
            if len(batch):
                yield pd.DataFrame(
                    {"item_id": batch["item_id"], "coordinates": list((matrix(batch["vector"]) - mean) @ axes)}
                )

    return vectors.select("item_id", V.as_doubles(F.col("vector")).alias("vector")).mapInPandas(
        apply, "item_id long, coordinates array<double>"
    )


def pca(vectors: DataFrame, target: int = TARGET_DIMENSIONS) -> DataFrame:
    return project(vectors, fit_pca(vectors, target))


def covariance(vectors: DataFrame) -> DataFrame:
    """Sample covariance of every pair of components, upper triangle.

    The matrix comes from one pass of partial sums per task, not from pairs of rows.
    """
    doubles = vectors.select(V.as_doubles(F.col("vector")).alias("vector"))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, product = 0, None, None
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch["vector"])
            n += len(x)
            total = x.sum(0) if total is None else total + x.sum(0)
            product = x.T @ x if product is None else product + x.T @ x
        if n:
            i, j = np.triu_indices(len(total))
            yield pd.DataFrame({"i": i, "j": j, "n": n, "si": total[i], "sj": total[j], "p": product[i, j]})

    parts = doubles.mapInPandas(sums, "i int, j int, n long, si double, sj double, p double")
    merged = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "p")])
    return merged.select("i", "j", ((F.col("p") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - 1)).alias("covariance"))
