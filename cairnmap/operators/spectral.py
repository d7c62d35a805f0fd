"""Leading eigenvectors of a graph's normalised adjacency, for layouts that start from the graph's own shape.

The eigenvectors of D^-1/2 W D^-1/2 next to the largest are those of the normalised Laplacian next to the smallest. They are found by
filtered block iteration: a product with the matrix is one join of edges with vectors and one sum; a Chebyshev polynomial of
several products damps everything below the wanted eigenvalues; then the block, a few numbers per node, is made orthonormal
through its Gram matrix, of which (as of the Rayleigh quotients) only a square as wide as the block comes to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from cairnmap import SEED
from cairnmap.session import discard, written

# Columns besides those asked for, products per round, rounds at most, and the residual that ends it.
EXTRA, DEGREE, ROUNDS, TOLERANCE = 4, 8, 12, 1e-4


def _times(column: str, matrix: np.ndarray) -> Column:
    """The array column (a row of the block) times a small matrix."""
    return F.array(*[sum((F.get(column, F.lit(i)) * float(matrix[i, j]) for i in range(matrix.shape[0])), F.lit(0.0)) for j in range(matrix.shape[1])])


def _gram(rows: DataFrame, left: str, right: str, width: int) -> np.ndarray:
    sums = rows.agg(*[F.sum(F.get(left, F.lit(i)) * F.get(right, F.lit(j))).alias(f"g{i}_{j}") for i in range(width) for j in range(width)]).first()
    return np.array([[sums[f"g{i}_{j}"] for j in range(width)] for i in range(width)])


def _product(edges: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """``rows`` with ``mx``: the matrix times column x."""
    far = rows.select(F.col("id").alias("tail"), F.col("x").alias("_far"))
    sums = edges.join(far, "tail").groupBy(F.col("head").alias("_head")).agg(*[F.sum(F.col("w") * F.get("_far", F.lit(i))).alias(f"s{i}") for i in range(width)])
    return rows.join(sums, rows["id"] == sums["_head"]).withColumn("mx", F.array(*[f"s{i}" for i in range(width)])).drop("_head", *[f"s{i}" for i in range(width)])


def spectral_vectors(graph: DataFrame, count: int, seed: int = SEED, rounds: int = ROUNDS, degree: int = DEGREE, tolerance: float = TOLERANCE) -> tuple[DataFrame, np.ndarray]:
    """((id, x), eigenvalues): for each node of the graph (item_id, other_id, weight) its entries in the ``count`` leading eigenvectors.

    Eigenvalues fall from 1; a connected graph has one of 1, whose vector holds the roots of the degrees. Vectors have length 1; the largest entry
    by size of each is positive. Nodes without an edge are not in the graph.
    """
    ends = F.array(F.struct(F.col("item_id").alias("head"), F.col("other_id").alias("tail")), F.struct(F.col("other_id").alias("head"), F.col("item_id").alias("tail")))
    both = written(graph.filter("weight > 0").select(F.explode(ends).alias("e"), "weight").select("e.*", "weight"))
    degrees = written(both.groupBy(F.col("head").alias("id")).agg(F.sum("weight").alias("d")))
    n = degrees.count()
    width = min(n, count + EXTRA)
    count = min(count, width)
    d1, d2 = degrees.select(F.col("id").alias("head"), F.col("d").alias("_dh")), degrees.select(F.col("id").alias("tail"), F.col("d").alias("_dt"))
    edges = written(both.join(d1, "head").join(d2, "tail").select("head", "tail", (F.col("weight") / F.sqrt(F.col("_dh") * F.col("_dt"))).alias("w")))

    def noise(i: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "id"), F.lit(1 << 30)) / float(1 << 30) - 0.5

    rows = written(degrees.select("id", F.array(F.sqrt("d"), *[noise(i) for i in range(1, width)]).alias("x")))
    low = 0.5
    for number in range(rounds):
        # orthonormal columns, then the best combinations of them
        half = np.linalg.inv(np.linalg.cholesky(_gram(rows, "x", "x", width) + 1e-300 * np.eye(width))).T
        block = written(_product(edges, written(rows.select("id", _times("x", half).alias("x"))), width))
        quotient = _gram(block, "x", "mx", width)
        values, turn = np.linalg.eigh((quotient + quotient.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block = written(block.select("id", _times("x", turn).alias("x"), _times("mx", turn).alias("mx")))
        gaps = [F.sum(F.pow(F.get("mx", F.lit(i)) - float(values[i]) * F.get("x", F.lit(i)), 2)).alias(f"r{i}") for i in range(count)]
        missed = block.agg(*gaps).first()
        if max(missed[f"r{i}"] for i in range(count)) ** 0.5 <= tolerance or number == rounds - 1 or width == n:
            break
        # Chebyshev polynomial that is small between -1 and the block's last eigenvalue
        low = min(max(float(values[-1]), -0.9), 0.999)
        centre, span = (low - 1) / 2, (low + 1) / 2
        state = block.select("id", F.col("x").alias("before"), F.zip_with("mx", "x", lambda m, x: (m - centre * x) / span).alias("x"))
        for _ in range(degree - 1):
            step = written(_product(edges, written(state), width))
            three = F.zip_with(F.zip_with("mx", "x", lambda m, x: 2 * (m - centre * x) / span), "before", lambda y, b: y - b)
            state = step.select("id", F.col("x").alias("before"), three.alias("x"))
        discard(rows)
        # columns grow alike by the polynomial; each is brought back to length 1 before the Gram matrix is inverted
        state = written(state.select("id", "x"))
        lengths = state.agg(*[F.sqrt(F.sum(F.pow(F.get("x", F.lit(i)), 2))).alias(f"l{i}") for i in range(width)]).first()
        rows = written(state.select("id", _times("x", np.diag([1 / max(lengths[f"l{i}"], 1e-300) for i in range(width)])).alias("x")))
    tops = block.agg(*[F.max_by(F.get("x", F.lit(i)), F.struct(F.abs(F.round(F.get("x", F.lit(i)), 9)), -F.col("id"))).alias(f"t{i}") for i in range(count)]).first()
    signs = np.diag([-1.0 if tops[f"t{i}"] < 0 else 1.0 for i in range(count)])
    chosen = block.select("id", F.slice("x", 1, count).alias("x"))
    return written(chosen.select("id", _times("x", signs).alias("x"))), values[:count]
