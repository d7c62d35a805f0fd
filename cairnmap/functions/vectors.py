"""Vector arithmetic on array columns, inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, functions as F

_NORM_FLOOR = 1e-12


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(left: Column, right: Column) -> Column:
    return total(F.zip_with(as_doubles(left), as_doubles(right), lambda a, b: a * b))


def l2_norm(vector: Column) -> Column:
    return F.sqrt(total(F.transform(as_doubles(vector), lambda x: x * x)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Use a computed value several times in an expression, computing it once per row.

    Inside a lambda an outer expression would be computed again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def l2_normalize(vector: Column, floor: float = _NORM_FLOOR, extra: float = 0.0) -> Column:
    """Divide by the length; the zero vector stays zero."""

    def divide(v: Column) -> Column:
        length = F.greatest(l2_norm(v) + F.lit(extra), F.lit(floor))
        return let(length, lambda n: F.transform(v, lambda x: x / n))

    return let(as_doubles(vector), divide)


def has_nan(vector: Column) -> Column:
    return F.exists(vector, lambda x: F.isnan(x))


def zero_if_nan(vector: Column) -> Column:
    """A vector with any NaN becomes the zero vector of the same width."""
    return F.when(has_nan(vector), F.array_repeat(F.lit(0.0), F.size(vector))).otherwise(as_doubles(vector))


def euclidean(left: Column, right: Column) -> Column:
    return F.sqrt(total(F.zip_with(as_doubles(left), as_doubles(right), lambda a, b: (a - b) * (a - b))))


def mean_vector(vector: Column) -> Column:
    """Aggregate: component-wise mean with map-side partial sums."""
    return vector_to_array(Summarizer.mean(array_to_vector(as_doubles(vector))))
