"""Arithmetic on array<double> columns and on matrices of (i, j, v) cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def dot_of(a: Column, b: Column, size: int) -> Column:
    """dot() of arrays of a known size, written out: it stays in generated code."""
    return sum((F.get(a, F.lit(k)) * F.get(b, F.lit(k)) for k in range(1, size)), F.get(a, F.lit(0)) * F.get(b, F.lit(0)))


def add(value: Column, delta: Column) -> Column:
    """Element-wise sum over the delta's length: a longer value is cut, for a shorter one there is no sum (null)."""
    total = F.zip_with(F.slice(value, F.lit(1), F.size(delta)), delta, lambda x, y: x + y)
    return F.when(F.size(value) >= F.size(delta), total)


def scaled(a: Column, factor: Column | float) -> Column:
    return F.transform(a, lambda x: x * factor)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sum_arrays(vector: Column, size: int) -> Column:
    """Element-wise sums of an aggregation, as one array column: an expression for each element keeps the partial aggregation in generated code."""
    return F.array(*[F.sum(F.get(vector, F.lit(k))) for k in range(size)])


def avg_arrays(vector: Column, size: int) -> Column:
    return F.array(*[F.avg(F.get(vector, F.lit(k))) for k in range(size)])


def cells(rows: DataFrame, row_id: str, vector: str) -> DataFrame:
    """The cells (i, j, v) of rows of vectors."""
    return rows.select(F.col(row_id).alias("i"), F.posexplode(vector).alias("j", "v"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two matrices of cells (i, j, v): a join on the inner index, then sums, which are partial before the shuffle."""
    left = a.select(F.col("i"), F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("i").alias("k"), F.col("j"), F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def sigmoid(z: Column) -> Column:
    """1 / (1 + e^-z), which doesn't overflow for large z."""
    return 1 / (1 + F.exp(-z))


def snapped(x: Column) -> Column:
    """The next integer up if the fraction is over 0.9, down if it is under 0.1, else the value as it is."""
    part = x - F.floor(x)
    return F.when(part > 0.9, F.ceil(x).cast("double")).when(part < 0.1, F.floor(x).cast("double")).otherwise(x)
