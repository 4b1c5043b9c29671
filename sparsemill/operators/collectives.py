"""What workers agree on: sums, minima, merged maps, averages, and a common random order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import avg_arrays
from .ranks import ranked


def all_reduce(partials: DataFrame, sums: list[str] = (), least: list[str] = ()) -> DataFrame:
    """One row: sums and minima over the workers' rows."""
    return partials.agg(*[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in least])


def all_gather_merge(maps: DataFrame, key: str, value: str, merge=F.sum) -> DataFrame:
    """Workers' maps (key, value) as one; values of a key are merged."""
    return maps.groupBy(key).agg(merge(value).alias(value))


def order_key(id_: Column, seed: int, round_: int) -> Column:
    """A hash that orders ids at random, anew for each round, and the same on every run and engine."""
    return F.md5(F.concat(F.lit(f"{seed}:{round_}:"), id_.cast("string")))


def shuffled(rows: DataFrame, id_: str, seed: int, round_: int) -> DataFrame:
    """id and its place in a random order."""
    return ranked(rows.select(order_key(F.col(id_), seed, round_).alias("_key"), id_), ["_key"], name="place").select(id_, "place")


def mean_of_deltas(deltas: DataFrame, key: str, size: int) -> DataFrame:
    """The element-wise mean of the deltas that workers push for each key: under a barrier, the mean of their local models."""
    return deltas.groupBy(key).agg(avg_arrays(F.col("delta"), size).alias("delta"))
