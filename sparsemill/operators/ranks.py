"""Ranks and dense indexes without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize


def ranked(rows: DataFrame, order: list[str], within: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Adds the place, from 0, of each row among those with the same `within`, by `order`; ties go by all other columns.

    Rows are range-partitioned by (within, order) and sorted, so that a group, however large, may
    span tasks; a row's rank is its place within its task less that of the group's first row there,
    plus the group's rows in earlier tasks. Of these counts there is one row for each task and
    group in it.
    """
    within = within or []
    keys = list(dict.fromkeys([*within, *order, *rows.columns]))
    at = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    held = materialize(at, "ranked")
    counts = held.groupBy("_part", *within).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    groups = [F.col(c).alias(f"_group{k}") for k, c in enumerate(within)]
    offsets = counts.select(F.col("_part").alias("_of"), *groups, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = [F.col("_part") == F.col("_of"), *[F.col(c).eqNullSafe(F.col(f"_group{k}")) for k, c in enumerate(within)]]
    return held.join(offsets, on=same).select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias(name))


def dense_index(ids: DataFrame, column: str, name: str = "idx") -> DataFrame:
    """Each distinct id with its place, from 0, in sorted order."""
    return ranked(ids.select(column).distinct(), [column], name=name)


def index_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges by dense indexes, and the maps (idx, id) of rows and columns."""
    rows, columns = (dense_index(edges, c).withColumnRenamed(c, "id") for c in ("i", "j"))
    moved = edges.join(rows.select(F.col("id").alias("i"), F.col("idx").alias("row")), "i").join(columns.select(F.col("id").alias("j"), F.col("idx").alias("column")), "j")
    return moved.select(F.col("row").alias("i"), F.col("column").alias("j"), "v"), rows, columns


def running(rows: DataFrame, order: list[str], value: str, name: str = "total") -> DataFrame:
    """Adds the sum of `value` over the rows up to and with each one by `order`. Like ranked(), with sums in place of counts."""
    keys = list(dict.fromkeys([*order, *rows.columns]))
    at = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    held = materialize(at, "running")
    sums = held.groupBy("_part").agg(F.sum(value).alias("_sum"))  # a row for each task
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    local = F.sum(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn("_local", local).join(offsets, "_part").select(*rows.columns, (F.col("_before") + F.col("_local")).alias(name))
