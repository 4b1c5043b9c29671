"""Sessions with the settings that the engine's results rely on, and sizes that follow the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of shuffled data for each reducing task to aim at.
SHUFFLE_BYTES_EACH = 128 << 20

#: Bytes of files that may be one row group, which is one task's work whatever the cores, and from which on it pays to deal their rows out.
SMALL_TABLE, LEAST_TABLE = 64 << 20, 8 << 20

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join whose rows are then summed by its key (log replay, factor updates) is split too if it is skewed, at the cost of one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "sparsemill", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


def shuffle_partitions(input_bytes: int, cores: int) -> int:
    """Reducing tasks for an input: at least two rounds of the cores, and no more data each than fits beside others in an executor."""
    return max(2 * cores, -(-input_bytes // SHUFFLE_BYTES_EACH))


def spread(table: DataFrame) -> DataFrame:
    """The rows of a small table of files dealt out to all cores, for work that takes far longer than a shuffle. A larger one has parts enough and stays as it is."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(table.sparkSession.sparkContext.defaultParallelism) if LEAST_TABLE <= size <= SMALL_TABLE else table
