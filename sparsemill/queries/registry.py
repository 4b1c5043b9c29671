"""Where queries register themselves, and the inputs that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; `sql` is what DuckDB must find."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from suppliers to parts; the quantity, 1 to 50, as a rating from 1 to 5."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), (1 + 4 * (F.col("l_quantity") - 1) / 49).alias("v"))


RATINGS = "(SELECT l_suppkey AS i, l_partkey AS j, 1 + 4 * (l_quantity - 1) / 49e0 AS v FROM lineitem)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x (1, quantity / 50, discount, tax) and y, whether the line was returned."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.array(F.lit(1.0), F.col("l_quantity") / 50, F.col("l_discount"), F.col("l_tax")).alias("x"), (F.col("l_returnflag") == "R").cast("double").alias("y")
    )


SAMPLES = "(SELECT l_orderkey, l_linenumber, 1e0 AS x0, l_quantity / 50e0 AS x1, l_discount AS x2, l_tax AS x3, CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END AS y FROM lineitem)"


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operations on their user's value: a signup pushes, an error removes, anything else adds."""
    op = F.when(F.col("event_type") == "signup", "push").when(F.col("event_type") == "error", "remove").otherwise("inc")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), "value")


OPERATIONS = "(SELECT user_id AS key, event_id AS seq, CASE event_type WHEN 'signup' THEN 'push' WHEN 'error' THEN 'remove' ELSE 'inc' END AS op, value FROM events)"
WORKERS = 4


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commits of four workers."""
    return table(spark, sf_dir, "events").select(F.pmod(F.col("user_id"), F.lit(WORKERS)).alias("worker"), F.col("event_id").alias("seq"), F.round(F.col("value") * 100).cast("long").alias("value"))


COMMITS = f"(SELECT user_id % {WORKERS} AS worker, event_id AS seq, round(value * 100)::BIGINT AS value FROM events)"
