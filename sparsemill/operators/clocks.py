"""Clocks of workers, and reads of bounded staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import ranked, running


def committed(commits: DataFrame) -> DataFrame:
    """Commits (worker, seq, ...) with `clock`, from 1: the how manieth of its worker each is."""
    return ranked(commits, ["seq"], ["worker"], name="clock").withColumn("clock", F.col("clock") + 1)


def server_clock(commits: DataFrame, workers: int) -> DataFrame:
    """clock and the seq at which the last of all the workers had committed it; clocks that a worker never reached are not there."""
    return committed(commits).groupBy("clock").agg(F.max("seq").alias("seq"), F.count("*").alias("n")).where(F.col("n") == workers).select("clock", "seq")


def versions(commits: DataFrame) -> DataFrame:
    """version and value: the sum of the deltas (column value) of all commits up to that clock, as a parameter that starts at 0 has it after a barrier."""
    each = committed(commits).groupBy("clock").agg(F.sum("value").alias("value"))
    return running(each, ["clock"], "value", name="total").select(F.col("clock").alias("version"), F.col("total").alias("value"))


def stale_reads(reads: DataFrame, of: DataFrame, staleness: int) -> DataFrame:
    """Reads (worker, clock) with the version that they may see at worst, clock - staleness, and its value; version 0 is null, before all commits."""
    asked = reads.withColumn("version", F.greatest(F.col("clock") - F.lit(staleness), F.lit(0)))
    return asked.join(of, "version", "left").select("worker", "clock", "version", "value")
