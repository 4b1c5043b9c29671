"""Word counts and the most and least frequent words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words


def counts(lines: DataFrame, text: str = "text") -> DataFrame:
    """word and n. Words are counted where they are before they are shuffled."""
    return lines.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def top(lines: DataFrame, k: int, text: str = "text") -> DataFrame:
    return counts(lines, text).orderBy(F.desc("n"), "word").limit(k)


def bottom(lines: DataFrame, k: int, text: str = "text") -> DataFrame:
    return counts(lines, text).orderBy("n", "word").limit(k)
