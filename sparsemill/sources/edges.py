"""Edges from text files by the name of their format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.edges import FORMATS
from .lines import read_lines


def read_edges(spark: SparkSession, paths: str | list[str], format_: str = "triple", separator: str = "\t") -> DataFrame:
    """Edges (i, j, v) of the files. How edges are placed is left to the operators that use them."""
    if format_ not in FORMATS:
        raise ValueError(f"no format {format_}; there are {', '.join(FORMATS)}")
    return FORMATS[format_](read_lines(spark, paths), separator)
