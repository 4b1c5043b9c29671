"""Results as text: the lines of each format, and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def factor_line(id_: Column, values: Column) -> Column:
    """id:v0|v1|..."""
    return F.concat(id_.cast("string"), F.lit(":"), F.array_join(F.transform(values, lambda v: v.cast("string")), "|"))


def cell_line(i: Column, j: Column, v: Column) -> Column:
    """row,column,value"""
    return F.concat_ws(",", i.cast("string"), j.cast("string"), v.cast("string"))


def vector_line(values: Column, separator: str = "\t") -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), separator)


def sample_line(features: Column, label: Column) -> Column:
    """feature,...,label"""
    return F.concat(vector_line(features, ","), F.lit(","), label.cast("string"))


def write_lines(rows: DataFrame, line: Column, path: str, one_file: bool = False) -> None:
    """Write a line for each row, in as many files as there are tasks; `one_file` is for results of a known small size."""
    lines = rows.select(line.alias("value"))
    (lines.coalesce(1) if one_file else lines).write.mode("error").text(path)


def write_predictions(rows: DataFrame, path: str) -> None:
    """user,item,prediction as CSV."""
    rows.select("i", "j", "pred").write.mode("error").csv(path)
