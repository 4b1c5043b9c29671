"""Sparse graphs and matrices from parsed lines: edges (i, j, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ITEM_BREAK, fields, head_and_items, rating_record

EDGE = ("i", "j", "v")


def adjacency_pairs(lines: DataFrame, separator: str, line: str = "value") -> DataFrame:
    """Lines of two fields: an edge of weight 1."""
    return triples_of(lines, fields(F.col(line), separator), mixed=False)


def weighted_pairs(lines: DataFrame, separator: str, line: str = "value") -> DataFrame:
    """Lines of two fields, the second as item:weight."""
    return triples_of(lines, fields(F.col(line), separator), mixed=False)


def triples(lines: DataFrame, separator: str, line: str = "value") -> DataFrame:
    """Lines of three fields, the third a weight."""
    return triples_of(lines, fields(F.col(line), separator), mixed=False)


def adjacency_sets(lines: DataFrame, separator: str, line: str = "value") -> DataFrame:
    """Lines of an id and any number of items, each maybe with a weight: an edge for each item."""
    return triples_of(lines, fields(F.col(line), separator), mixed=True)


def nested_sets(lines: DataFrame, separator: str, inner: str, line: str = "value") -> DataFrame:
    """Lines of an id and one field that holds the items."""
    return triples_of(lines, head_and_items(F.col(line), separator, inner), mixed=True)


def triples_of(lines: DataFrame, record: Column, mixed: bool) -> DataFrame:
    """Edges of records (arrays of strings). Empty records are dropped; without `mixed`, a record must have two or three fields.

    No shuffle: an edge is made where its line was read. Equal edges stay apart.
    """
    rows = lines.select(record.alias("r")).where("size(r) > 0 AND NOT (size(r) = 1 AND r[0] = '')")
    at = lambda c, k: F.get(c, F.lit(k))
    weight = F.coalesce(at("parts", 1).cast("double"), F.lit(1.0))
    if mixed:
        items = rows.select(at("r", 0).alias("i"), F.explode(F.slice("r", F.lit(2), F.size("r") - 1)).alias("item"))
        return items.select("i", F.split("item", ITEM_BREAK).alias("parts")).select("i", at("parts", 0).alias("j"), weight.alias("v"))
    wrong = F.raise_error(F.concat(F.lit("a record has two or three fields, not "), F.col("n").cast("string"))).cast("array<string>")
    fields_ = rows.select(at("r", 0).alias("i"), at("r", 1).alias("item"), at("r", 2).alias("third"), F.size("r").alias("n"))
    # the parts are a column of their own, so that an item is split once
    parts = fields_.select("i", "third", "n", F.when(F.col("n") == 2, F.split("item", ITEM_BREAK)).when(F.col("n") == 3, F.array("item")).otherwise(wrong).alias("parts"))
    return parts.select("i", at("parts", 0).alias("j"), F.when(F.col("n") == 3, F.col("third").cast("double")).otherwise(weight).alias("v"))


def ratings(lines: DataFrame, separator: str = "\t", line: str = "value") -> DataFrame:
    """Edges of a ratings log; lines of another status are dropped."""
    return lines.select(rating_record(F.col(line), separator).alias("r")).where("r IS NOT NULL").select("r.*")


#: Formats by name, as functions of (lines, separator): what a job's settings may name. The inner items of `nested` are parted by commas.
FORMATS = {"pair": adjacency_pairs, "weighted_pair": weighted_pairs, "triple": triples, "set": adjacency_sets, "nested": lambda lines, separator: nested_sets(lines, separator, ","), "ratings": ratings}


def matrix(edges: DataFrame) -> DataFrame:
    """The sparse matrix of the edges: equal cells are summed."""
    return edges.groupBy("i", "j").agg(F.sum("v").alias("v"))


def mean_by_cell(edges: DataFrame) -> DataFrame:
    """Cells with the mean of equal ones."""
    return edges.groupBy("i", "j").agg(F.avg("v").alias("v"))


def row_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("i").agg(F.count("*").alias("degree"))


def column_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("j").agg(F.count("*").alias("degree"))


def dims(edges: DataFrame) -> DataFrame:
    """The numbers of distinct rows and columns, in one row."""
    return edges.agg(F.countDistinct("i").alias("n_rows"), F.countDistinct("j").alias("n_cols"))


def dense_rows(rows: DataFrame, id_: str, vector: str) -> DataFrame:
    """id and features as doubles."""
    return rows.select(F.col(id_).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("features"))


def global_mean(edges: DataFrame) -> DataFrame:
    return edges.agg((F.sum("v") / F.count("v")).alias("mean"))
