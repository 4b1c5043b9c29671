"""Connected components of edges that stay distributed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of the nodes 0..n-1 reaches over the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for ends in (a, b, label[a], label[b]):
            np.minimum.at(new, ends, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (u long, v long) that isn't a root: the smallest node that it reaches.

    Alternating large-star and small-star steps: each node hands its smallest neighbour to the
    others, so the number of rounds follows the logarithm of the longest path. A node may have very
    many neighbours, so they are dealt to PARTS parts. Each round is written to the shared folder,
    which ends its lineage, and the round before it is removed.
    """
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if not mark["n"] or mark == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, last = mark, edges
        edges = materialize(_small_star(_large_star(edges)), "edges")
        discard(last)


#: Parts that the neighbours of one node, and the nodes of one component, are dealt to.
PARTS = 128


def _dealt(edges: DataFrame) -> DataFrame:
    return edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)))


def _least(dealt: DataFrame) -> DataFrame:
    """u, the smallest of it and its neighbours, and the parts that its neighbours are in."""
    each = dealt.groupBy("u", "part").agg(F.min("v").alias("v"))
    return each.groupBy("u").agg(F.least("u", F.min("v")).alias("low"), F.collect_list("part").alias("parts"))


def _to_parts(low: DataFrame) -> DataFrame:
    return low.select("u", "low", F.explode("parts").alias("part"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the smallest of them all."""
    both = _dealt(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    return both.where("v > u").join(_to_parts(_least(both)), ["u", "part"]).select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of them."""
    dealt = _dealt(edges)
    low = _least(dealt)
    moved = dealt.join(_to_parts(low), ["u", "part"]).where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.select("u", F.col("low").alias("v"))).where("u <> v").distinct()


def with_least(nodes: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """`key` and component_id of each node (key, least), where component_id is the smallest `least` of its component in `found` (node, root).

    A component may hold a third of all nodes, so neither its minimum nor the way back to its nodes
    goes by the root alone: its nodes are dealt to PARTS parts, each with a minimum of its own.
    Written, so that a join with very many rows of one key can be split.
    """
    members = found.select(F.col("node").alias(key), "root").unionByName(found.select(F.col("root").alias(key), "root").distinct())
    linked = materialize(members.join(nodes.select(key, "least"), key).withColumn("part", F.pmod(F.xxhash64(key), F.lit(PARTS))), "linked")
    each = linked.groupBy("root", "part").agg(F.min("least").alias("least"))
    whole = each.groupBy("root").agg(F.min("least").alias("component_id"), F.collect_list("part").alias("parts")).select("root", "component_id", F.explode("parts").alias("part"))
    of_key = linked.select(key, "root", "part").join(whole, ["root", "part"]).select(key, "component_id")
    return materialize(nodes.select(key, "least").join(of_key, key, "left").select(key, F.coalesce("component_id", "least").alias("component_id")), "components")
