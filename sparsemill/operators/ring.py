"""Consistent hashing: which node a key belongs to."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

REPLICAS = 3


class Ring:
    """Each node stands at `replicas` places, the md5 of "node:number"; a key belongs to the first place at or after its own md5, around the ring.

    The ring has a few entries for each node and goes into the plan as a constant: routing needs no join.
    """

    def __init__(self, nodes: Sequence[int], replicas: int = REPLICAS):
        self.nodes, self.replicas = list(nodes), replicas
        self.places = sorted((hashlib.md5(f"{node}:{k}".encode()).hexdigest(), node) for node in self.nodes for k in range(replicas))

    def without(self, node: int) -> Ring:
        return Ring([n for n in self.nodes if n != node], self.replicas)

    def _from(self, key: Column) -> tuple[Column, Column]:
        """The ring's nodes in order, and the index of the key's first place."""
        marks = F.array(*[F.lit(m) for m, _ in self.places])
        nodes = F.array(*[F.lit(n) for _, n in self.places])
        return nodes, F.size(F.filter(marks, lambda m: m < F.md5(key.cast("string")))) % len(self.places)

    def node_of(self, key: Column) -> Column:
        if not self.places:
            return F.lit(None).cast("int")
        nodes, at = self._from(key)
        return F.get(nodes, at)

    def preference(self, key: Column) -> Column:
        """All nodes in the order in which they follow the key, each once."""
        if not self.places:
            return F.array().cast("array<int>")
        nodes, at = self._from(key)
        return F.array_distinct(F.concat(F.slice(nodes, at + 1, F.lit(len(self.places)) - at), F.slice(nodes, F.lit(1), at)))
