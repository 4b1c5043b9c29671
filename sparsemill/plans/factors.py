"""Matrix factorisation: plain and with biases, in batches and in the order of each grid cell.

Ratings are edges (i, j, v), factors (id, f array<double>, b double): a row of users or of items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import add, avg_arrays, clamp, dot_of
from ..operators.grid import cell_of, column_cells, row_cells
from ..shared import materialize
from .loop import cut, stale_rounds

LOW, HIGH = 1.0, 5.0

#: What a row is to its cell: factors of a user or an item, or an edge. Factors come first.
FACTORS, EDGES = (0, 1), 2
#: Changed factors that a cell hands over at once.
ROWS_AT_ONCE = 10_000


@dataclass(frozen=True)
class Settings:
    k: int
    alpha: float
    beta: float
    biased: bool = False
    clamped: bool = False


def initial(id_: Column, k: int) -> Column:
    """Numbers in [0, 1) that follow from id and place alone, the same on every run and engine."""
    return F.array(*[F.pmod(F.pmod(id_, F.lit(100)) * 31 + e * 17, F.lit(100)) / F.lit(100.0) for e in range(k)])


def start(ids: DataFrame, column: str, k: int) -> DataFrame:
    """Factors of all distinct ids, without bias."""
    return ids.select(F.col(column).alias("id")).distinct().select("id", initial(F.col("id"), k).alias("f"), F.lit(0.0).alias("b"))


def random_start(ids: DataFrame, column: str, k: int, seed: int = 0) -> DataFrame:
    """Factors of all distinct ids, uniform in [0, 1) and different for each id, without bias; the same for the same seed."""
    chance = lambda e: F.shiftrightunsigned(F.xxhash64("id", F.lit(e), F.lit(seed)), 11) / float(2**53)
    return ids.select(F.col(column).alias("id")).distinct().select("id", F.array(*map(chance, range(k))).alias("f"), F.lit(0.0).alias("b"))


def _side(factors: DataFrame, key: str, f: str, b: str) -> DataFrame:
    return factors.select(F.col("id").alias(key), F.col("f").alias(f), F.col("b").alias(b))


def with_factors(edges: DataFrame, users: DataFrame, items: DataFrame, last: str = "i") -> DataFrame:
    """Edges with the factors of both ends (p, bu, q, bi); the join on `last` comes last, so that a grouping by it needs no further shuffle."""
    sides = [("i", _side(users, "i", "p", "bu")), ("j", _side(items, "j", "q", "bi"))]
    for key, side in sorted(sides, key=lambda x: x[0] == last):
        edges = edges.join(side, key)
    return edges


def prediction(s: Settings, mean: float = 0.0, clamped: bool | None = None) -> Column:
    p = dot_of(F.col("p"), F.col("q"), s.k)
    if s.biased:
        p = p + F.col("bu") + F.col("bi") + mean
    return clamp(p, LOW, HIGH) if (s.clamped if clamped is None else clamped) else p


def deltas(joined: DataFrame, s: Settings, mean: float = 0.0) -> DataFrame:
    """The step of each edge for both of its ends, from the same factors: dp, dq, dbu, dbi.

    The steps are written out place by place, which refers to the error often enough that the
    optimizer computes it once a row; within a higher-order function it would be computed for each place.
    """
    e = F.col("v") - prediction(s, mean)
    at = lambda c, k: F.get(F.col(c), F.lit(k))
    step = lambda own, other: F.array(*[(at(other, k) * 2 * F.col("e") - at(own, k) * s.beta) * s.alpha for k in range(s.k)])
    bias = lambda b: (2 * F.col("e") - s.beta * F.col(b)) * s.alpha
    return joined.withColumn("e", e).select("i", "j", step("p", "q").alias("dp"), step("q", "p").alias("dq"), bias("bu").alias("dbu"), bias("bi").alias("dbi"))


def moved(factors: DataFrame, steps: DataFrame, key: str, f: str, b: str, k: int) -> DataFrame:
    """Factors plus the mean of their edges' steps; without edges they stay."""
    mean = steps.groupBy(F.col(key).alias("id")).agg(avg_arrays(F.col(f), k).alias("df"), F.avg(b).alias("db"))
    return factors.join(mean, "id", "left").select("id", F.coalesce(add(F.col("f"), F.col("df")), F.col("f")).alias("f"), (F.col("b") + F.coalesce("db", F.lit(0.0))).alias("b"))


def epoch(edges: DataFrame, users: DataFrame, items: DataFrame, s: Settings, mean: float = 0.0, newest: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """One round over all edges: steps from `users` and `items`, added to them or to `newest`.

    Means are partial before each shuffle, so what moves is factors, not steps.
    """
    by_user = deltas(with_factors(edges, users, items, "i"), s, mean)
    by_item = deltas(with_factors(edges, users, items, "j"), s, mean)
    bias = "dbu" if s.biased else "0D"
    by_user = by_user.withColumn("_b", F.expr(bias))
    by_item = by_item.withColumn("_b", F.expr("dbi" if s.biased else "0D"))
    own_users, own_items = newest or (users, items)
    return moved(own_users, by_user, "i", "dp", "_b", s.k), moved(own_items, by_item, "j", "dq", "_b", s.k)


def batch_of(batches: int, seed: int, round_: int) -> Column:
    """The batch of an edge, dealt at random and anew in each round, and the same on every run and engine."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit(round_), F.col("i"), F.col("j")))
    return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.lit(batches))


def fit(
    edges: DataFrame, users: DataFrame, items: DataFrame, s: Settings, n_rounds: int, mean: float = 0.0, staleness: int = 0, sync_every: int = 0, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Rounds whose steps may come from factors that are so many clocks old; each clock's factors are written, which ends their lineage.

    A clock is a round, or with `sync_every` a random batch of about so many edges: the budget of
    clocks is then the rounds times the batches.
    """
    batches = max(1, -(-edges.count() // sync_every)) if sync_every else 1

    def step(seen: dict[str, DataFrame], newest: dict[str, DataFrame], k: int) -> dict[str, DataFrame]:
        part = edges if batches == 1 else edges.where(batch_of(batches, seed, k // batches) == k % batches)
        u, i = epoch(part, seen["users"], seen["items"], s, mean, (newest["users"], newest["items"]))
        return cut({"users": u, "items": i}, k)

    state = stale_rounds({"users": users, "items": items}, step, n_rounds * batches, staleness)
    return state["users"], state["items"]


def predict(pairs: DataFrame, users: DataFrame, items: DataFrame, s: Settings, mean: float = 0.0) -> DataFrame:
    """i, j and pred of pairs whose ends both have factors."""
    return with_factors(pairs, users, items).select("i", "j", prediction(s, mean).alias("pred"))


def rmse(edges: DataFrame, users: DataFrame, items: DataFrame, s: Settings, mean: float = 0.0) -> DataFrame:
    """The root of the mean squared error, never clamped, in one row."""
    e = F.col("v") - prediction(s, mean, clamped=False)
    return with_factors(edges, users, items).agg(F.sqrt(F.avg(e * e)).alias("rmse"))


def regularised_loss(edges: DataFrame, users: DataFrame, items: DataFrame, s: Settings) -> DataFrame:
    """For each edge its squared error and beta / 2 times the squares of its factors; the sum in one row."""
    e = F.col("v") - prediction(s)
    squares = lambda f: dot_of(F.col(f), F.col(f), s.k)
    return with_factors(edges, users, items).agg(F.sum(e * e + (squares("p") + squares("q")) * (s.beta / 2)).alias("loss"))


@dataclass
class Cell:
    """What a task learns from: edges by the places of their ends, and the factors and biases of the cell, which a pass changes. Edges are a batch of the cell's."""

    i: np.ndarray
    j: np.ndarray
    v: np.ndarray
    p: np.ndarray
    q: np.ndarray
    bu: np.ndarray
    bi: np.ndarray
    mean: float = 0.0

    def error(self, s: Settings, a: int, b: int, value: float) -> float:
        found = self.p[a] @ self.q[b]
        if s.biased:
            found += self.mean + self.bu[a] + self.bi[b]
        return value - (min(HIGH, max(LOW, found)) if s.clamped else found)


def _pass(cell: Cell, s: Settings, one_by_one: bool) -> None:
    p, q, bu, bi = cell.p, cell.q, cell.bu, cell.bi
    for a, b, value in zip(cell.i, cell.j, cell.v, strict=True):
        e = 2 * cell.error(s, a, b, value)
        old = p[a].copy()
        p[a] += s.alpha * (e * q[b] - s.beta * p[a])
        q[b] += s.alpha * (e * (p[a] if one_by_one else old) - s.beta * q[b])
        if s.biased:
            bu[a] += s.alpha * (e - s.beta * bu[a])
            bi[b] += s.alpha * (e - s.beta * bi[b])


def simultaneous(cell: Cell, s: Settings) -> None:
    """Edge by edge; both ends move from the factors before."""
    _pass(cell, s, one_by_one=False)


def one_after_the_other(cell: Cell, s: Settings) -> None:
    """Edge by edge; the item moves from the user's new factors."""
    _pass(cell, s, one_by_one=True)


def grid_round(
    edges: DataFrame, users: DataFrame, items: DataFrame, s: Settings, rows: int, columns: int, learn: Callable[[Cell, Settings], None] = simultaneous, order: Callable[[Column, Column], Column] | None = None, mean: float = 0.0
) -> tuple[DataFrame, DataFrame]:
    """One round in which each cell of a grid goes through its edges one by one, from common factors; the cells' changes are averaged.

    A cell's edges go to its task sorted, and pass by in batches, each of which `learn` gets in turn;
    only the factors of the cell's rows and columns must fit in memory, which reach it before the
    edges, once. `order` sorts a cell's edges; without it they go by i, then j. What the cells change
    is written once, for both sides.
    """
    key = order or (lambda i, j: F.lit(0))
    given = lambda factors, kind, cells: factors.select(F.explode(cells).alias("cell"), F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), F.concat("f", F.array("b")).alias("f"))
    sides = given(users, FACTORS[0], row_cells(F.col("id"), rows, columns)).unionByName(given(items, FACTORS[1], column_cells(F.col("id"), rows, columns)))
    sides = sides.select("cell", "kind", F.col("id").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0.0).alias("v"), "f")  # no null ids, which pandas would hold as floats
    i, j = F.col("i"), F.col("j")
    ends = edges.where(i.isNotNull() & j.isNotNull()).select(cell_of(i, j, rows, columns).alias("cell"), F.lit(EDGES).alias("kind"), i.cast("long").alias("i"), j.cast("long").alias("j"), F.col("v").cast("double").alias("v"), key(i, j).alias("turn"))
    held = ends.unionByName(sides, allowMissingColumns=True)
    held = held.repartition("cell").sortWithinPartitions("cell", "kind", F.asc_nulls_last("turn"), "i", "j", F.asc_nulls_last("v")).drop("turn")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given: tuple[list, list] = ([], [])
        cell = None
        for batch in batches:
            for kind in FACTORS:
                part = batch[batch["kind"] == kind]
                if len(part):
                    given[kind].append((part["i"].to_numpy(), np.stack(part["f"].to_numpy()).astype(float)))
            part = batch[batch["kind"] == EDGES]
            if not (len(part) and all(given)):
                continue
            if cell is None:
                ids, f = zip(*((pd.Index(np.concatenate(x)), np.concatenate(y)) for x, y in (zip(*side, strict=True) for side in given)), strict=True)
                none = np.zeros(0, int)
                cell = Cell(none, none, none, *(x[:, :-1].copy() for x in f), *(x[:, -1].copy() for x in f), mean)
                met = [np.zeros(len(x), bool) for x in ids]
            a, b, v = ids[0].get_indexer(part["i"]), ids[1].get_indexer(part["j"]), part["v"].to_numpy()
            known = (a >= 0) & (b >= 0)
            cell.i, cell.j, cell.v = a[known], b[known], v[known]
            learn(cell, s)
            met[0][cell.i] = met[1][cell.j] = True
        if cell is None:
            return
        for side, names, before, after, bias, seen in zip("ij", ids, f, (cell.p, cell.q), (cell.bu, cell.bi), met, strict=True):
            at = np.flatnonzero(seen)
            for k in range(0, len(at), ROWS_AT_ONCE):
                part = at[k : k + ROWS_AT_ONCE]
                yield pd.DataFrame({"side": side, "id": names[part], "delta": list(after[part] - before[part, :-1]), "bias": bias[part] - before[part, -1]})

    steps = held.groupBy("cell").applyInPandas(run, "side string, id long, delta array<double>, bias double")
    steps = materialize(steps, "cell-steps")
    side = lambda factors, name: moved(factors, steps.where(F.col("side") == name), "id", "delta", "bias", s.k)
    return side(users, "i"), side(items, "j")
