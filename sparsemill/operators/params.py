"""Parameter tables: (key, value), and what is pushed to, pulled from and added to them."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import add, sum_arrays

PUSH, INC, REMOVE = "push", "inc", "remove"


def push(table: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert: `new` (key, value, seq) over `table` (key, value); the highest seq of a key wins."""
    every = table.select("key", "value", F.expr("CAST(NULL AS BIGINT)").alias("seq")).unionByName(new.select("key", "value", F.col("seq").cast("long").alias("seq")))
    return every.groupBy("key").agg(F.max_by("value", F.coalesce("seq", F.lit(-(2**63)))).alias("value"))


def replay(ops: DataFrame) -> DataFrame:
    """The table (key, value) that a log of operations (seq, op, key, value) leaves.

    A push sets, an inc adds if the key is there, a remove ends the key. So the last push or remove
    of a key decides: after a push, the value is its value and all later incs; otherwise the key is
    absent. Both steps aggregate before they shuffle, so a key with very many operations is no
    task's burden but for the join with its one row, which is split if skewed.
    """
    last = ops.where(F.col("op") != INC).groupBy("key").agg(F.max("seq").alias("last"), F.max_by("value", "seq").alias("pushed"), F.max_by(F.col("op") == PUSH, "seq").alias("there")).where("there")
    later = ops.where(F.col("op") == INC).join(last, "key").where("seq > last").groupBy("key").agg(F.sum("value").alias("more"))
    return last.join(later, "key", "left").select("key", (F.col("pushed") + F.coalesce("more", F.lit(0.0))).alias("value"))


def inc(table: DataFrame, deltas: DataFrame) -> DataFrame:
    """Adds all deltas (key, delta) to the keys that are there; others have no effect."""
    more = deltas.groupBy("key").agg(F.sum("delta").alias("delta"))
    return table.join(more, "key", "left").select("key", (F.col("value") + F.coalesce("delta", F.lit(0.0))).alias("value"))


def inc_vectors(table: DataFrame, deltas: DataFrame, size: int) -> DataFrame:
    """inc() of arrays: the deltas have `size` elements, and so has the sum; a shorter value stays as it is."""
    more = deltas.groupBy("key").agg(sum_arrays(F.col("delta"), size).alias("delta"))
    return table.join(more, "key", "left").select("key", F.coalesce(add(F.col("value"), F.col("delta")), F.col("value")).alias("value"))


def inc_to(table: DataFrame, new: DataFrame) -> DataFrame:
    """key, the delta from the current value to the new one, and the value with it added."""
    both = table.join(new.select("key", F.col("value").alias("new")), "key")
    return both.select("key", (F.col("new") - F.col("value")).alias("delta"), (F.col("value") + (F.col("new") - F.col("value"))).alias("value"))


def update(table: DataFrame, deltas: DataFrame, gather: Callable[[Column], Column], apply: Callable[[Column, Column], Column]) -> DataFrame:
    """A user's accumulator for the keys that are there: `gather` aggregates the deltas of a key, `apply` joins value and aggregate.

    Any built-in or pandas aggregate may gather; an associative one is partial before the shuffle.
    """
    _check_arguments(gather, 1)
    _check_arguments(apply, 2)
    gathered = deltas.groupBy("key").agg(gather(F.col("delta")).alias("delta"))
    return table.join(gathered, "key", "left").select("key", F.when(F.col("delta").isNotNull(), apply(F.col("value"), F.col("delta"))).otherwise(F.col("value")).alias("value"))


def _check_arguments(f: Callable, n: int) -> None:
    """An accumulator that can't be called with n columns is refused before anything runs."""
    try:
        inspect.signature(f).bind(*range(n))
    except TypeError as wrong:
        raise TypeError(f"an accumulator takes {n} argument{'s' * (n > 1)}: {wrong}") from None
    except ValueError:  # a built-in without a signature
        pass


def update_in_order(table: DataFrame, deltas: DataFrame, step: Callable[[Column, Column], Column]) -> DataFrame:
    """An accumulator that isn't associative: `step` folds the deltas (key, seq, delta) of each key in order of seq. A key's deltas must fit in a row."""
    _check_arguments(step, 2)
    held = deltas.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "delta"))).alias("d"))
    folded = F.aggregate(F.coalesce("d", F.array()), F.col("value"), lambda v, d: step(v, d["delta"]))
    return table.join(held, "key", "left").select("key", F.when(F.col("d").isNull(), F.col("value")).otherwise(folded).alias("value"))


def remove(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys.select("key"), "key", "left_anti")


def clear(table: DataFrame) -> DataFrame:
    return table.limit(0)


def pull(table: DataFrame, keys: DataFrame) -> DataFrame:
    """The value of each key asked for, null where it is absent."""
    return keys.select("key").join(table, "key", "left").select("key", "value")


def pull_many(table: DataFrame, requests: DataFrame, prefix: str = "", suffix: str = "") -> DataFrame:
    """For requests (request, indexes array): request, pos, key and value in the order asked, with keys made from the indexes."""
    asked = requests.select("request", F.posexplode("indexes").alias("pos", "index")).select("request", "pos", F.concat(F.lit(prefix), F.col("index").cast("string"), F.lit(suffix)).alias("key"))
    return asked.join(table, "key", "left").select("request", "pos", "key", "value")


def contains(table: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.select("key").join(table.select("key", F.lit(True).alias("there")), "key", "left").select("key", F.coalesce("there", F.lit(False)).alias("present"))


def read_all(table: DataFrame, where: Column | None = None) -> DataFrame:
    return table if where is None else table.where(where)


def top(table: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """The k largest values; ties go by key. Each task keeps k rows at most."""
    return read_all(table, where).orderBy(F.desc("value"), "key").limit(k)


def bottom(table: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    return read_all(table, where).orderBy("value", "key").limit(k)


def token(value: Column) -> Column:
    """What tells a value from others, for compare_and_set()."""
    return F.xxhash64(value)


def gets(table: DataFrame) -> DataFrame:
    return table.select("key", "value", token(F.col("value")).alias("token"))


def compare_and_set(table: DataFrame, wishes: DataFrame) -> DataFrame:
    """Wishes (key, value, token): the value is set if the token is still that of the current one. One wish a key; key, value and whether it was set."""
    both = table.join(wishes.select("key", F.col("value").alias("wish"), "token"), "key", "left")
    holds = F.coalesce(F.col("token") == token(F.col("value")), F.lit(False))
    return both.select("key", F.when(holds, F.col("wish")).otherwise(F.col("value")).alias("value"), holds.alias("swapped"))
