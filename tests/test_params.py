from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sparsemill.operators import clocks, collectives
from sparsemill.operators import params as P
from sparsemill.operators.ring import Ring
from sparsemill.streaming import table as S

TABLE = [("a", 1.0), ("b", 2.0), ("c", 2.0)]


@pytest.fixture
def table(spark):
    return spark.createDataFrame(TABLE, "key string, value double")


def serial(ops):
    held = {}
    for _, op, key, value in sorted(ops):
        if op == P.PUSH:
            held[key] = value
        elif op == P.REMOVE:
            held.pop(key, None)
        elif key in held:
            held[key] += value
    return held


def some_ops(n, seed=0):
    r = random.Random(seed)
    return [(k, r.choice([P.PUSH, P.INC, P.INC, P.REMOVE]), r.choice([1, 1, 1, 2, 3, 4]), float(r.randint(-5, 5))) for k in range(n)]


@pytest.mark.parametrize("n", [0, 1, 5, 400])
def test_replay(spark, n):
    ops = some_ops(n)
    assert dict(rows(P.replay(spark.createDataFrame(ops, "seq long, op string, key long, value double")))) == serial(ops)


def test_stream(spark, tmp_path):
    ops = some_ops(300, 1)
    df = spark.createDataFrame(ops, "seq long, op string, key long, value double")
    for k in range(3):  # three batches, in order
        df.where(f"seq BETWEEN {100 * k} AND {100 * k + 99}").coalesce(1).write.mode("append").parquet(str(tmp_path / "ops"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ops"))
    assert dict(rows(S.run_available(spark, stream))) == serial(ops)


def test_push_and_pull(spark, table):
    new = spark.createDataFrame([("b", 5.0, 1), ("b", 7.0, 2), ("d", 1.0, 1)], "key string, value double, seq long")
    assert rows(P.push(table, new)) == [("a", 1.0), ("b", 7.0), ("c", 2.0), ("d", 1.0)]
    keys = spark.createDataFrame([("b",), ("x",)], "key string")
    assert rows(P.pull(table, keys)) == [("b", 2.0), ("x", None)]
    assert rows(P.contains(table, keys)) == [("b", True), ("x", False)]
    assert rows(P.remove(table, keys)) == [("a", 1.0), ("c", 2.0)]
    requests = spark.createDataFrame([(0, [2, 1, 9])], "request int, indexes array<int>")
    held = spark.createDataFrame([("p_1", 1.0), ("p_2", 2.0)], "key string, value double")
    assert rows(P.pull_many(held, requests, "p_")) == [(0, 0, "p_2", 2.0), (0, 1, "p_1", 1.0), (0, 2, "p_9", None)]


def test_inc(spark, table):
    deltas = spark.createDataFrame([("a", 3.0), ("a", -1.0), ("x", 9.0)], "key string, delta double")
    assert rows(P.inc(table, deltas)) == [("a", 3.0), ("b", 2.0), ("c", 2.0)]
    vectors = spark.createDataFrame([("l", [1.0, 2.0, 3.0]), ("s", [1.0])], "key string, value array<double>")
    more = spark.createDataFrame([("l", [1.0, 1.0]), ("l", [1.0, 0.0]), ("s", [1.0, 1.0])], "key string, delta array<double>")
    assert rows(P.inc_vectors(vectors, more, 2)) == [("l", [3.0, 3.0]), ("s", [1.0])]
    assert rows(P.inc_to(table, spark.createDataFrame([("a", 5.0)], "key string, value double"))) == [("a", 4.0, 5.0)]


def test_update(spark, table):
    deltas = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 4.0), ("x", 1, 9.0)], "key string, seq long, delta double")
    assert rows(P.update(table, deltas, F.max, F.greatest)) == [("a", 4.0), ("b", 2.0), ("c", 2.0)]
    assert rows(P.update_in_order(table, deltas, lambda v, d: v * 10 + d)) == [("a", 134.0), ("b", 2.0), ("c", 2.0)]


def test_accumulators_are_checked(spark, table):
    deltas = spark.createDataFrame([("a", 1, 3.0)], "key string, seq long, delta double")
    for gather, apply in ((F.max, lambda v: v), (lambda: 1, F.greatest)):
        with pytest.raises(TypeError, match="an accumulator takes"):
            P.update(table, deltas, gather, apply)
    with pytest.raises(TypeError, match="takes 2 arguments"):
        P.update_in_order(table, deltas, lambda v: v)
    assert P.clear(table).count() == 0


def test_top(table):
    assert [r["key"] for r in P.top(table, 2).collect()] == ["b", "c"]
    assert [r["key"] for r in P.bottom(table, 2, F.col("key") != "a").collect()] == ["b", "c"]


def test_cas(spark, table):
    seen = P.gets(table).withColumn("token", F.when(F.col("key") == "a", F.col("token")).otherwise(F.lit(0)))
    wishes = seen.select("key", F.lit(9.0).alias("value"), "token").where("key <> 'c'")
    assert rows(P.compare_and_set(table, wishes)) == [("a", 9.0, True), ("b", 2.0, False), ("c", 2.0, False)]


def test_ring(spark):
    route = lambda ring, keys: [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(ring.node_of(F.col("k"))).collect()]
    assert route(Ring([1, 2, 3]), ["hello", "world", "pig", "1"]) == [3, 1, 2, 1]
    assert route(Ring([0, 1]), ["key4session"]) == [1]
    keys = spark.range(10_000).select(F.concat(F.lit("p_"), "id").alias("k"))
    count = lambda n: [r[1] for r in rows(keys.groupBy(Ring(range(n)).node_of(F.col("k")).alias("n")).count())]
    assert count(2) == [6867, 3133] and count(4) == [3523, 1464, 2670, 2343]


def test_ring_without_a_node(spark):
    ring = Ring(range(5))
    keys = spark.range(500).select(F.col("id").cast("string").alias("k"))
    for r in keys.select(ring.node_of(F.col("k")).alias("a"), ring.without(3).node_of(F.col("k")).alias("b"), ring.preference(F.col("k")).alias("p")).collect():
        assert r["p"][0] == r["a"] and sorted(r["p"]) == [0, 1, 2, 3, 4]
        assert r["b"] == (r["p"][1] if r["a"] == 3 else r["a"])
    assert keys.select(Ring([]).node_of(F.col("k")).alias("n")).first()["n"] is None


def test_clocks(spark):
    commits = spark.createDataFrame([(0, 1, 1), (1, 2, 2), (0, 3, 4), (0, 4, 8), (1, 9, 16)], "worker int, seq long, value long")
    assert rows(clocks.server_clock(commits, 2)) == [(1, 2), (2, 9)]
    held = clocks.versions(commits)
    assert rows(held) == [(1, 3), (2, 23), (3, 31)]
    reads = spark.createDataFrame([(0, 3), (1, 1)], "worker int, clock long")
    assert rows(clocks.stale_reads(reads, held, 1)) == [(0, 3, 2, 23), (1, 1, 0, None)]
    assert rows(clocks.stale_reads(reads, held, 0)) == [(0, 3, 3, 31), (1, 1, 1, 3)]


def test_collectives(spark):
    partials = spark.createDataFrame([(3, 10.0), (5, 1.0)], "n int, x double")
    assert tuple(collectives.all_reduce(partials, ["x"], ["n"]).first()) == (11.0, 3)
    maps = spark.createDataFrame([("a", 1), ("b", 2), ("a", 5)], "k string, n int")
    assert rows(collectives.all_gather_merge(maps, "k", "n")) == [("a", 6), ("b", 2)]
    ids = spark.range(50)
    orders = [[r["id"] for r in collectives.shuffled(ids, "id", 1, k).orderBy("place").collect()] for k in (0, 0, 1)]
    assert orders[0] == orders[1] != orders[2] and sorted(orders[2]) == list(range(50))
    deltas = spark.createDataFrame([(1, [1.0, 3.0]), (1, [3.0, 5.0])], "k int, delta array<double>")
    assert rows(collectives.mean_of_deltas(deltas, "k", 2)) == [(1, [2.0, 4.0])]
