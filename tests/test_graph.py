from __future__ import annotations

import numpy as np
import pytest
from conftest import rows
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparsemill.functions import vectors as V
from sparsemill.operators import edges as E
from sparsemill.operators import grid as G
from sparsemill.operators.ranks import dense_index, index_edges, ranked, running
from sparsemill.sources.edges import read_edges

EIGHT = [("a", "b"), ("a", "c"), ("a", "d"), ("b", "a"), ("b", "d"), ("c", "b"), ("c", "d"), ("d", "c")]
FORMS = {
    "adjacency set": ["a\tb\tc\td", "b\ta\td", "c\tb\td", "d\tc"],
    "edge list": ["\t".join(e) for e in EIGHT],
    "mixed": ["a\tc\td", "a\tb", "b\ta", "b\td", "c\tb\td", "d\tc"],
}


def lines(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


@pytest.mark.parametrize("form", FORMS)
def test_forms_agree(spark, form):
    edges = E.adjacency_sets(lines(spark, [*FORMS[form], ""]), "\t")
    assert rows(edges) == [(*e, 1.0) for e in EIGHT]
    assert rows(E.row_degrees(edges)) == [("a", 3), ("b", 2), ("c", 2), ("d", 1)]
    assert rows(E.column_degrees(edges)) == [("a", 1), ("b", 2), ("c", 2), ("d", 3)]
    assert tuple(E.dims(edges).first()) == (4, 4)


def test_other_forms(spark):
    assert rows(E.nested_sets(lines(spark, ["a\tb:0.1|x", "b\tc"]), "\t", ",")) == [("a", "b", 0.1), ("b", "c", 1.0)]
    assert rows(E.nested_sets(lines(spark, ["a\tb,c:2"]), "\t", ",")) == [("a", "b", 1.0), ("a", "c", 2.0)]
    assert rows(E.triples(lines(spark, ["a\tb\t0.5"]), "\t")) == [("a", "b", 0.5)]
    assert rows(E.ratings(lines(spark, ["1\t2\tP\tNULL\tx", "1\t2\tN\t1\tx"]))) == [(1, 2, 3.7)]
    with pytest.raises(Exception, match="two or three fields"):
        E.triples(lines(spark, ["a\tb\tc\td"]), "\t").collect()


def test_read_edges(spark, tmp_path):
    (tmp_path / "e.txt").write_text("a\tb\t2\na\tb\t3\n")
    edges = read_edges(spark, str(tmp_path))
    assert rows(E.matrix(edges)) == [("a", "b", 5.0)] and rows(E.mean_by_cell(edges)) == [("a", "b", 2.5)]
    assert E.global_mean(edges).first()["mean"] == 2.5
    with pytest.raises(ValueError, match="no format"):
        read_edges(spark, str(tmp_path), "nothing")


def test_factor():
    assert [G.factor(n) for n in (2, 4, 6, 8, 12, 18, 32)] == [(2, 1), (2, 2), (3, 2), (4, 2), (4, 3), (6, 3), (8, 4)]
    assert G.factor(12, row_master=False) == (3, 4) and G.factor(7) == (7, 1)
    assert [G.shape(6, p) for p in (G.BY_ROW, G.BY_COLUMN, G.BY_BOTH, G.BY_LINE)] == [(6, 1), (1, 6), (3, 2), (6, 1)]


@given(st.integers(1, 10_000))
def test_factor_is_exact(n):
    a, b = G.factor(n)
    assert a * b == n and b <= n**0.5 and not any(n % d == 0 for d in range(b + 1, int(n**0.5) + 1))


def test_exchange(spark):
    edges = spark.range(100).select(F.col("id").alias("i"), (F.col("id") * 7 % 13).alias("j"), F.lit(1.0).alias("v"))
    found = G.exchange(edges, 4, 3).withColumn("p", F.spark_partition_id()).collect()
    assert all(r["cell"] == r["p"] == (r["i"] % 4) * 3 + r["j"] % 3 for r in found) and len(found) == 100


def test_blocks(spark):
    at = lambda i, j: spark.range(1).select(*G.block_of(F.lit(i), F.lit(j), F.lit(5), F.lit(7), 2, 2)).first()
    assert [tuple(at(i, j)) for i, j in ((0, 0), (1, 2), (2, 3), (4, 6))] == [(0, 0), (0, 0), (1, 1), (1, 1)]


def test_ranks(spark):
    data = [("a", 3), ("a", 1), ("b", 2), ("a", 1), (None, 5), (None, 4)]
    df = spark.createDataFrame(data, "g string, x int")
    assert rows(ranked(df, ["x"], ["g"])) == sorted([("a", 1, 0), ("a", 1, 1), ("a", 3, 2), ("b", 2, 0), (None, 4, 0), (None, 5, 1)], key=str)
    many = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"))
    assert all(r["x"] == r["rank"] for r in ranked(many, ["x"]).collect())
    assert {r["x"]: r["total"] for r in running(many, ["x"], "x").collect()} == dict(enumerate(np.cumsum(range(5000)).tolist()))
    assert rows(dense_index(df, "x")) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert ranked(df.limit(0), ["x"]).count() == 0


def test_index_edges(spark):
    edges, row_map, col_map = index_edges(E.adjacency_sets(lines(spark, FORMS["edge list"]), "\t"))
    ids = {r["idx"]: r["id"] for r in row_map.collect()}
    assert ids == {0: "a", 1: "b", 2: "c", 3: "d"} and col_map.count() == 4
    assert sorted((ids[r["i"]], ids[r["j"]]) for r in edges.collect()) == EIGHT


def test_vectors(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    array = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(V.dot(array(1, 2, 3), array(4, 5, 6))) == 32
    assert one(V.add(array(1, 2, 3), array(1, 1))) == [2, 3] and one(V.add(array(1), array(1, 1))) is None
    assert [one(V.clamp(F.lit(x), 1.0, 5.0)) for x in (0.5, 3.0, 9.0)] == [1, 3, 5]
    assert [one(V.snapped(F.lit(x))) for x in (2.95, 2.05, 2.5)] == [3, 2, 2.5]
    assert one(V.sigmoid(F.lit(1000.0))) == 1 and one(V.sigmoid(F.lit(-1000.0))) == 0


def test_matmul(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 9, (4, 5)), rng.integers(0, 9, (5, 3))
    cells = lambda m: spark.createDataFrame([(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(m)], "i int, j int, v double")
    assert rows(V.matmul(cells(a), cells(b))) == sorted(((int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(a @ b)), key=str)
