"""Each query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from sparsemill import catalog

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    held = duckdb.connect()
    for t in TABLES:
        held.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return held


def plain(rows, columns):
    order = sorted(columns)
    return sorted((tuple(dict(zip(columns, r, strict=True))[c] for c in order) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF_DIR)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), want.columns)


def test_without_sql(spark):
    stream = {r["key"]: r["value"] for r in catalog.QUERIES["s01_kv_stream"](spark, SF_DIR).collect()}
    assert stream == {r["key"]: r["value"] for r in catalog.QUERIES["q31_kv_remove"](spark, SF_DIR).collect()}
    assert {r["file"] for r in catalog.QUERIES["q60_expand_paths"](spark, SF_DIR).collect()} == {f"{t}.parquet" for t in TABLES}
    assert catalog.QUERIES["q67_mf_grid_round"](spark, SF_DIR).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).collect()) == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_word_count_sums_before_the_shuffle(spark):
    plan = catalog.QUERIES["q02_wc_counts"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "ReadSchema: struct<text:string>" in plan


def test_top_k_keeps_k_rows_a_task(spark):
    assert "TakeOrderedAndProject" in catalog.QUERIES["q01_wc_topk"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


def test_routing_needs_no_join(spark):
    assert "Join" not in catalog.QUERIES["q39_ring_route"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
