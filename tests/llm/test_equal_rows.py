"""Rows that are equal throughout, or have no doc_id, as a third of a table."""

from __future__ import annotations

from collections import Counter

import pytest
from cases import prose, write
from pyspark.sql import functions as F

from sparsemill.llm import chunks, packing, sharding
from sparsemill.llm.queries import QUERIES


@pytest.fixture(scope="module")
def rows():
    same = prose(30, 1)
    return [(None if k % 2 else 7, same, "en", "s", 1) for k in range(2000)] + [(10_000 + k, prose(30, k), "en", "s", 1) for k in range(1000)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory, rows):
    return write(rows, tmp_path_factory.mktemp("equal"))


def test_shards_are_even(spark, folder, rows):
    got = QUERIES["op8_sampled_splitters"](spark, folder).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 16 and max(sizes.values()) < 1.05 * min(sizes.values())
    assert len({(r["shard"], r["slot"]) for r in got}) == len(rows)


def test_no_range_holds_the_group(spark, folder, rows):
    held = sharding.materialize(sharding.sized(spark.read.parquet(f"{folder}/documents.parquet")), "sized")
    _, weights = sharding.ranges(held, 256)
    assert max(n for _, n in weights.values()) < 60 and sum(n for _, n in weights.values()) == len(rows)


def test_pieces_are_ranked_apart(spark, folder, rows, monkeypatch):
    got = QUERIES["op4_best_fit_packing"](spark, folder).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)


def test_documents_of_one_id_are_dealt_to_ranges(spark, folder, rows):
    dealt = chunks.with_next(spark.read.parquet(f"{folder}/documents.parquet"), 64)
    most = dealt.where("NOT ahead").groupBy("part").count().agg(F.max("count")).first()[0]
    assert most < 300
    got = QUERIES["op5_chunk_fingerprints"](spark, folder).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert sum(r["near_next"] == 1 for r in got) == 1999  # each copy but the last is followed by one
