"""Clean texts stay in the pipeline whatever their length."""

from __future__ import annotations

import random

from cases import prose

from sparsemill.llm import quality

SMALL = prose(4000, 3).split()


def natural(words: int, seed: int) -> str:
    """Words drawn by rank, so that the share of distinct ones falls with the length."""
    r = random.Random(seed)
    return " ".join(SMALL[int(len(SMALL) ** r.random()) - 1] for _ in range(words))


def test_long_clean_text_is_kept(spark):
    clean = natural(60_000, 1)
    assert len(set(clean.split())) < 0.1 * 60_000
    faulty = [" ".join(random.Random(k).choices(["Buy1", "now2", "cheap3", "###"], k=300)) for k in range(30)]
    texts = [clean] + [prose(200, k) for k in range(10, 110)] + faulty + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in quality.keep_good(docs).collect()}
    assert kept == set(range(101))


def test_window_distinct(spark):
    texts = [[], ["a"], ["a", "a"], [str(k % 7) for k in range(1203)], [str(k) for k in range(1000)]]
    df = spark.createDataFrame([(k, w) for k, w in enumerate(texts)], "k int, w array<string>")
    got = {r["k"]: r["n"] for r in df.selectExpr("*").withColumn("n", quality.window_distinct(df["w"])).collect()}
    assert got == {k: sum(len(set(w[i : i + 500])) for i in range(0, len(w), 500)) for k, w in enumerate(texts)}
