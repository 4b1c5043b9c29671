"""Shards of near equal bytes by sampled splitters, with DataFrame functions only.

Rows are ordered by (hash of the text, doc_id, place at which they were written), so copies lie side
by side and no two rows are equal. A size-weighted sample of keys gives quantiles that cut the order
into many ranges; the exact weight of each range is counted, overfull ranges are cut again until none
of several rows is left, and the ranges go to shards, heaviest first, each into the lightest shard.
A text's copies stay in one range unless they are a notable part of the corpus; such a text is cut by
doc_id, and rows that are equal throughout by their place, so no range - and no task - depends on the
largest group of copies.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import array_of, documents, long_sql, materialize, place_among

SHARDS = 16
RANGES_PER_SHARD = 64
#: Sample points for each range, and times the mean weight at which a range is overfull.
POINTS_PER_RANGE = 16
OVERFULL = 2.0
#: A sample that finds no place to cut is drawn up to so many times as dense; what is overfull then is a row of such a size beside small ones.
MOST_DENSE = 64
LEAST_KEY = -(2**63)

Key = tuple[int, int, int]  # hash, doc_id, place


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the hash of each text and the row's place, which is fixed once the table is written; a null text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("place"))


def _row_key() -> Column:
    return F.struct(F.col("hash"), F.coalesce(F.col("doc_id"), F.lit(LEAST_KEY)).alias("id"), F.col("place"))


def _range_of(splitters: list[Key]) -> Column:
    return place_among(_row_key(), splitters, lambda k: f"named_struct('hash', {long_sql(k[0])}, 'id', {long_sql(k[1])}, 'place', {long_sql(k[2])})").cast("int")


def sample(rows: DataFrame, points: float, size: float, count: float, seed: int = 0) -> list[tuple[Key, int]]:
    """(key, points) of rows drawn by weight, `points` in all on average: half by the row's share of the bytes, half by its share of the rows."""
    weight = points / 2 * (F.col("size") / size + F.lit(1.0) / count)
    chance = F.shiftrightunsigned(F.xxhash64("place", "hash", F.lit(seed)), 11) / float(2**53)
    drawn = rows.select(_row_key().alias("key"), F.floor(weight + chance).cast("long").alias("n")).where("n > 0")
    return sorted(((r["hash"], r["id"], r["place"]), r["n"]) for r in drawn.select("key.hash", "key.id", "key.place", "n").collect())


def quantiles(points: list[tuple[Key, int]], each: int) -> list[Key]:
    """A splitter after every `each` points. Texts with few points are not cut: the splitter goes before all their copies."""
    of_text: dict[int, int] = {}
    for (hash_, *_), n in points:
        of_text[hash_] = of_text.get(hash_, 0) + n
    found, seen = set(), 0
    for key, n in points:
        if (seen + n) // each > seen // each:
            found.add(key if of_text[key[0]] >= each // 2 else (key[0], LEAST_KEY, LEAST_KEY))
        seen += n
    return sorted(found)


def weights(rows: DataFrame, splitters: list[Key]) -> dict[int, tuple[int, int]]:
    """The exact (bytes, rows) of each range: as many rows as there are ranges come to the driver."""
    found = rows.groupBy(_range_of(splitters).alias("part")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    return {r["part"]: (r["size"], r["n"]) for r in found.collect()}


def ranges(rows: DataFrame, n_ranges: int) -> tuple[list[Key], dict[int, tuple[int, int]]]:
    """Splitters and the weights of their ranges. Overfull ranges are cut at quantiles of a sample of their own, until none is left but single rows.

    A sample that finds no new place to cut is drawn anew, twice as dense, up to MOST_DENSE times.
    """
    total = rows.agg(F.sum("size").alias("size"), F.count("*").alias("n")).first()
    if not total["n"]:
        return [], {}
    splitters = quantiles(sample(rows, n_ranges * POINTS_PER_RANGE, total["size"], total["n"]), POINTS_PER_RANGE)
    held = weights(rows, splitters)
    seed = dense = 1
    while True:
        load = {p: max(size / total["size"], n / total["n"]) * n_ranges for p, (size, n) in held.items()}
        full = [p for p, x in load.items() if x > OVERFULL and held[p][1] > 1]
        if not full or dense > MOST_DENSE:
            return splitters, held
        inside = rows.where(_range_of(splitters).isin(full))
        parts = dense * sum(2 * load[p] for p in full)
        more = quantiles(sample(inside, parts * POINTS_PER_RANGE, sum(held[p][0] for p in full), sum(held[p][1] for p in full), seed), POINTS_PER_RANGE)
        seed += 1
        if set(more) <= set(splitters):
            dense *= 2
            continue
        splitters = sorted({*splitters, *more})
        held = weights(rows, splitters)


def assign(held: dict[int, tuple[int, int]], shards: int) -> dict[int, tuple[int, int]]:
    """(shard, first slot) of each range: heaviest first, into the shard with the fewest bytes, then rows."""
    heap, found = [(0, 0, s) for s in range(shards)], {}
    for part, (size, n) in sorted(held.items(), key=lambda x: (-x[1][0], x[0])):
        load, rows, shard = heapq.heappop(heap)
        found[part] = (shard, rows)
        heapq.heappush(heap, (load + size, rows + n, shard))
    return found


def shard(docs: DataFrame, shards: int = SHARDS, ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """Every document's shard, and its slot there: the range's first slot plus the rank within the range.

    A row's rank is counted within its range, which holds a bounded share of rows and bytes.
    """
    rows = materialize(sized(docs), "sized")
    splitters, held = ranges(rows, shards * ranges_per_shard)
    placed = assign(held, shards)
    every = range(len(splitters) + 1)
    look_up = lambda k, kind: F.element_at(array_of([placed.get(p, (0, 0))[k] for p in every]), F.col("part") + 1).cast(kind)
    rank = F.row_number().over(Window.partitionBy("part").orderBy("hash", "doc_id", "place"))
    return rows.withColumn("part", _range_of(splitters)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), look_up(0, "int").alias("shard"), (look_up(1, "long") + rank - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op8_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes.

    A null text is empty and has size 1; a null doc_id counts as the smallest; a very long text goes
    to one shard whole, which the lightest others make up for; equal rows go in the order in which
    they were written and take a slot each; an empty table gives no rows; other columns of the input
    are not read.
    """
    return shard(documents(spark, sf_dir))
