"""Document fingerprints by content-defined chunking.

A gear hash of the last 32 bytes decides where a text may be cut. Below the normal size a strict
mask must be met and above it a loose one, which keeps sizes near the normal one; boundaries follow
the content, so an edit moves the chunks around it only. A fingerprint is the set of the chunks'
digests with their lengths, and likeness is containment: the share of a text's distinct chunks, by
length, that the other text has too.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import array_of, documents, long_sql, place_among, small_batches

LEAST, NORMAL, MOST = 16, 64, 255
STRICT_BITS, LOOSE_BITS = 8, 4
#: A chunk's digest and its length, in hexadecimal digits.
DIGEST_DIGITS, LENGTH_DIGITS = 10, 2


def gear_table() -> np.ndarray:
    from xxhash import xxh32_intdigest

    return np.array([xxh32_intdigest(bytes([b]), 42) for b in range(256)], np.uint32)


GEAR = None


def gear_hashes(data: bytes) -> np.ndarray:
    """The gear hash at each byte: h = 2 h + gear[byte] modulo 2**32, by doubling the window."""
    global GEAR
    if GEAR is None:
        GEAR = gear_table()
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        new = h.copy()
        new[step:] += h[:-step] << np.uint32(step)
        h = new
    return h


def boundaries(data: bytes) -> list[int]:
    """The ends of the chunks of `data`."""
    h = gear_hashes(data)
    loose = np.flatnonzero(h < 1 << (32 - LOOSE_BITS))
    strict = loose[h[loose] < 1 << (32 - STRICT_BITS)].tolist()
    loose, ends, start, n = loose.tolist(), [], 0, len(data)
    i = j = 0
    while n - start > LEAST:
        i = bisect_left(strict, start + LEAST - 1, i)
        if i < len(strict) and strict[i] < start + NORMAL - 1:
            start = strict[i] + 1
        else:
            j = bisect_left(loose, start + NORMAL - 1, j)
            most = min(start + MOST, n)
            start = loose[j] + 1 if j < len(loose) and loose[j] < most else most
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def fingerprint(data: bytes) -> str:
    """The sorted distinct chunks of a UTF-8 text, each as digest and length in hexadecimal; empty for an empty text."""
    from xxhash import xxh64_intdigest

    chunks, start = set(), 0
    for end in boundaries(data):
        chunks.add("%010x%02x" % (xxh64_intdigest(data[start:end]) >> 24, end - start))
        start = end
    return "".join(sorted(chunks))


def chunk_set(print_: str) -> set[str]:
    each = DIGEST_DIGITS + LENGTH_DIGITS
    return {print_[k : k + each] for k in range(0, len(print_), each)}


def containment(a: set[str], b: set[str]) -> float:
    """The share of a's length that is in b: 1 if both are empty, 0 if one is."""
    if not a or not b:
        return float(not a and not b)
    length = lambda chunks: sum(int(x[DIGEST_DIGITS:], 16) for x in chunks)
    return length(a & b) / length(a)


#: Bytes of text that a range holds on average at most, and keys that are drawn for each range.
RANGE_BYTES = 64 << 20
POINTS_PER_RANGE = 20

Key = tuple[int, int, int]  # doc_id, hash of the text, place


def _key_sql(key: Key | None) -> str:
    kind = "STRUCT<key: BIGINT, hash: BIGINT, place: BIGINT>"
    return f"CAST(NULL AS {kind})" if key is None else "named_struct(" + ", ".join(f"'{n}', {long_sql(v)}" for n, v in zip(("key", "hash", "place"), key, strict=True)) + ")"


def with_next(docs: DataFrame, least_partitions: int) -> DataFrame:
    """Documents dealt by ranges of doc_id and sorted in each, with the first one of the next range at the end (`ahead`).

    After the last range comes the first; a null doc_id counts as the smallest one, documents of one
    doc_id go by a hash of their texts, and equal rows by their places in the table, which must be
    the same whenever it is read, as those of files are. So ranges part rows of one doc_id too. There
    are as many ranges as the texts need, `least_partitions` at least. Only splitters and the
    smallest key of each range come to the driver.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("place"))
    keyed = docs.select(own.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    size = (F.octet_length("text") + 1).cast("long")
    total = keyed.agg(F.sum(size).alias("bytes")).first()["bytes"] or 0
    partitions = max(1, least_partitions, -(-total // RANGE_BYTES))
    chance = F.shiftrightunsigned(F.xxhash64("key.place", "key.hash"), 11) / float(2**53)
    drawn = keyed.where(chance < size * (partitions * POINTS_PER_RANGE / max(total, 1))).select("key.*")
    points = sorted(tuple(r) for r in drawn.collect())
    splitters = sorted({points[len(points) * k // partitions] for k in range(1, partitions)} if points else ())
    part = place_among(F.col("key"), splitters, _key_sql).cast("int")
    heads = {r["part"]: tuple(r["head"]) for r in keyed.groupBy(part.alias("part")).agg(F.min("key").alias("head")).collect()}
    if not heads:
        return keyed.select(F.lit(0).alias("part"), F.lit(False).alias("ahead"), "key", "doc_id", "text")
    there = sorted(heads)
    before = {p: there[k - 1] for k, p in enumerate(there)}
    every = range(len(splitters) + 1)
    at = F.col("own") + 1
    head = F.element_at(array_of([heads.get(p) for p in every], _key_sql), at)
    back = F.element_at(array_of([before.get(p, 0) for p in every]), at)
    spot = lambda part, ahead: F.struct(part.alias("part"), F.lit(ahead).alias("ahead"))
    spots = F.when(F.col("key") == head, F.array(spot(F.col("own"), False), spot(back, True))).otherwise(F.array(spot(F.col("own"), False)))
    dealt = keyed.withColumn("own", part).withColumn("spot", F.explode(spots)).select("spot.part", "spot.ahead", "key", "doc_id", "text")
    return dealt.repartitionById(len(splitters) + 1, F.col("part")).sortWithinPartitions("part", "ahead", "key")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows of with_next(): each document against its edited text and the next document, two of them at a time in memory."""
    names = [x.split()[0] for x in EDITED.split(", ")]
    made: list[tuple] = []
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), _KINDS, strict=True)], names)
    last = None  # the document that waits for its next one: part, doc_id, text, fingerprint, chunks
    for batch in batches:
        parts, ahead, ids, texts = (batch.column(k) for k in (0, 1, 3, 4))
        for k in range(batch.num_rows):
            part, is_ahead = parts[k].as_py(), ahead[k].as_py()
            if is_ahead and (last is None or last[0] != part):
                continue  # one of them is enough
            text = texts[k].as_py()
            print_ = fingerprint(text.encode())
            chunks = chunk_set(print_)
            if last is not None and last[0] == part:
                made.append(_edited(*last[1:], text, chunks))
                if len(made) == 256:
                    yield flush()
                    made.clear()
            last = None if is_ahead else (part, ids[k].as_py(), text, print_, chunks)
    if made:
        yield flush()


def _edited(doc_id: int, text: str, print_: str, chunks: set[str], after: str, after_chunks: set[str]) -> tuple:
    half = len(text) // 2
    edited = (text[: len(text) - half] + after[:half]).encode()
    edited_print = fingerprint(edited)
    return doc_id, len(text), hashlib.sha256(edited).hexdigest(), print_, edited_print, containment(chunks, chunk_set(edited_print)), containment(chunks, after_chunks)


def edited_likeness(docs: DataFrame, least_partitions: int) -> DataFrame:
    small_batches()
    return with_next(docs, least_partitions).mapInArrow(_compared, EDITED)


def op5_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how much of it the edited text and the next document contain.

    A null text is empty; empty texts have an empty fingerprint, which is contained in another
    empty one wholly and in no other; a very long text is chunked whole; a sole document is its own
    next one; documents without doc_id come first, those of one doc_id go by the hash (XXH64, seed
    42) of their texts, and repeated rows follow one another; an empty table gives no rows; other
    columns of the input are not read.
    """
    return edited_likeness(documents(spark, sf_dir), int(spark.conf.get("spark.sql.shuffle.partitions")))
