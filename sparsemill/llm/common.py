"""Helpers shared by the training-data operators: reading, materialising, batching."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from ..shared import discard, materialize

__all__ = ["array_of", "crc_mod", "discard", "documents", "let", "long_sql", "map_slices", "materialize", "place_among", "small_batches"]

#: Documents handed at once to a batch function, whatever Arrow's own batch size is.
ROWS_AT_ONCE = 512


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over `value` computed once a row: higher-order functions would repeat a plain expression for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def small_batches() -> None:
    """Have Spark hand over Arrow batches of ROWS_AT_ONCE rows at most in this session.

    By default a batch has 10,000 rows, which for long texts take hundreds of MB outside the heap
    of an executor, for each of its tasks.
    """
    spark, name = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark is not None and not 0 < int(spark.conf.get(name)) <= ROWS_AT_ONCE:
        spark.conf.set(name, str(ROWS_AT_ONCE))


def map_slices(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], rows: int = ROWS_AT_ONCE):
    """A function for mapInArrow that calls `fn` on slices of at most `rows` rows, so that memory follows the slice."""

    small_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                made = fn(batch.slice(start, rows))
                if made is not None and made.num_rows:
                    yield made

    return run


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the decimal text of `key` modulo `n`: how rows are dealt to folds (a null key counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(n))


def array_of(values: list, sql: Callable[[object], str] = str) -> Column:
    """An array of constants, handed over as one text: a call for each would take longer than the query."""
    return F.expr(f"array({', '.join(map(sql, values))})")


def long_sql(value: int) -> str:
    return f"{value}L"


def place_among(key: Column, splitters: list, sql: Callable[[object], str] = long_sql) -> Column:
    """How many of the sorted `splitters` are at most `key`, natively and in the square root of their number of steps."""
    if not splitters:
        return F.lit(0)
    each = max(1, int(len(splitters) ** 0.5))
    parts = [splitters[k : k + each] for k in range(0, len(splitters), each)]
    count = lambda array: F.size(F.filter(array, lambda s: s <= key))
    rest = array_of(parts, lambda p: f"array({', '.join(map(sql, p))})")
    return let(count(array_of([p[0] for p in parts], sql)), lambda n: F.when(n == 0, 0).otherwise((n - 1) * each + count(F.element_at(rest, F.greatest(n, F.lit(1))))))
