"""Two-dimensional placement: the shape of a grid, and the cell of an edge or of a block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns by what they keep together: rows, columns or both; `linesplit` keeps nothing.
BY_ROW, BY_COLUMN, BY_BOTH, BY_LINE = "fmap", "smap", "fsmap", "linesplit"


def factor(n: int, row_master: bool = True) -> tuple[int, int]:
    """n as rows and columns: the largest divisor up to the root of n is the number of columns, or of rows without `row_master`; n and 1 where there is none."""
    d = next((d for d in range(int(n**0.5), 1, -1) if n % d == 0), 1)
    return (n // d, d) if row_master else (d, n // d)


def shape(n: int, pattern: str) -> tuple[int, int]:
    """The grid of n workers."""
    return {BY_COLUMN: (1, n), BY_BOTH: factor(n)}.get(pattern, (n, 1))


def shape_columns(n: Column) -> tuple[Column, Column]:
    """factor(n) of a column."""
    divisors = F.filter(F.sequence(F.lit(1), F.floor(F.sqrt(n)).cast("int")), lambda d: n % d == 0)
    d = F.array_max(divisors)
    return F.expr("1") * (n / d).cast("int"), d


def cell_of(i: Column, j: Column, rows: int, columns: int) -> Column:
    """The cell of an edge: ids that are whole numbers, or texts of such, count as they are, others by their hash. All edges of a row lie in one row of the grid."""
    return (F.pmod(whole(i), F.lit(rows)) * columns + F.pmod(whole(j), F.lit(columns))).cast("int")


def row_cells(i: Column, rows: int, columns: int) -> Column:
    """All cells that edges of a row may lie in, as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: (F.pmod(whole(i), F.lit(rows)) * columns + c).cast("int"))


def column_cells(j: Column, rows: int, columns: int) -> Column:
    """All cells that edges of a column may lie in, as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: (r * columns + F.pmod(whole(j), F.lit(columns))).cast("int"))


def whole(id_: Column) -> Column:
    """A whole number for an id of any kind."""
    return F.coalesce(id_.try_cast("string").try_cast("bigint"), F.xxhash64(id_))


def exchange(edges: DataFrame, rows: int, columns: int, i: Column | None = None, j: Column | None = None) -> DataFrame:
    """Edges with their `cell`, each cell in the partition of its number.

    For work that needs a whole cell in one task; aggregations don't, and do better without.
    """
    cell = cell_of(F.col("i") if i is None else i, F.col("j") if j is None else j, rows, columns)
    return edges.withColumn("cell", cell).repartitionById(rows * columns, F.col("cell"))


def block_of(i: Column, j: Column, n_rows: Column, n_columns: Column, a: int, b: int) -> tuple[Column, Column]:
    """The block of a cell of a dense matrix that is cut into a times b; the last blocks take what is over. A side shorter than its blocks is one block."""
    side = lambda x, n, parts: F.least(F.floor(x / F.greatest(F.floor(n / parts), F.lit(1))), F.lit(parts - 1)).cast("int")
    return side(i, n_rows, a), side(j, n_columns, b)
