"""Text files as rows of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def expand(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path and length of every file that the names stand for: files, folders with all that is below them, patterns.

    A name that stands for nothing is an error, as in any scan.
    """
    names = [paths] if isinstance(paths, str) else list(paths)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(names)
    return found.select("path", "length").distinct()


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The lines of the files, in a column `value`. Spark splits files at line ends: a line belongs to the split that has its first byte, and none spans two files."""
    return spark.read.option("recursiveFileLookup", True).text([paths] if isinstance(paths, str) else list(paths))


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of `docs`, line_no from 0 and the line: what read_lines() gives for texts in a table."""
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def sample_of(line: Column, separator: str = ",") -> Column:
    """x (1.0, then all fields but the last) and y (the last field) of a line of numbers."""
    n = F.transform(F.split(line, f"\\Q{separator}\\E"), lambda s: F.trim(s).cast("double"))
    return F.struct(F.concat(F.array(F.lit(1.0)), F.slice(n, F.lit(1), F.size(n) - 1)).alias("x"), F.element_at(n, -1).alias("y"))


def read_samples(spark: SparkSession, paths: str | list[str], separator: str = ",") -> DataFrame:
    """The samples of all lines that aren't blank."""
    return read_lines(spark, paths).where(F.trim("value") != "").select(sample_of(F.col("value"), separator).alias("s")).select("s.x", "s.y")


def classification_samples(spark: SparkSession, n: int, features: int = 20, seed: int = 0) -> DataFrame:
    """Two classes of normal points around opposite centres: features (array) and label (0 or 1)."""
    label = (F.xxhash64("id", F.lit(seed)) % 2 == 0).cast("double")
    rows = spark.range(n).select("id", label.alias("label"))
    centre = lambda k: (F.col("label") * 2 - 1) * (1.0 if k % 2 else -1.0) / (1 + k)
    return rows.select(F.array(*[F.randn(seed + k) + centre(k) for k in range(features)]).alias("features"), "label")
