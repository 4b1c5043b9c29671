"""Line parsers and tokenisers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a rating that is missing counts as: a fixed value of the ratings-log format.
MISSING_RATING = 3.7
#: Words are runs of these; anything else, accented letters too, parts them.
WORD_BREAK = "[^-a-zA-Z0-9_]+"
#: What parts an item from its weight.
ITEM_BREAK = "[:| ]+"


def quoted(separator: str) -> str:
    """A regular expression that matches `separator` literally. One character is written so that splitting by it needs no pattern."""
    if len(separator) == 1:
        return separator if separator.isalnum() or separator.isspace() else f"\\{separator}"
    return f"\\Q{separator}\\E"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_BREAK), "")


def fields(line: Column, separator: str) -> Column:
    """The fields of a line as strings (format b). A trailing newline isn't part of the last one."""
    return F.split(F.rtrim(line, F.lit("\r\n")), quoted(separator))


def integer_fields(line: Column, separator: str) -> Column:
    """All fields as integers (format a)."""
    return F.transform(fields(line, separator), lambda x: F.trim(x).cast("long"))


def head_and_items(line: Column, separator: str, inner: str) -> Column:
    """The first field, then the parts of the second (format c); further fields are not read."""
    parts = fields(line, separator)
    return F.concat(F.slice(parts, 1, 1), F.split(F.element_at(parts, 2), quoted(inner)))


def head_and_numbers(line: Column, separator: str) -> Column:
    """The first field as id, the others as numbers (format d)."""
    parts = fields(line, separator)
    numbers = F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda x: x.cast("double"))
    return F.struct(F.element_at(parts, 1).alias("id"), numbers.alias("features"))


def head_and_inner_numbers(line: Column, separator: str, inner: str) -> Column:
    """The first field as id, the parts of the second as numbers (format e)."""
    parts = fields(line, separator)
    numbers = F.transform(F.split(F.element_at(parts, 2), quoted(inner)), lambda x: x.cast("double"))
    return F.struct(F.element_at(parts, 1).alias("id"), numbers.alias("features"))


def rating_record(line: Column, separator: str = "\t") -> Column:
    """User, subject and rating of a ratings-log line (user, subject, status, rating, time); null unless its status is P."""
    parts = fields(line, separator)
    at = lambda k: F.element_at(parts, k)
    rating = F.when(at(4).isin("NULL", ""), F.lit(MISSING_RATING)).otherwise(F.expr("CAST(NULL AS DOUBLE)"))
    value = F.coalesce(rating, F.when(~at(4).isin("NULL", ""), at(4)).cast("double"))
    return F.when(at(3) == "P", F.struct(at(1).cast("long").alias("i"), at(2).cast("long").alias("j"), value.alias("v")))


def weighted_item(item: Column) -> Column:
    """(item, weight) of `item:weight`, where colon, pipe or blank part them; the weight is 1 without one, and further parts are not read."""
    parts = F.split(item, ITEM_BREAK)
    weight = F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).cast("double")
    return F.struct(F.get(parts, F.lit(0)).alias("j"), F.coalesce(weight, F.lit(1.0)).alias("v"))


def templated(prefix: str, key: Column, suffix: str = "") -> Column:
    """A parameter's key from an index."""
    return F.concat(F.lit(prefix), key.cast("string"), F.lit(suffix))


def stripped(key: Column, prefix: str, suffix: str = "") -> Column:
    """The index in a parameter's key; null if the key doesn't have this form."""
    return F.regexp_extract(key, f"^{quoted(prefix)}(.*){quoted(suffix)}$", 1) if prefix or suffix else key
