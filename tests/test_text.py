from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sparsemill.functions import text as T
from sparsemill.functions.dates import parsed_date, parsed_timestamp, relative_date
from sparsemill.plans import wordcount
from sparsemill.sources import sinks
from sparsemill.sources.config import JobConfig
from sparsemill.sources.lines import classification_samples, expand, read_lines, read_samples


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "words"),
    [("Hello, world! foo-bar a_b  9x -- don't", ["Hello", "world", "foo-bar", "a_b", "9x", "--", "don", "t"]), ("naïve café", ["na", "ve", "caf"]), ("", []), (" .,", [])],
)
def test_words(spark, text, words):
    assert one(spark, T.words(F.col("t")), t=text) == words


def test_word_counts(spark):
    lines = spark.createDataFrame([("a b a",), ("b c",), (None,)], "text string")
    assert rows(wordcount.counts(lines)) == [("a", 2), ("b", 2), ("c", 1)]
    assert [tuple(r) for r in wordcount.top(lines, 2).collect()] == [("a", 2), ("b", 2)]
    assert [tuple(r) for r in wordcount.bottom(lines, 2).collect()] == [("c", 1), ("a", 2)]


def test_parsers(spark):
    assert one(spark, T.fields(F.col("t"), "\t"), t="a\tb\tc\n") == ["a", "b", "c"]
    assert one(spark, T.fields(F.col("t"), "|"), t="a|b") == ["a", "b"]
    assert one(spark, T.integer_fields(F.col("t"), " "), t="1 2 3") == [1, 2, 3]
    assert one(spark, T.head_and_items(F.col("t"), "\t", "|"), t="a\tb|c|d\te") == ["a", "b", "c", "d"]
    assert tuple(one(spark, T.head_and_numbers(F.col("t"), "\t"), t="id\t0.1\t0.2")) == ("id", [0.1, 0.2])
    assert tuple(one(spark, T.head_and_inner_numbers(F.col("t"), " ", "|"), t="id 0.1|0.2")) == ("id", [0.1, 0.2])


@pytest.mark.parametrize(
    ("line", "record"),
    [("12\t34\tP\tNULL\t2013-01-01", (12, 34, 3.7)), ("12\t34\tP\t\t2013-01-01", (12, 34, 3.7)), ("1\t2\tP\t5\tx", (1, 2, 5.0)), ("1\t2\tF\t5\tx", None)],
)
def test_ratings_log(spark, line, record):
    found = one(spark, T.rating_record(F.col("t")), t=line)
    assert (tuple(found) if found else None) == record


def test_weighted_item(spark):
    for item, want in (("b:0.1", ("b", 0.1)), ("b", ("b", 1.0)), ("b|2", ("b", 2.0)), ("b 3:4", ("b", 3.0))):
        assert tuple(one(spark, T.weighted_item(F.col("t")), t=item)) == want


def test_keys(spark):
    assert one(spark, T.stripped(T.templated("p[", F.col("k"), ",:]_0"), "p[", ",:]_0"), k=17) == "17"


@pytest.mark.parametrize(
    ("written", "meant"),
    [
        ("", "2024-02-29"), ("today", "2024-02-29"), ("yesterday", "2024-02-28"), ("+1y", "2025-02-28"), ("-1y", "2023-02-28"), ("+1m", "2024-03-29"),
        ("-2m", "2023-12-29"), ("+2w", "2024-03-14"), ("-3d", "2024-02-26"), ("+3", "2024-03-03"), ("2012-5-7", "2012-05-07"), ("2012.2.31", "2012-02-29"),
    ],
)
def test_relative_dates(spark, written, meant):
    assert one(spark, relative_date(written, F.col("d")), d=dt.date(2024, 2, 29)) == dt.date.fromisoformat(meant)


def test_parsed(spark):
    assert one(spark, parsed_date(F.col("t")), t="2023.2.30") == dt.date(2023, 2, 28)
    assert one(spark, parsed_timestamp(F.col("t")), t="2023/02/03 4h5") == dt.datetime(2023, 2, 3, 4, 5)


def test_files(spark, tmp_path):
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    (tmp_path / "a.txt").write_text("1\n2\n")
    (tmp_path / "sub" / "b.txt").write_text("3\n")
    (tmp_path / "sub" / "deep" / "c.txt").write_text("4")
    assert sorted(r["value"] for r in read_lines(spark, str(tmp_path)).collect()) == ["1", "2", "3", "4"]
    assert sorted(r["value"] for r in read_lines(spark, [str(tmp_path / "sub"), str(tmp_path / "*.txt")]).collect()) == ["1", "2", "3", "4"]
    assert expand(spark, str(tmp_path)).count() == 3


def test_byte_ranges_own_each_line_once(spark, tmp_path):
    lines = [f"line {k} " + "x" * (k % 37) for k in range(3000)]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = read_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 20
        assert sorted(r["value"] for r in df.collect()) == sorted(lines)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_samples(spark, tmp_path):
    (tmp_path / "s.csv").write_text("0.5,2,1\n1,3,0\n\n")
    assert rows(read_samples(spark, str(tmp_path))) == [([1.0, 0.5, 2.0], 1.0), ([1.0, 1.0, 3.0], 0.0)]
    made = classification_samples(spark, 200, 3, seed=1)
    assert made.count() == 200 and {r["label"] for r in made.collect()} == {0.0, 1.0} and len(made.first()["features"]) == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [2, 3])], "id int, f array<int>")
    sinks.write_lines(df, sinks.factor_line(F.col("id"), F.col("f")), str(tmp_path / "out"), one_file=True)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["1:2|3"]
    assert one(spark, sinks.cell_line(F.col("i"), F.col("j"), F.col("v")), i=1, j=2, v=3) == "1,2,3"
    assert one(spark, sinks.sample_line(F.col("f"), F.col("y")), f=[1, 2], y=0) == "1,2,0"


def test_config():
    assert JobConfig.parse('{"k": 7, "output": {"p": "a", "q": "b"}}').k == 7
    with pytest.raises(ValueError, match="unknown"):
        JobConfig.parse('{"alhpa": 1}')
