"""Words, lines, parsers and text output."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import wordcount
from ..sources import sinks
from ..sources.lines import expand, lines_of
from .registry import query, table

_WORDS = "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[^-a-zA-Z0-9_]')) AS word FROM documents) WHERE word <> '' GROUP BY word"


@query(f"{_WORDS} ORDER BY n DESC, word LIMIT 10")
def q01_wc_topk(spark, sf_dir):
    return wordcount.top(table(spark, sf_dir, "documents"), 10)


@query(_WORDS)
def q02_wc_counts(spark, sf_dir):
    return wordcount.counts(table(spark, sf_dir, "documents"))


@query(f"{_WORDS} ORDER BY n, word LIMIT 10")
def q03_wc_btmk(spark, sf_dir):
    return wordcount.bottom(table(spark, sf_dir, "documents"), 10)


@query(
    "SELECT doc_id, (i - 1)::INTEGER AS line_no, lines[i] AS line FROM"
    " (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))"
)
def q05_line_load(spark, sf_dir):
    return lines_of(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _keys(spark, sf_dir, separator, *columns):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(separator, *columns).alias("value"))


@query("SELECT l_orderkey::VARCHAR AS f0, l_partkey::VARCHAR AS f1, l_suppkey::VARCHAR AS f2 FROM lineitem")
def q06_parse_b(spark, sf_dir):
    lines = _keys(spark, sf_dir, "\t", "l_orderkey", "l_partkey", "l_suppkey")
    return lines.select(T.fields(F.col("value"), "\t").alias("f")).select(*[F.get("f", F.lit(k)).alias(f"f{k}") for k in range(3)])


@query("SELECT l_orderkey AS f0, l_partkey AS f1, l_suppkey AS f2 FROM lineitem")
def q07_parse_a(spark, sf_dir):
    lines = _keys(spark, sf_dir, " ", "l_orderkey", "l_partkey", "l_suppkey")
    return lines.select(T.integer_fields(F.col("value"), " ").alias("f")).select(*[F.get("f", F.lit(k)).alias(f"f{k}") for k in range(3)])


@query("SELECT l_orderkey::VARCHAR AS head, l_partkey::VARCHAR AS item_1, l_suppkey::VARCHAR AS item_2, 2 AS n_items FROM lineitem")
def q08_parse_c(spark, sf_dir):
    lines = _keys(spark, sf_dir, "\t", "l_orderkey", F.concat_ws("|", "l_partkey", "l_suppkey"), "l_linenumber")
    return lines.select(T.head_and_items(F.col("value"), "\t", "|").alias("r")).select(
        F.get("r", F.lit(0)).alias("head"), F.get("r", F.lit(1)).alias("item_1"), F.get("r", F.lit(2)).alias("item_2"), (F.size("r") - 1).alias("n_items")
    )


@query("SELECT p_partkey::VARCHAR AS id, p_retailprice AS x0, p_size::DOUBLE AS x1 FROM part")
def q09_parse_d(spark, sf_dir):
    lines = table(spark, sf_dir, "part").select(F.concat_ws("\t", "p_partkey", "p_retailprice", "p_size").alias("value"))
    return lines.select(T.head_and_numbers(F.col("value"), "\t").alias("r")).select("r.id", F.expr("r.features[0]").alias("x0"), F.expr("r.features[1]").alias("x1"))


@query("SELECT p_partkey::VARCHAR AS id, p_retailprice AS x0, p_size::DOUBLE AS x1 FROM part")
def q10_parse_e(spark, sf_dir):
    lines = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_partkey", F.concat_ws("|", "p_retailprice", "p_size")).alias("value"))
    return lines.select(T.head_and_inner_numbers(F.col("value"), " ", "|").alias("r")).select("r.id", F.expr("r.features[0]").alias("x0"), F.expr("r.features[1]").alias("x1"))


@query("SELECT user_id AS i, event_id AS j, CASE WHEN event_id % 7 = 0 THEN 3.7e0 ELSE value END AS v FROM events WHERE event_type = 'purchase'")
def q11_parse_ratings_log(spark, sf_dir):
    from ..operators.edges import ratings

    status = F.when(F.col("event_type") == "purchase", "P").otherwise("N")
    rating = F.when(F.col("event_id") % 7 == 0, F.when(F.col("event_id") % 2 == 0, "NULL").otherwise("")).otherwise(F.col("value").cast("string"))
    lines = table(spark, sf_dir, "events").select(F.concat_ws("\t", "user_id", "event_id", status, rating, F.to_date("ts").cast("string")).alias("value"))
    return ratings(lines)


_FACTORS = "SELECT s_suppkey AS id, s_suppkey % 7 AS a, s_nationkey AS b, s_suppkey * 3 AS c FROM supplier"


def _factors(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.col("s_suppkey") % 7, F.col("s_nationkey").cast("long"), F.col("s_suppkey") * 3).alias("f"))


@query(f"SELECT id || ':' || a || '|' || b || '|' || c AS value FROM ({_FACTORS})")
def q58_factor_lines(spark, sf_dir):
    return _factors(spark, sf_dir).select(sinks.factor_line(F.col("id"), F.col("f")).alias("value"))


@query(f"SELECT a || chr(9) || b || chr(9) || c AS value FROM ({_FACTORS})")
def q58b_vector_line(spark, sf_dir):
    return _factors(spark, sf_dir).select(sinks.vector_line(F.col("f")).alias("value"))


@query(f"SELECT id || ',' || k || ',' || v AS value FROM (SELECT id, unnest([0, 1, 2]) AS k, unnest([a, b, c]) AS v FROM ({_FACTORS}))")
def q59_matrix_lines(spark, sf_dir):
    cells = _factors(spark, sf_dir).select("id", F.posexplode("f").alias("k", "v"))
    return cells.select(sinks.cell_line(F.col("id"), F.col("k"), F.col("v")).alias("value"))


@query(f"SELECT a || ',' || b || ',' || c || ',' || id AS value FROM ({_FACTORS})")
def q59b_sample_lines(spark, sf_dir):
    return _factors(spark, sf_dir).select(sinks.sample_line(F.col("f"), F.col("id")).alias("value"))


@query()
def q60_expand_paths(spark, sf_dir):
    """Each Parquet file of the tables, with its name; what is there differs by place, so no SQL."""
    return expand(spark, [f"{sf_dir}/*.parquet"]).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "length")


_OFFSETS = {"yesterday": "- INTERVAL 1 DAY", "+3": "+ INTERVAL 3 DAY", "-2w": "- INTERVAL 14 DAY", "+1m": "+ INTERVAL 1 MONTH", "-1m": "- INTERVAL 1 MONTH", "+1y": "+ INTERVAL 1 YEAR"}


@query(
    " UNION ALL ".join(f"SELECT o_orderkey, '{w}' AS written, (o_orderdate::DATE {sql})::DATE AS meant FROM orders" for w, sql in _OFFSETS.items())
    + " UNION ALL SELECT o_orderkey, 'today' AS written, o_orderdate::DATE AS meant FROM orders"
    + " UNION ALL SELECT o_orderkey, '2012.2.31' AS written, DATE '2012-02-29' AS meant FROM orders"
)
def q61_relative_dates(spark, sf_dir):
    from ..functions.dates import relative_date

    words = [*_OFFSETS, "today", "2012.2.31"]
    days = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    meant = F.explode(F.array(*[F.struct(F.lit(w).alias("written"), relative_date(w, F.col("day")).alias("meant")) for w in words]))
    return days.select("o_orderkey", meant.alias("d")).select("o_orderkey", "d.*")


@query("SELECT event_id, date_trunc('second', ts) AS read FROM events")
def q61b_parsed_timestamps(spark, sf_dir):
    from ..functions.dates import parsed_timestamp

    written = F.date_format(F.col("ts").cast("timestamp"), "yyyy/MM/dd HH.mm.ss")
    return table(spark, sf_dir, "events").select("event_id", parsed_timestamp(written).cast("timestamp_ntz").alias("read"))
