"""Edges, grids, indexes, degrees and matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import edges as E
from ..operators import grid as G
from ..operators.ranks import dense_index
from .registry import RATINGS, query, ratings, table


def _pairs(spark, sf_dir, *columns):
    return table(spark, sf_dir, "lineitem").select(F.concat_ws("\t", *columns).alias("value"))


def _sets(spark, sf_dir, item):
    """A line for each order: its key and its parts, a few each."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("items")).select(F.concat_ws("\t", F.col("l_orderkey").cast("string"), "items").alias("value"))


@query("SELECT l_suppkey::VARCHAR AS i, l_partkey::VARCHAR AS j, 1e0 AS v FROM lineitem")
def q12_edges_bfs(spark, sf_dir):
    return E.adjacency_pairs(_pairs(spark, sf_dir, "l_suppkey", "l_partkey"), "\t")


@query("SELECT l_orderkey::VARCHAR AS i, l_partkey::VARCHAR AS j, 1e0 AS v FROM lineitem")
def q13_edges_fset(spark, sf_dir):
    return E.adjacency_sets(_sets(spark, sf_dir, F.col("l_partkey").cast("string")), "\t")


@query("SELECT l_suppkey::VARCHAR AS i, l_partkey::VARCHAR AS j, l_quantity AS v FROM lineitem")
def q14_edges_fs(spark, sf_dir):
    return E.weighted_pairs(_pairs(spark, sf_dir, "l_suppkey", F.concat_ws(":", "l_partkey", "l_quantity")), "\t")


@query("SELECT l_suppkey::VARCHAR AS i, l_partkey::VARCHAR AS j, l_quantity AS v FROM lineitem")
def q15_edges_fsv(spark, sf_dir):
    return E.triples(_pairs(spark, sf_dir, "l_suppkey", "l_partkey", "l_quantity"), "\t")


@query("SELECT l_orderkey::VARCHAR AS i, l_partkey::VARCHAR AS j, CASE WHEN l_linenumber % 2 = 1 THEN l_quantity ELSE 1e0 END AS v FROM lineitem")
def q16_edges_mix(spark, sf_dir):
    item = F.when(F.col("l_linenumber") % 2 == 1, F.concat_ws(":", "l_partkey", "l_quantity")).otherwise(F.col("l_partkey").cast("string"))
    return E.adjacency_sets(_sets(spark, sf_dir, item), "\t")


@query("SELECT l_orderkey, l_linenumber, ((l_suppkey % 4) * 3 + l_partkey % 3)::INTEGER AS cell FROM lineitem")
def q17_grid_route(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", G.cell_of(F.col("l_suppkey"), F.col("l_partkey"), 4, 3).alias("cell"))


@query(
    "SELECT n, (n // d)::INTEGER AS px, d::INTEGER AS py, d::INTEGER AS swapped_px, (n // d)::INTEGER AS swapped_py, n::INTEGER AS by_row, 1 AS by_row_py"
    " FROM (SELECT n, max(d) AS d FROM generate_series(1, 64) t(n), generate_series(1, 8) s(d) WHERE d * d <= n AND n % d = 0 GROUP BY n)"
)
def q18_grid_factor(spark, sf_dir):
    """The shapes of all grids, from the functions that jobs use; those of a column must be the same."""
    px, py = G.shape_columns(F.col("n"))
    shapes = [(n, *G.factor(n), *G.factor(n, row_master=False), *G.shape(n, G.BY_ROW)) for n in range(1, 65)]
    made = spark.createDataFrame(shapes, "n long, px int, py int, swapped_px int, swapped_py int, by_row int, by_row_py int")
    return made.where((F.col("px") == px) & (F.col("py") == py))


_STRINGS = "(SELECT n_name AS i, r_name AS j, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"SELECT i, j, count(*) AS n FROM {_STRINGS} GROUP BY i, j")
def q20s_exchange_strings(spark, sf_dir):
    """Edges between names go through a grid: each lies in one cell, with all edges of its row in one row of cells."""
    edges = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("i"), F.col("r_name").alias("j"))
    placed = G.exchange(edges, 4, 3)
    return placed.where((F.col("cell") >= 0) & (F.col("cell") < 12)).groupBy("i", "j").agg(F.count("*").alias("n"))


@query(
    f"WITH r AS {RATINGS}, d AS (SELECT max(i) + 1 AS m, max(j) + 1 AS n FROM r)"
    " SELECT least(i // (m // 4), 3)::INTEGER AS bi, least(j // (n // 3), 2)::INTEGER AS bj, count(*) AS n FROM r, d GROUP BY 1, 2"
)
def q19_block_id(spark, sf_dir):
    r = ratings(spark, sf_dir)
    m, n = r.agg(F.max("i") + 1, F.max("j") + 1).first()
    bi, bj = G.block_of(F.col("i"), F.col("j"), F.lit(m), F.lit(n), 4, 3)
    return r.groupBy(bi.alias("bi"), bj.alias("bj")).agg(F.count("*").alias("n"))


@query(f"SELECT ((i % 4) * 3 + j % 3)::INTEGER AS cell, count(*) AS n, count(DISTINCT i) AS n_rows FROM {RATINGS} GROUP BY 1")
def q20_exchange_counts(spark, sf_dir):
    """Counts of the exchanged cells, which as a grouping alone would need no exchange of edges."""
    return G.exchange(ratings(spark, sf_dir), 4, 3).groupBy("cell").agg(F.count("*").alias("n"), F.countDistinct("i").alias("n_rows"))


@query(
    f"SELECT 'row' AS side, (dense_rank() OVER (ORDER BY i) - 1)::BIGINT AS idx, i AS id FROM (SELECT DISTINCT i FROM {RATINGS})"
    f" UNION ALL SELECT 'column', (dense_rank() OVER (ORDER BY j) - 1)::BIGINT, j FROM (SELECT DISTINCT j FROM {RATINGS})"
)
def q21_index_map(spark, sf_dir):
    r = ratings(spark, sf_dir)
    side = lambda column, name: dense_index(r, column).select(F.lit(name).alias("side"), "idx", F.col(column).alias("id"))
    return side("i", "row").unionByName(side("j", "column"))


@query(f"SELECT i, count(*) AS degree FROM {RATINGS} GROUP BY i")
def q22_row_degree(spark, sf_dir):
    return E.row_degrees(ratings(spark, sf_dir))


@query(f"SELECT j, count(*) AS degree FROM {RATINGS} GROUP BY j")
def q23_col_degree(spark, sf_dir):
    return E.column_degrees(ratings(spark, sf_dir))


@query(f"SELECT count(DISTINCT i) AS n_rows, count(DISTINCT j) AS n_cols FROM {RATINGS}")
def q24_dims(spark, sf_dir):
    return E.dims(ratings(spark, sf_dir))


@query(f"SELECT i, j, round(sum(v), 6) AS v FROM {RATINGS} GROUP BY i, j")
def q25_coo_matrix(spark, sf_dir):
    return E.matrix(ratings(spark, sf_dir)).withColumn("v", F.round("v", 6))


@query(f"SELECT i, j, round(avg(v), 6) AS v FROM {RATINGS} GROUP BY i, j")
def q25b_mean_cells(spark, sf_dir):
    return E.mean_by_cell(ratings(spark, sf_dir)).withColumn("v", F.round("v", 6))


@query("SELECT vec_id AS id, (k - 1)::INTEGER AS place, round(embedding[k]::DOUBLE, 6) AS x FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS k FROM embeddings)")
def q26_dense_rows(spark, sf_dir):
    rows = E.dense_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return rows.select("id", F.posexplode("features").alias("place", "x")).withColumn("x", F.round("x", 6))


@query(f"SELECT round(sum(v) / count(v), 8) AS mean FROM {RATINGS}")
def q27_global_mean(spark, sf_dir):
    return E.global_mean(ratings(spark, sf_dir)).withColumn("mean", F.round("mean", 8))


@query(
    "SELECT e.vec_id, round(list_sum(list_transform(generate_series(1, len(e.embedding)), lambda k: e.embedding[k]::DOUBLE * f.embedding[k]::DOUBLE)), 5) AS dot"
    " FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) f"
)
def q48_dot(spark, sf_dir):
    rows = E.dense_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    first = rows.orderBy("id").select("features").first()["features"]
    return rows.select(F.col("id").alias("vec_id"), F.round(V.dot(F.col("features"), F.array(*map(F.lit, first))), 5).alias("dot"))


@query(
    "WITH c AS (SELECT vec_id AS i, k - 1 AS j, embedding[k]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS k FROM embeddings)),"
    " w AS (SELECT j, m, ((j * 31 + m * 17) % 100) / 100e0 AS v FROM generate_series(0, 63) a(j), generate_series(0, 3) b(m))"
    " SELECT c.i, w.m::INTEGER AS j, round(sum(c.v * w.v), 5) AS v FROM c JOIN w USING (j) GROUP BY c.i, w.m"
)
def q62_matmul(spark, sf_dir):
    """All vectors, of 64 places, by a matrix of 64 x 4."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    weights = spark.range(64).select(F.col("id").cast("int").alias("i"), F.posexplode(F.array(*[(F.pmod(F.col("id") * 31 + m * 17, F.lit(100)) / 100.0) for m in range(4)])).alias("j", "v"))
    return V.matmul(V.cells(vectors, "vec_id", "x"), weights).withColumn("v", F.round("v", 5))
