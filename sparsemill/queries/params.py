"""Parameter tables, rings, clocks and collectives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clocks, collectives
from ..operators import params as P
from ..operators.ring import Ring
from .registry import COMMITS, OPERATIONS, WORKERS, commits, operations, query, table

_LAST = f"SELECT key, max(seq) AS last FROM {OPERATIONS} WHERE op <> 'inc' GROUP BY key"
#: The table after all operations.
TABLE = (
    f"(SELECT p.key, p.value + coalesce((SELECT sum(value) FROM {OPERATIONS} q WHERE q.key = p.key AND q.op = 'inc' AND q.seq > p.seq), 0) AS value"
    f" FROM {OPERATIONS} p JOIN ({_LAST}) l ON p.key = l.key AND p.seq = l.last WHERE p.op = 'push')"
)
_PUSHED = f"(SELECT key, max_by(value, seq) AS value FROM {OPERATIONS} WHERE op = 'push' GROUP BY key)"


def _pushed(spark, sf_dir):
    ops = operations(spark, sf_dir).where("op = 'push'")
    empty = spark.createDataFrame([], "key long, value double")
    return P.push(empty, ops)


def _held(spark, sf_dir):
    return P.replay(operations(spark, sf_dir))


@query(f"SELECT key, value FROM {_PUSHED}")
def q28_kv_push(spark, sf_dir):
    return _pushed(spark, sf_dir)


@query(f"SELECT p.key, round(p.value + coalesce(d.delta, 0), 4) AS value FROM {_PUSHED} p LEFT JOIN (SELECT key, sum(value) AS delta FROM {OPERATIONS} WHERE op = 'inc' GROUP BY key) d USING (key)")
def q29_kv_inc(spark, sf_dir):
    deltas = operations(spark, sf_dir).where("op = 'inc'").select("key", F.col("value").alias("delta"))
    return P.inc(_pushed(spark, sf_dir), deltas).withColumn("value", F.round("value", 4))


@query(
    "WITH f AS (SELECT label AS key, min(vec_id) AS first FROM embeddings GROUP BY label),"
    " v AS (SELECT e.label AS key, e.vec_id, k, e.embedding[k]::DOUBLE AS x FROM (SELECT *, unnest(generate_series(1, 32)) AS k FROM embeddings) e)"
    " SELECT key, (k - 1)::INTEGER AS place, round(sum(x), 4) AS x FROM v GROUP BY key, k"
)
def q29v_vec_inc(spark, sf_dir):
    """The first vector of each label is pushed, 32 elements of each other one are added: the sum has 32."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("key"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    first = rows.groupBy("key").agg(F.min(F.struct("vec_id", "x")).alias("f"))
    deltas = rows.join(first, "key").where("vec_id <> f.vec_id").select("key", F.slice("x", 1, 32).alias("delta"))
    summed = P.inc_vectors(first.select("key", F.col("f.x").alias("value")), deltas, 32)
    return summed.select("key", F.posexplode("value").alias("place", "x")).withColumn("x", F.round("x", 4))


@query(f"SELECT p.key, round(m.top - p.value, 4) AS delta, round(m.top, 4) AS value FROM {_PUSHED} p JOIN (SELECT key, max(value) AS top FROM {OPERATIONS} GROUP BY key) m USING (key)")
def q29n_inc_nodelta(spark, sf_dir):
    new = operations(spark, sf_dir).groupBy("key").agg(F.max("value").alias("value"))
    return P.inc_to(_pushed(spark, sf_dir), new).select("key", F.round("delta", 4).alias("delta"), F.round("value", 4).alias("value"))


@query(f"SELECT p.key, greatest(p.value, d.top) AS value FROM {_PUSHED} p LEFT JOIN (SELECT key, max(value) AS top FROM {OPERATIONS} WHERE op = 'inc' GROUP BY key) d USING (key)")
def q30_kv_update(spark, sf_dir):
    """A custom accumulator: the largest."""
    deltas = operations(spark, sf_dir).where("op = 'inc'").select("key", F.col("value").alias("delta"))
    return P.update(_pushed(spark, sf_dir), deltas, F.max, F.greatest)


@query(f"SELECT key, round(value, 4) AS value FROM {TABLE}")
def q31_kv_remove(spark, sf_dir):
    """Pushes, incs and removes in their order."""
    return _held(spark, sf_dir).withColumn("value", F.round("value", 4))


@query(f"SELECT key, value FROM {_PUSHED} WHERE key NOT IN (SELECT key FROM {OPERATIONS} GROUP BY key HAVING max_by(op, seq) = 'remove')")
def q31b_kv_remove_keys(spark, sf_dir):
    """The keys whose last operation is a remove go."""
    gone = operations(spark, sf_dir).groupBy("key").agg(F.max_by("op", "seq").alias("last")).where(F.col("last") == P.REMOVE)
    return P.remove(_pushed(spark, sf_dir), gone)


_ASKED = "(SELECT c_custkey AS key FROM customer)"


def _asked(spark, sf_dir):
    """All customers' keys; some have no value."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))


@query(f"SELECT r.key, round(t.value, 4) AS value FROM {_ASKED} r LEFT JOIN {TABLE} t USING (key)")
def q32_pull(spark, sf_dir):
    return P.pull(_held(spark, sf_dir), _asked(spark, sf_dir)).withColumn("value", F.round("value", 4))


@query(
    f"SELECT r.request, r.pos::INTEGER AS pos, 'p_' || r.index AS key, round(t.value, 4) AS value"
    f" FROM (SELECT o_orderkey AS request, unnest([0, 1, 2]) AS pos, unnest([o_custkey, o_orderkey, o_custkey]) AS index FROM orders) r LEFT JOIN {TABLE} t ON t.key = r.index"
)
def q33_pull_multi(spark, sf_dir):
    """Each order asks for three keys, in order."""
    held = _held(spark, sf_dir).select(F.concat(F.lit("p_"), "key").alias("key"), "value")
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), F.array("o_custkey", "o_orderkey", "o_custkey").alias("indexes"))
    return P.pull_many(held, requests, "p_").withColumn("value", F.round("value", 4))


@query(f"SELECT 'p[' || key || ',:]_4' AS parameter, key::VARCHAR AS index, round(value, 4) AS value FROM {TABLE}")
def q33t_templates(spark, sf_dir):
    """Keys from indexes by a template, and back."""
    from ..functions.text import stripped, templated

    named = _held(spark, sf_dir).select(templated("p[", F.col("key"), ",:]_4").alias("parameter"), "value")
    return named.select("parameter", stripped(F.col("parameter"), "p[", ",:]_4").alias("index"), F.round("value", 4).alias("value"))


@query(
    f"SELECT p.key, round(list_reduce(list_prepend(p.value, coalesce(d.deltas, [])), lambda a, x: a / 2 + x), 4) AS value"
    f" FROM {_PUSHED} p LEFT JOIN (SELECT key, list(value ORDER BY seq) AS deltas FROM {OPERATIONS} WHERE op = 'inc' GROUP BY key) d USING (key)"
)
def q30o_kv_update_in_order(spark, sf_dir):
    """An accumulator that goes by the order: half of what was there, and the new one."""
    deltas = operations(spark, sf_dir).where("op = 'inc'").select("key", "seq", F.col("value").alias("delta"))
    return P.update_in_order(_pushed(spark, sf_dir), deltas, lambda a, x: a / 2 + x).withColumn("value", F.round("value", 4))


@query(f"SELECT r.key, t.key IS NOT NULL AS present FROM {_ASKED} r LEFT JOIN {TABLE} t USING (key)")
def q34_contains(spark, sf_dir):
    return P.contains(_held(spark, sf_dir), _asked(spark, sf_dir))


@query(f"SELECT key, round(value, 4) AS value FROM {TABLE} WHERE value > 250")
def q35_read_all(spark, sf_dir):
    return P.read_all(_held(spark, sf_dir), F.col("value") > 250).withColumn("value", F.round("value", 4))


@query(f"SELECT key, round(value, 4) AS value FROM {TABLE} ORDER BY 2 DESC, key LIMIT 10")
def q36_read_topk(spark, sf_dir):
    return P.top(_held(spark, sf_dir).withColumn("value", F.round("value", 4)), 10)


@query(f"SELECT key, round(value, 4) AS value FROM {TABLE} WHERE value >= 1 ORDER BY 2, key LIMIT 10")
def q37_read_btmk(spark, sf_dir):
    return P.bottom(_held(spark, sf_dir).withColumn("value", F.round("value", 4)), 10, F.col("value") >= 1)


@query(f"SELECT key, CASE WHEN key % 2 = 0 THEN key + 0.5e0 ELSE value END AS value, key % 2 = 0 AS swapped FROM {_PUSHED}")
def q38_cas(spark, sf_dir):
    """Even keys come with the token of the current value, odd ones with that of another."""
    held = _pushed(spark, sf_dir)
    seen = P.gets(held.withColumn("value", F.when(F.col("key") % 2 == 0, F.col("value")).otherwise(F.col("value") + 1)))
    return P.compare_and_set(held, seen.select("key", (F.col("key") + 0.5).alias("value"), "token"))


_RING = "(SELECT md5(node || ':' || k) AS place, node FROM generate_series(0, {n}) a(node), generate_series(0, 2) b(k) WHERE node <> {without})"
_ROUTE = "(SELECT u.key, coalesce((SELECT arg_min(node, place) FROM {ring} r WHERE r.place >= md5(u.key::VARCHAR)), (SELECT arg_min(node, place) FROM {ring}))::INTEGER AS node FROM (SELECT DISTINCT user_id AS key FROM events) u)"


def _route(without):
    return _ROUTE.format(ring=_RING.format(n=3, without=without))


def _users(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key")).distinct()


@query(f"SELECT key, node FROM {_route(-1)}")
def q39_ring_route(spark, sf_dir):
    return _users(spark, sf_dir).select("key", Ring(range(4)).node_of(F.col("key")).alias("node"))


@query(
    "WITH r AS " + _RING.format(n=3, without=-1) + ", o AS (SELECT u.key, r.node, min((r.place < md5(u.key::VARCHAR))::INTEGER || r.place) AS spot FROM (SELECT DISTINCT user_id AS key FROM events) u, r GROUP BY u.key, r.node)"
    " SELECT key, (row_number() OVER (PARTITION BY key ORDER BY spot) - 1)::INTEGER AS place, node::INTEGER AS node FROM o"
)
def q40_ring_preference(spark, sf_dir):
    return _users(spark, sf_dir).select("key", F.posexplode(Ring(range(4)).preference(F.col("key"))).alias("place", "node"))


@query(f"SELECT a.key, a.node AS before, b.node AS after, a.node <> b.node AS moved FROM {_route(-1)} a JOIN {_route(2)} b USING (key)")
def q41_ring_remove(spark, sf_dir):
    ring = Ring(range(4))
    both = _users(spark, sf_dir).select("key", ring.node_of(F.col("key")).alias("before"), ring.without(2).node_of(F.col("key")).alias("after"))
    return both.withColumn("moved", F.col("before") != F.col("after"))


_CLOCKED = f"(SELECT *, row_number() OVER (PARTITION BY worker ORDER BY seq) AS clock FROM {COMMITS})"


@query(f"SELECT clock, max(seq) AS seq FROM {_CLOCKED} GROUP BY clock HAVING count(*) = {WORKERS}")
def q55_server_clock(spark, sf_dir):
    return clocks.server_clock(commits(spark, sf_dir), WORKERS)


_STALENESS = 3


@query(
    f"WITH v AS (SELECT clock AS version, (sum(sum(value)) OVER (ORDER BY clock))::BIGINT AS value FROM {_CLOCKED} GROUP BY clock)"
    f" SELECT c.worker, c.clock, greatest(c.clock - {_STALENESS}, 0) AS version, v.value FROM {_CLOCKED} c LEFT JOIN v ON v.version = greatest(c.clock - {_STALENESS}, 0)"
)
def q56_stale_read(spark, sf_dir):
    held = commits(spark, sf_dir)
    return clocks.stale_reads(clocks.committed(held).select("worker", "clock"), clocks.versions(held), _STALENESS)


@query(f"SELECT sum(n)::BIGINT AS n, round(sum(total), 4) AS total, min(n) AS least FROM (SELECT user_id % {WORKERS} AS worker, count(*) AS n, sum(value) AS total FROM events GROUP BY 1)")
def q63_allreduce(spark, sf_dir):
    partials = table(spark, sf_dir, "events").groupBy(F.pmod("user_id", F.lit(WORKERS)).alias("worker")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.count("*").alias("least"))
    return collectives.all_reduce(partials, ["n", "total"], ["least"]).withColumn("total", F.round("total", 4))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def q64_allgather_merge(spark, sf_dir):
    maps = table(spark, sf_dir, "events").groupBy(F.pmod("user_id", F.lit(WORKERS)).alias("worker"), "event_type").agg(F.count("*").alias("n"))
    return collectives.all_gather_merge(maps, "event_type", "n")


@query("SELECT event_id, row_number() OVER (ORDER BY md5('42:1:' || event_id)) - 1 AS place FROM events")
def q65_shuffle_order(spark, sf_dir):
    return collectives.shuffled(table(spark, sf_dir, "events").select("event_id"), "event_id", 42, 1)


@query()
def s01_kv_stream(spark, sf_dir):
    """The operations of q31 as a stream; the tests hold it against q31."""
    from ..streaming import table as streaming

    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a stream takes a folder or a pattern
    op = F.when(F.col("event_type") == "signup", "push").when(F.col("event_type") == "error", "remove").otherwise("inc")
    ops = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), "value")
    return streaming.run_available(spark, ops).withColumn("value", F.round("value", 4))
