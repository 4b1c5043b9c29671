"""Regression and matrix factorisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import snapped
from ..plans import factors as MF
from ..plans import regression as R
from .registry import RATINGS, SAMPLES, query, ratings, samples, table

@query(f"SELECT l_orderkey, l_linenumber, x0, round(x1, 6) AS x1, x2, x3, y FROM {SAMPLES}")
def q41b_csv_samples(spark, sf_dir):
    """Samples that go through lines of numbers, label last."""
    from ..sources.lines import sample_of

    rows = samples(spark, sf_dir).select("l_orderkey", "l_linenumber", F.array_join(F.concat(F.slice("x", 2, 3), F.array("y")).cast("array<string>"), ",").alias("value"))
    parsed = rows.select("l_orderkey", "l_linenumber", sample_of(F.col("value")).alias("s"))
    return parsed.select("l_orderkey", "l_linenumber", *[F.round(F.get("s.x", F.lit(k)), 6).alias(f"x{k}") for k in range(4)], "s.y")


THETA = [0.1, -0.2, 0.3, 0.4]
ALPHA, BETA = 0.5, 0.001
_Z = "0.1e0 * x0 - 0.2e0 * x1 + 0.3e0 * x2 + 0.4e0 * x3"


@query(f"SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-({_Z}))), 6) AS p FROM {SAMPLES}")
def q42_lr_predict(spark, sf_dir):
    return R.predict(samples(spark, sf_dir), THETA).select("l_orderkey", "l_linenumber", F.round("p", 6).alias("p"))


@query(f"SELECT round(avg(pow(y - 1 / (1 + exp(-({_Z}))), 2)), 6) AS loss FROM {SAMPLES}")
def q43_lr_loss(spark, sf_dir):
    return R.loss(samples(spark, sf_dir), THETA).withColumn("loss", F.round("loss", 6))


def _thetas(n: int) -> str:
    """CTEs t1 .. tn, each the theta of a round."""
    ctes = [f"s AS {SAMPLES}", "t0 AS (SELECT 0e0 AS a0, 0e0 AS a1, 0e0 AS a2, 0e0 AS a3)"]
    for k in range(1, n + 1):
        p = "1 / (1 + exp(-(a0 * x0 + a1 * x1 + a2 * x2 + a3 * x3)))"
        ctes.append(f"t{k} AS (SELECT " + ", ".join(f"any_value(a{i}) + {ALPHA}e0 * avg((y - {p}) * x{i}) - 2 * {ALPHA}e0 * {BETA}e0 * any_value(a{i}) AS a{i}" for i in range(4)) + f" FROM s, t{k - 1})")
    return "WITH " + ", ".join(ctes) + " SELECT " + ", ".join(f"round(a{i}, 6) AS t{i}" for i in range(4)) + f" FROM t{n}"


def _row(spark, theta, digits=6):
    return spark.range(1).select(*[F.round(F.lit(float(t)), digits).alias(f"t{k}") for k, t in enumerate(theta)])


@query(_thetas(1))
def q44_lr_step(spark, sf_dir):
    return _row(spark, R.logistic_step(samples(spark, sf_dir), [0.0] * 4, ALPHA, BETA))


@query(_thetas(3))
def q45_lr_bsp(spark, sf_dir):
    return _row(spark, R.fit_logistic(samples(spark, sf_dir), [0.0] * 4, ALPHA, BETA, 3))


def _curve(n: int) -> str:
    """The loss of each round's theta."""
    loss = lambda k: f"SELECT {k} AS round, round(avg(pow(y - 1 / (1 + exp(-(a0 * x0 + a1 * x1 + a2 * x2 + a3 * x3))), 2)), 6) AS loss FROM s, t{k}"
    return _thetas(n).rsplit(" SELECT ", 1)[0] + " " + " UNION ALL ".join(map(loss, range(n + 1)))


@query(_curve(3))
def q45c_lr_error_curve(spark, sf_dir):
    """The mean squared error before the first and after each of three rounds."""
    return R.error_curve(samples(spark, sf_dir), [0.0] * 4, ALPHA, BETA, 3)[1].withColumn("loss", F.round("loss", 6))


def _linear() -> str:
    ctes = [f"s AS (SELECT x0, x1, 10 * x2 AS y FROM {SAMPLES})", "n AS (SELECT 0.5e0 / count(*) AS a FROM s)", "t0 AS (SELECT 0e0 AS a0, 0e0 AS a1)"]
    for k in range(1, 5):
        ctes.append(f"t{k} AS (SELECT " + ", ".join(f"any_value(a{i}) + any_value(a) * sum((y - (a0 * x0 + a1 * x1)) * x{i}) AS a{i}" for i in range(2)) + f" FROM s, n, t{k - 1})")
    return "WITH " + ", ".join(ctes) + " SELECT round(any_value(a0), 6) AS t0, round(any_value(a1), 6) AS t1, round(sum(pow(y - (a0 * x0 + a1 * x1), 2)), 2) AS sse FROM s, t4"


@query(_linear())
def q46_linreg_bgd(spark, sf_dir):
    """The discount from the quantity: one step, and three rounds that none ends early."""
    rows = samples(spark, sf_dir).select(F.slice("x", 1, 2).alias("x"), (F.get("x", F.lit(2)) * 10).alias("y"))
    theta, sse = R.fit_linear(rows, [0.0, 0.0], 0.5 / max(1, rows.count()), 0.0, 3)
    return _row(spark, theta).withColumn("sse", F.round(F.lit(float(sse)), 2))


@query(
    "WITH RECURSIVE f AS (SELECT 0 AS step, 0e0 AS t0, 0.33e0 AS t1, 0.33e0 AS t2, 0.33e0 AS t3 UNION ALL"
    " SELECT step + 1, CASE WHEN step % 4 = 0 THEN t0 - 0.002e0 * e ELSE t0 END, "
    + ", ".join(f"CASE WHEN step % 4 = {k} THEN t{k} - 0.002e0 * e * n ELSE t{k} END" for k in (1, 2, 3))
    + " FROM (SELECT *, t0 + t1 * n + t2 * n + t3 * n - n AS e FROM (SELECT *, step // 4 + 1 AS n FROM f WHERE step < 36)))"
    " SELECT " + ", ".join(f"round(t{k}, 10) AS t{k}" for k in range(4)) + " FROM f WHERE step = 36"
)
def q47_lms(spark, sf_dir):
    """Nine samples x = (1, n, n, n), y = n."""
    rows = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda n: F.struct(F.array(F.lit(1.0), *[n.cast("double")] * 3).alias("x"), n.cast("double").alias("y")))
    theta = R.least_mean_squares(rows, F.array(*map(F.lit, (0.0, 0.33, 0.33, 0.33))), 0.002)
    return spark.range(1).select(theta.alias("t")).select(*[F.round(F.get("t", F.lit(k)), 10).alias(f"t{k}") for k in range(4)])


@query(
    "WITH RECURSIVE n AS (SELECT 0.5e0 / count(*) AS a, avg(x0 * x0) AS m00, avg(x0 * x1) AS m01, avg(x1 * x1) AS m11, avg(x0 * y) AS c0, avg(x1 * y) AS c1, avg(y * y) AS yy, count(*) AS size"
    f" FROM (SELECT x0, x1, 10 * x2 AS y FROM {SAMPLES})),"
    " t AS (SELECT 0 AS step, 0.5e0 * c0 AS a0, 0.5e0 * c1 AS a1, 1e300 AS before FROM n UNION ALL"
    " SELECT step + 1, a0 + 0.5e0 * (c0 - m00 * a0 - m01 * a1), a1 + 0.5e0 * (c1 - m01 * a0 - m11 * a1), size * (yy - 2 * (a0 * c0 + a1 * c1) + a0 * a0 * m00 + 2 * a0 * a1 * m01 + a1 * a1 * m11)"
    " FROM t, n WHERE step < 40 AND (step = 0 OR abs(before - size * (yy - 2 * (a0 * c0 + a1 * c1) + a0 * a0 * m00 + 2 * a0 * a1 * m01 + a1 * a1 * m11)) > 0.001e0 * size))"
    " SELECT round(a0, 5) AS t0, round(a1, 5) AS t1, step AS rounds FROM t ORDER BY step DESC LIMIT 1"
)
def q46s_linreg_stop(spark, sf_dir):
    """Rounds until the squared error changes by a thousandth of the samples at most: well before the 40 that are allowed."""
    rows = samples(spark, sf_dir).select(F.slice("x", 1, 2).alias("x"), (F.get("x", F.lit(2)) * 10).alias("y"))
    n, taken = max(1, rows.count()), []
    theta, _ = R.fit_linear(rows, [0.0, 0.0], 0.5 / n, 0.001 * n, 40, taken.append)
    return _row(spark, theta, 5).withColumn("rounds", F.lit(len(taken)))


K = 4
PLAIN = MF.Settings(K, 0.005, 0.02)
BIASED = MF.Settings(K, 0.005, 0.02, biased=True, clamped=True)
MEAN = 3.0
_INIT = lambda id_, k: f"(({id_} * 31 + {k} * 17) % 100) / 100e0"
_EDGES = f"(SELECT i, j, v, {', '.join(f'{_INIT("i", k)} AS p{k}, {_INIT("j", k)} AS q{k}' for k in range(K))} FROM {RATINGS})"
_DOT = " + ".join(f"p{k} * q{k}" for k in range(K))


def _model(spark, sf_dir):
    r = ratings(spark, sf_dir)
    return r, MF.start(r, "i", K), MF.start(r, "j", K)


@query(f"SELECT round(sqrt(avg(pow(v - ({_DOT}), 2))), 6) AS rmse FROM {_EDGES}")
def q49_rmse(spark, sf_dir):
    return MF.rmse(*_model(spark, sf_dir), PLAIN).withColumn("rmse", F.round("rmse", 6))


@query(f"SELECT round(sum(pow(v - ({_DOT}), 2) + 0.01e0 * ({' + '.join(f'p{k} * p{k} + q{k} * q{k}' for k in range(K))})), 2) AS loss FROM {_EDGES}")
def q50_reg_loss(spark, sf_dir):
    return MF.regularised_loss(*_model(spark, sf_dir), PLAIN).withColumn("loss", F.round("loss", 2))


def _epoch(side: str, key: str, own: str, other: str) -> str:
    step = lambda k: f"{_INIT(key, k)} + avg(0.005e0 * (2 * (v - ({_DOT})) * {other}{k} - 0.02e0 * {own}{k}))"
    return f"SELECT '{side}' AS side, {key} AS id, " + ", ".join(f"round({step(k)}, 6) AS f{k}" for k in range(K)) + f" FROM {_EDGES} GROUP BY {key}"


def _rounded(side, name, columns=("f",)):
    return side.select(F.lit(name).alias("side"), "id", *[F.round(F.get("f", F.lit(k)), 6).alias(f"f{k}") for k in range(K)])


@query(_epoch("user", "i", "p", "q") + " UNION ALL " + _epoch("item", "j", "q", "p"))
def q51_mf_epoch(spark, sf_dir):
    users, items = MF.epoch(*_model(spark, sf_dir), PLAIN)
    return _rounded(users, "user").unionByName(_rounded(items, "item"))


def _batches(n: int) -> str:
    """The factors after an epoch over each of n batches in turn."""
    batch = f"('0x' || substr(md5('7:0:' || i || ':' || j), 1, 8))::BIGINT % {n}"
    ctes = [f"r AS (SELECT i, j, v, {batch} AS batch FROM {RATINGS})"]
    ctes += [f"{t}0 AS (SELECT DISTINCT {key} AS id, {', '.join(f'{_INIT(key, k)} AS {f}{k}' for k in range(K))} FROM r)" for t, key, f in (("u", "i", "p"), ("w", "j", "q"))]
    for b in range(n):
        ctes.append(f"e{b} AS (SELECT i, j, {', '.join(f'p{k}, q{k}' for k in range(K))}, v - ({_DOT}) AS e FROM r JOIN u{b} ON i = u{b}.id JOIN w{b} ON j = w{b}.id WHERE batch = {b})")
        for t, key, own, other in (("u", "i", "p", "q"), ("w", "j", "q", "p")):
            moved = ", ".join(f"any_value({t}{b}.{own}{k}) + coalesce(avg(0.005e0 * (2 * e * e{b}.{other}{k} - 0.02e0 * e{b}.{own}{k})), 0) AS {own}{k}" for k in range(K))
            ctes.append(f"{t}{b + 1} AS (SELECT id, {moved} FROM {t}{b} LEFT JOIN e{b} ON e{b}.{key} = id GROUP BY id)")
    side = lambda name, t, f: f"SELECT '{name}' AS side, id, {', '.join(f'round({f}{k}, 6) AS f{k}' for k in range(K))} FROM {t}{n}"
    return "WITH " + ", ".join(ctes) + " " + side("user", "u", "p") + " UNION ALL " + side("item", "w", "q")


@query(_batches(2))
def q51b_mf_batches(spark, sf_dir):
    """A round whose factors are synchronised after half of the ratings."""
    r, users, items = _model(spark, sf_dir)
    users, items = MF.fit(r, users, items, PLAIN, 1, sync_every=max(1, -(-r.count() // 2)), seed=7)
    return _rounded(users, "user").unionByName(_rounded(items, "item"))


_PRED = f"greatest(1e0, least(5e0, {MEAN}e0 + {_DOT}))"


@query(f"SELECT i, j, round({_PRED}, 6) AS pred FROM {_EDGES}")
def q52_bias_predict(spark, sf_dir):
    return MF.predict(*_model(spark, sf_dir), BIASED, MEAN).withColumn("pred", F.round("pred", 6))


@query(
    " UNION ALL ".join(f"SELECT '{side}' AS side, {key} AS id, round(avg(0.005e0 * 2 * (v - {_PRED})), 6) AS b FROM {_EDGES} GROUP BY {key}" for side, key in (("user", "i"), ("item", "j")))
)
def q53_bias_deltas(spark, sf_dir):
    """The biases after a round from none."""
    users, items = MF.epoch(*_model(spark, sf_dir), BIASED, MEAN)
    side = lambda f, name: f.select(F.lit(name).alias("side"), "id", F.round("b", 6).alias("b"))
    return side(users, "user").unionByName(side(items, "item"))


@query(
    f"SELECT i, j, round({_DOT}, 6) AS pred FROM (SELECT s_suppkey AS i, s_suppkey * 2 AS j, {', '.join(f'{_INIT("s_suppkey", k)} AS p{k}, {_INIT("(s_suppkey * 2)", k)} AS q{k}' for k in range(K))} FROM supplier"
    f" WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem) AND s_suppkey * 2 IN (SELECT l_partkey FROM lineitem))"
)
def q54_predict_pairs(spark, sf_dir):
    _, users, items = _model(spark, sf_dir)
    pairs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), (F.col("s_suppkey") * 2).alias("j"))
    return MF.predict(pairs, users, items, PLAIN).withColumn("pred", F.round("pred", 6))


@query("SELECT event_id, CASE WHEN value - floor(value) > 0.9e0 THEN ceil(value) WHEN value - floor(value) < 0.1e0 THEN floor(value) ELSE value END AS snapped FROM events")
def q57_rating_snap(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", snapped(F.col("value")).alias("snapped"))


def _cell_means() -> str:
    """Per cell of a 4 x 3 grid the mean step of each user's edges there; the mean of these."""
    step = lambda k: f"avg(0.005e0 * (2 * (v - ({_DOT})) * q{k} - 0.02e0 * p{k}))"
    inner = ", ".join(f"{step(k)} AS d{k}" for k in range(K))
    return f"SELECT i AS id, {', '.join(f'round(avg(d{k}), 6) AS d{k}' for k in range(K))} FROM (SELECT i, j % 3 AS c, {inner} FROM {_EDGES} GROUP BY i, j % 3) GROUP BY i"


@query(_cell_means())
def q66_delta_average(spark, sf_dir):
    from ..functions.vectors import avg_arrays
    from ..operators.collectives import mean_of_deltas
    from ..operators.grid import cell_of

    r, users, items = _model(spark, sf_dir)
    steps = MF.deltas(MF.with_factors(r, users, items), PLAIN)
    local = steps.groupBy(cell_of(F.col("i"), F.col("j"), 4, 3).alias("cell"), F.col("i").alias("id")).agg(avg_arrays(F.col("dp"), K).alias("delta"))
    return mean_of_deltas(local, "id", K).select("id", *[F.round(F.get("delta", F.lit(k)), 6).alias(f"d{k}") for k in range(K)])


@query()
def q67_mf_grid_round(spark, sf_dir):
    """A round in which each grid cell goes through its edges one by one; the tests hold it against a serial loop."""
    users, items = MF.grid_round(*_model(spark, sf_dir), PLAIN, 4, 3)
    return _rounded(users, "user").unionByName(_rounded(items, "item"))
