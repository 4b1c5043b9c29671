from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsemill import jobs
from sparsemill.plans import factors as MF
from sparsemill.plans import regression as R
from sparsemill.plans.loop import Algorithm, rounds

# The 5 x 7 fixture: 20 triples, where cell (1, 4) comes twice, and factors of two numbers.
TRIPLES = [
    (0, 0, 5), (0, 1, 3), (0, 3, 1), (1, 0, 4), (1, 3, 1), (2, 0, 1), (2, 1, 1), (2, 3, 5), (3, 0, 1), (3, 3, 4), (4, 1, 1), (4, 2, 5), (4, 3, 4),
]


@pytest.fixture(scope="module")
def ratings(spark):
    return spark.createDataFrame([(i, j, float(v)) for i, j, v in TRIPLES], "i long, j long, v double").cache()


def start(k=2):
    f = lambda n: np.array([[((x * 31 + e * 17) % 100) / 100 for e in range(k)] for x in range(n)])
    return f(5), f(4)


def held_of(df, n):
    found = {r["id"]: r["f"] for r in df.collect()}
    return np.array([found[x] for x in range(n)])


def test_epoch_is_mean_of_steps(spark, ratings):
    s = MF.Settings(2, 0.1, 0.02)
    users, items = MF.fit(ratings, MF.start(ratings, "i", 2), MF.start(ratings, "j", 2), s, 3)
    p, q = start()
    for _ in range(3):
        dp, dq = [[] for _ in p], [[] for _ in q]
        for i, j, v in TRIPLES:
            e = v - p[i] @ q[j]
            dp[i].append(s.alpha * (2 * e * q[j] - s.beta * p[i]))
            dq[j].append(s.alpha * (2 * e * p[i] - s.beta * q[j]))
        p, q = p + [np.mean(d, axis=0) for d in dp], q + [np.mean(d, axis=0) for d in dq]
    assert np.allclose(held_of(users, 5), p) and np.allclose(held_of(items, 4), q)
    e = np.array([v - p[i] @ q[j] for i, j, v in TRIPLES])
    assert np.isclose(MF.rmse(ratings, users, items, s).first()[0], np.sqrt((e**2).mean()))
    loss = sum(x**2 for x in e) + sum(s.beta / 2 * (p[i] @ p[i] + q[j] @ q[j]) for i, j, _ in TRIPLES)
    assert np.isclose(MF.regularised_loss(ratings, users, items, s).first()[0], loss)


def test_biases(spark, ratings):
    s = MF.Settings(2, 0.1, 0.02, biased=True, clamped=True)
    users, items = MF.epoch(ratings, MF.start(ratings, "i", 2), MF.start(ratings, "j", 2), s, 3.0)
    p, q = start()
    b = {r["id"]: r["b"] for r in users.collect()}
    for i in range(5):
        assert np.isclose(b[i], np.mean([0.1 * 2 * (v - np.clip(3 + p[a] @ q[j], 1, 5)) for a, j, v in TRIPLES if a == i]))
    pred = {(r["i"], r["j"]): r["pred"] for r in MF.predict(ratings, users, items, s, 100.0).collect()}
    assert set(pred.values()) == {5.0}


@pytest.mark.parametrize("staleness", [0, 1, 2])
def test_stale_steps(ratings, staleness):
    s = MF.Settings(2, 0.1, 0.02)
    users, items = MF.fit(ratings, MF.start(ratings, "i", 2), MF.start(ratings, "j", 2), s, 4, staleness=staleness)
    held = [start()]
    for t in range(4):
        p, q = held[max(0, t - staleness)]
        dp, dq = [[] for _ in p], [[] for _ in q]
        for i, j, v in TRIPLES:
            e = v - p[i] @ q[j]
            dp[i].append(s.alpha * (2 * e * q[j] - s.beta * p[i]))
            dq[j].append(s.alpha * (2 * e * p[i] - s.beta * q[j]))
        held.append((held[-1][0] + [np.mean(d, axis=0) for d in dp], held[-1][1] + [np.mean(d, axis=0) for d in dq]))
    assert np.allclose(held_of(users, 5), held[-1][0]) and np.allclose(held_of(items, 4), held[-1][1])


def serial_pass(triples, p, q, s, one_by_one=False, bu=None, bi=None, mean=0.0):
    for i, j, v in sorted(triples):
        found = p[i] @ q[j] + (mean + bu[i] + bi[j] if s.biased else 0)
        e = 2 * (v - (np.clip(found, 1, 5) if s.clamped else found))
        old = p[i].copy()
        p[i] = p[i] + s.alpha * (e * q[j] - s.beta * p[i])
        q[j] = q[j] + s.alpha * (e * (p[i] if one_by_one else old) - s.beta * q[j])
        if s.biased:
            bu[i] += s.alpha * (e - s.beta * bu[i])
            bi[j] += s.alpha * (e - s.beta * bi[j])


@pytest.mark.parametrize("learn", [MF.simultaneous, MF.one_after_the_other])
@pytest.mark.parametrize("biased", [False, True])
def test_grid_round_is_a_serial_pass_in_one_cell(ratings, learn, biased):
    s = MF.Settings(2, 0.05, 0.02, biased, clamped=biased)
    users, items = MF.grid_round(ratings, MF.start(ratings, "i", 2), MF.start(ratings, "j", 2), s, 1, 1, learn, mean=3.0)
    p, q = start()
    bu, bi = np.zeros(5), np.zeros(4)
    serial_pass(TRIPLES, p, q, s, learn is MF.one_after_the_other, bu, bi, 3.0)
    assert np.allclose(held_of(users, 5), p) and np.allclose(held_of(items, 4), q)
    assert np.allclose([r["b"] for r in users.orderBy("id").collect()], bu) and np.allclose([r["b"] for r in items.orderBy("id").collect()], bi)


def test_grid_round_averages_cells(ratings):
    s = MF.Settings(2, 0.05, 0.02)
    users, _ = MF.grid_round(ratings, MF.start(ratings, "i", 2), MF.start(ratings, "j", 2), s, 1, 2)
    ends = []
    for c in (0, 1):
        p, q = start()
        cell = [t for t in TRIPLES if t[1] % 2 == c]
        serial_pass(cell, p, q, s)
        ends.append((p, {t[0] for t in cell}))
    for i, f in enumerate(held_of(users, 5)):
        assert np.allclose(f, np.mean([p[i] for p, has in ends if i in has], axis=0))


def test_a_cell_passes_by_in_batches(spark, ratings):
    """A cell of 13 edges is never held whole; its batches together are one pass, in the order asked for."""
    s = MF.Settings(2, 0.05, 0.02)

    def learn(cell, s):
        assert len(cell.i) <= 4, len(cell.i)
        MF.simultaneous(cell, s)

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "4")
    try:
        users, items = MF.grid_round(ratings, MF.start(ratings, "i", 2), MF.start(ratings, "j", 2), s, 1, 1, learn, order=lambda i, j: -i * 10 + j)
        users, items = held_of(users, 5), held_of(items, 4)
    finally:
        spark.conf.set(name, before)
    p, q = start()
    for triple in sorted(TRIPLES, key=lambda t: (-t[0], t[1])):
        serial_pass([triple], p, q, s)
    assert np.allclose(users, p) and np.allclose(items, q)


def test_training_lowers_the_error(ratings):
    s = MF.Settings(4, 0.1, 0.02)
    first = MF.start(ratings, "i", 4), MF.start(ratings, "j", 4)
    before = MF.rmse(ratings, *first, s).first()[0]
    assert MF.rmse(ratings, *MF.fit(ratings, *first, s, 10), s).first()[0] < 0.8 * before


def samples(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack((np.ones(n), rng.normal(size=(n, 2))))
    y = (x @ [0.2, 1.0, -1.0] + rng.normal(size=n) * 0.1 > 0).astype(float)
    return x, y, spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y double").coalesce(1)


def test_logistic(spark):
    x, y, df = samples(spark)
    theta = np.zeros(3)
    for _ in range(4):
        p = 1 / (1 + np.exp(-x @ theta))
        theta = theta + 0.5 * ((y - p)[:, None] * x).mean(axis=0) - 2 * 0.5 * 0.01 * theta
    assert np.allclose(R.fit_logistic(df, [0.0] * 3, 0.5, 0.01, 4), theta)
    assert np.isclose(R.loss(df, theta.tolist()).first()[0], ((y - 1 / (1 + np.exp(-x @ theta))) ** 2).mean())


def test_stale_logistic(spark):
    x, y, df = samples(spark)
    held = [np.zeros(3)]
    for t in range(5):
        seen = held[max(0, t - 2)]
        p = 1 / (1 + np.exp(-x @ seen))
        held.append(held[-1] + 0.5 * ((y - p)[:, None] * x).mean(axis=0) - 2 * 0.5 * 0.01 * seen)
    assert np.allclose(R.fit_logistic(df, [0.0] * 3, 0.5, 0.01, 5, staleness=2), held[-1])


def test_local_logistic_in_one_task_is_serial(spark):
    x, y, df = samples(spark)
    theta = np.zeros(3)
    for _ in range(2):
        for a, b in zip(x, y, strict=True):
            theta = theta + 0.1 * (b - 1 / (1 + np.exp(-a @ theta))) * a - 2 * 0.1 * 0.001 * theta
    assert np.allclose(R.fit_logistic_local(df, [0.0] * 3, 0.1, 0.001, 2), theta)


def test_linear(spark):
    x, _, df = samples(spark)
    y = x @ [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y double")
    theta, sse = R.fit_linear(df, [0.0] * 3, 0.01, 1e-6, 500)
    assert np.allclose(theta, [1, 2, 3], atol=1e-2) and sse < 1e-2


def test_rounds_stop():
    seen = []
    assert rounds(0, lambda x, k: seen.append(k) or x + 1, 10, lambda a, b: b == 3) == 3 and seen == [0, 1, 2]

    class Halve(Algorithm):
        def start(self):
            return 8.0

        def step(self, state, k):
            return state / 2

        def converged(self, before, after):
            return after <= 1

    assert Halve().solve(10) == 1


@pytest.mark.parametrize("job", sorted(jobs.JOBS))
def test_jobs(spark, tmp_path, job, monkeypatch):
    text = {"wordcount": "a b a\n", "logistic": "0.5,1\n-0.5,0\n"}.get(job, "u1,i1,5\nu1,i2,3\nu2,i1,4\n")
    (tmp_path / "in.txt").write_text(text)
    (tmp_path / "c.json").write_text(json.dumps({"input": str(tmp_path / "in.txt"), "output": str(tmp_path / "out"), "k": 2, "rounds": 2}))
    monkeypatch.setattr(jobs, "session", lambda *_: spark)
    jobs.main([job, str(tmp_path / "c.json")])
    assert any((tmp_path / "out").iterdir())


def test_constant(spark):
    assert spark.range(1).select(R.constant([1, 2.5]).alias("t")).first()["t"] == [1.0, 2.5]
    assert spark.range(1).select(F.round(R.linear(R.constant([1, 2]), [3, 4]), 6).alias("z")).first()["z"] == 11


def test_the_error_is_computed_once_a_row(ratings):
    s = MF.Settings(6, 0.1, 0.02)
    users, _ = MF.epoch(ratings, MF.start(ratings, "i", 6), MF.start(ratings, "j", 6), s)
    plan = users._jdf.queryExecution().executedPlan().toString()
    steps = next(line for line in plan.split("\n") if "partial_avg" in line)
    assert "SortAggregate" not in plan and "aggregate(" not in plan and steps.count("partial_avg") == 7


def test_least_mean_squares_golden(spark):
    from sparsemill.catalog import QUERIES

    row = QUERIES["q47_lms"](spark, "").first()
    assert np.allclose(list(row), [0.0005555958509, 0.3330270461257, 0.3327612525274, 0.3325253083941], atol=1e-10)
