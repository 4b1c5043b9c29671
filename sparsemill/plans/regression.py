"""Logistic and linear regression over samples (x array<double>, y double)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, sigmoid
from .loop import rounds, stale_rounds

Theta = list[float]


def constant(theta: Theta) -> Column:
    return F.array(*[F.lit(float(t)) for t in theta])


def probability(x: Column, theta: Theta) -> Column:
    """The dot product is written out: a few multiplications in generated code."""
    return sigmoid(linear(x, theta))


def linear(x: Column, theta: Theta) -> Column:
    z = F.get(x, F.lit(0)) * float(theta[0])
    for k in range(1, len(theta)):
        z = z + F.get(x, F.lit(k)) * float(theta[k])
    return z


def predict(samples: DataFrame, theta: Theta) -> DataFrame:
    return samples.withColumn("p", probability(F.col("x"), theta))


def loss(samples: DataFrame, theta: Theta) -> DataFrame:
    """The mean squared error of the probability, in one row."""
    return predict(samples, theta).agg(F.avg(F.pow(F.col("y") - F.col("p"), 2)).alias("loss"))


def logistic_step(samples: DataFrame, theta: Theta, alpha: float, beta: float, newest: Theta | None = None) -> Theta:
    """`newest`, else theta, plus the mean of all samples' steps at theta: alpha (y - p) x - 2 alpha beta theta, the intercept included."""
    return measured_step(samples, theta, alpha, beta, newest)[0]


def measured_step(samples: DataFrame, theta: Theta, alpha: float, beta: float, newest: Theta | None = None) -> tuple[Theta, float | None]:
    """logistic_step(), and the loss at theta, which the same pass gives; None without samples."""
    e = F.col("y") - probability(F.col("x"), theta)
    means = samples.agg(*[F.avg(e * F.get("x", F.lit(k))).alias(f"g{k}") for k in range(len(theta))], F.avg(e * e).alias("loss")).first()
    return [new + alpha * (means[k] or 0.0) - 2 * alpha * beta * t for k, (t, new) in enumerate(zip(theta, newest or theta, strict=True))], means["loss"]


def error_curve(samples: DataFrame, theta: Theta, alpha: float, beta: float, n_rounds: int, staleness: int = 0) -> tuple[Theta, DataFrame]:
    """fit_logistic(), and a row (round, loss) for the start and after each round."""
    thetas = [list(theta)]

    def step(seen: Theta, newest: Theta, _: int) -> Theta:
        thetas.append(logistic_step(samples, seen, alpha, beta, newest))
        return thetas[-1]

    last = stale_rounds(list(theta), step, n_rounds, staleness)
    # one pass more gives the errors of all rounds
    errors = samples.agg(*[F.avg(F.pow(F.col("y") - probability(F.col("x"), t), 2)).alias(f"e{k}") for k, t in enumerate(thetas)])
    return last, errors.select(F.posexplode(F.array(*[F.col(f"e{k}") for k in range(len(thetas))])).alias("round", "loss"))


def fit_logistic(samples: DataFrame, theta: Theta, alpha: float, beta: float, n_rounds: int, staleness: int = 0) -> Theta:
    """Rounds with a barrier after each: one aggregation, whose result is a row. Steps may be taken from a theta that is so many rounds old."""
    return stale_rounds(list(theta), lambda seen, newest, _: logistic_step(samples, seen, alpha, beta, newest), n_rounds, staleness)


def local_logistic(x: np.ndarray, y: np.ndarray, theta: np.ndarray, alpha: float, beta: float) -> np.ndarray:
    """theta after a step for each sample in order."""
    theta = theta.copy()
    for row, label in zip(x, y, strict=True):
        p = 1 / (1 + np.exp(-np.clip(row @ theta, -500, 500)))
        theta += alpha * (label - p) * row - 2 * alpha * beta * theta
    return theta


def fit_logistic_local(samples: DataFrame, theta: Theta, alpha: float, beta: float, n_rounds: int) -> Theta:
    """In each round every task goes through its samples one by one from a common theta, and the tasks' changes are averaged."""
    names = [f"t{k}" for k in range(len(theta))]

    def step(start: Theta, _: int) -> Theta:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            here, seen = np.array(start), False
            for f in frames:
                if len(f):
                    here, seen = local_logistic(np.stack(f["x"].to_numpy()), f["y"].to_numpy(), here, alpha, beta), True
            if seen:
                yield pd.DataFrame([here - np.array(start)], columns=names)

        deltas = samples.select("x", "y").mapInPandas(run, ", ".join(f"{c} double" for c in names)).agg(*[F.avg(c).alias(c) for c in names]).first()
        return [t + (deltas[c] or 0.0) for t, c in zip(start, names, strict=True)]

    return rounds(list(theta), step, n_rounds)


def linear_step(samples: DataFrame, theta: Theta, alpha: float) -> tuple[Theta, float]:
    """theta plus alpha times the sum of (y - theta x) x, and the squared error at theta, in one pass."""
    e = F.col("y") - linear(F.col("x"), theta)
    sums = samples.agg(*[F.sum(e * F.get("x", F.lit(k))).alias(f"g{k}") for k in range(len(theta))], F.sum(e * e).alias("sse")).first()
    return [t + alpha * (sums[k] or 0.0) for k, t in enumerate(theta)], sums["sse"] or 0.0


def fit_linear(samples: DataFrame, theta: Theta, alpha: float, least_change: float, most_rounds: int, watch: Callable[[float], object] | None = None) -> tuple[Theta, float]:
    """One step, then steps until the squared error changes by `least_change` at most, or as many as allowed. theta and the error; `watch` is told the error of each round."""
    theta, _ = linear_step(samples, theta, alpha)

    def step(state: tuple[Theta, float, Theta], _: int) -> tuple[Theta, float, Theta]:
        """theta, its error, and the theta after it."""
        after, error = linear_step(samples, state[2], alpha)
        if watch:
            watch(error)
        return state[2], error, after

    after, error = linear_step(samples, theta, alpha)
    found = rounds((theta, error, after), step, most_rounds, lambda a, b: abs(a[1] - b[1]) <= least_change)
    return found[0], found[1]


def least_mean_squares(samples: Column, theta: Column, alpha: float) -> Column:
    """theta after a pass over an array of samples (x, y) in order, where the error is computed anew after each coordinate.

    An ordered fold in one row, for the few samples of a demonstration.
    """

    def sample(t: Column, s: Column) -> Column:
        def coordinate(t: Column, k: Column) -> Column:
            change = (dot(t, s["x"]) - s["y"]) * F.get(s["x"], k) * alpha
            return F.transform(t, lambda v, i: F.when(i == k, v - change).otherwise(v))

        return F.aggregate(F.sequence(F.lit(0), F.size(t) - 1), t, coordinate)

    return F.aggregate(samples, theta, sample)
