"""Jobs for spark-submit: python -m sparsemill.jobs {wordcount,logistic,factors,biased-factors} CONFIG.json"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import edges as E
from .plans import factors as MF
from .plans import regression as R
from .plans import wordcount
from .session import session
from .shared import materialize
from .sources import sinks
from .sources.config import JobConfig
from .sources.edges import read_edges
from .sources.lines import read_lines, read_samples


def _output(config: JobConfig, name: str) -> str:
    return config.output[name] if isinstance(config.output, dict) else f"{config.output}/{name}"


def count_words(spark: SparkSession, config: JobConfig) -> DataFrame:
    """The k most frequent words, written as word,n lines."""
    found = wordcount.top(read_lines(spark, config.input), config.k, "value")
    if config.output:
        sinks.write_lines(found, F.concat_ws(",", "word", F.col("n").cast("string")), _output(config, "words"), one_file=True)
    return found


def logistic(spark: SparkSession, config: JobConfig) -> DataFrame:
    """theta and the loss; theta is written as one line."""
    samples = materialize(read_samples(spark, config.input), "samples")
    first = samples.first()
    if first is None:
        raise ValueError(f"{config.input} has no samples")
    theta = R.fit_logistic(samples, [0.0] * len(first["x"]), config.alpha, config.beta, config.rounds, config.limit_s)
    found = R.loss(samples, theta).withColumn("theta", R.constant(theta))
    if config.output:
        sinks.write_lines(found, sinks.vector_line(F.col("theta")), _output(config, "theta"), one_file=True)
    return found


def factorise(spark: SparkSession, config: JobConfig, biased: bool = False) -> DataFrame:
    """The error; the factors of users (p) and of items (q) are written, with biases last if there are any."""
    edges = read_edges(spark, config.input, "triple", ",").select(F.xxhash64("i").alias("i"), F.xxhash64("j").alias("j"), "v", F.col("i").alias("user"), F.col("j").alias("item"))
    edges = materialize(edges, "ratings")
    s = MF.Settings(config.k, config.alpha, config.beta, biased, clamped=biased)
    mean = E.global_mean(edges).first()["mean"] or 0.0
    users, items = MF.fit(edges.select("i", "j", "v"), MF.random_start(edges, "i", config.k, 1), MF.random_start(edges, "j", config.k, 2), s, config.rounds, mean, config.limit_s, config.sync_every)
    if config.output:
        for side, key, name, factors in (("p", "i", "user", users), ("q", "j", "item", items)):
            named = factors.join(edges.select(F.col(key).alias("id"), F.col(name).alias("name")).distinct(), "id")
            values = F.concat("f", F.array("b")) if biased else F.col("f")
            sinks.write_lines(named, sinks.factor_line(F.col("name"), values), _output(config, side))
    return MF.rmse(edges.select("i", "j", "v"), users, items, s, mean)


JOBS = {"wordcount": count_words, "logistic": logistic, "factors": factorise, "biased-factors": lambda spark, config: factorise(spark, config, biased=True)}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("job", choices=JOBS)
    parser.add_argument("config", help="a JSON file of settings")
    parser.add_argument("--master", help="where to run; spark-submit's own setting if not given")
    given = parser.parse_args(args)
    spark = session(f"sparsemill {given.job}", given.master)
    JOBS[given.job](spark, JobConfig.load(given.config)).show(truncate=False)


if __name__ == "__main__":
    main()
