"""Critical values of the likelihood ratio, by simulation of constant-rate photon segments.

The tables below were simulated with ``simulate`` (200 000 constant-rate segments per length for the
acceptance value, 40 000 segments with a threefold change in the middle for the region width) and
are interpolated in the logarithm of the segment length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from luxframe.functions.wlr import CONFIDENCES, series

# Segment length, then the value at 69, 90, 95 and 99 % confidence.
ACCEPT = [
    (20, 2.85, 5.46, 7.03, 10.79),
    (30, 3.00, 5.54, 7.06, 10.73),
    (50, 3.17, 5.65, 7.13, 10.72),
    (75, 3.25, 5.68, 7.15, 10.68),
    (100, 3.29, 5.66, 7.09, 10.52),
    (150, 3.38, 5.73, 7.14, 10.50),
    (200, 3.42, 5.75, 7.13, 10.52),
    (300, 3.46, 5.74, 7.09, 10.34),
    (400, 3.49, 5.74, 7.09, 10.31),
    (500, 3.50, 5.77, 7.10, 10.36),
    (700, 3.54, 5.78, 7.11, 10.26),
    (1000, 3.56, 5.77, 7.08, 10.20),
]
REGION = [
    (20, 2.75, 5.14, 6.65, 10.08),
    (30, 2.83, 5.32, 6.80, 10.19),
    (50, 2.88, 5.46, 7.02, 10.53),
    (75, 2.95, 5.60, 7.18, 10.74),
    (100, 2.98, 5.68, 7.35, 11.46),
    (150, 3.01, 5.83, 7.60, 11.40),
    (200, 3.01, 5.83, 7.57, 11.65),
    (300, 3.01, 5.89, 7.66, 11.71),
    (400, 3.04, 5.92, 7.72, 12.18),
    (500, 3.01, 5.89, 7.77, 12.12),
    (700, 3.03, 5.95, 7.75, 11.99),
    (1000, 3.03, 5.96, 7.79, 12.11),
]


def _at(table: list[tuple], n: int, confidence: int) -> float:
    column = 1 + CONFIDENCES.index(confidence)
    return float(np.interp(np.log(n), [np.log(row[0]) for row in table], [row[column] for row in table]))


def accept_value(n: int, confidence: int) -> float:
    """Smallest ratio taken as a change in a segment of ``n`` photons."""
    return _at(ACCEPT, n, confidence)


def region_value(n: int, confidence: int) -> float:
    """Drop below the maximum that still belongs to the confidence region."""
    return _at(REGION, n, confidence)


def simulate(spark: SparkSession, lengths: list[int], batches: int, batch: int = 1000, seed: int = 1) -> DataFrame:
    """Quantiles of the maximal ratio under a constant rate, trials spread over the cluster."""

    def trials(frames):
        for frame in frames:
            for n, number in zip(frame["n"], frame["id"]):
                gaps = np.random.default_rng([seed, int(n), int(number)]).exponential(size=(batch, int(n)))
                yield pd.DataFrame({"n": int(n), "peak": series(np.cumsum(gaps, axis=1)).max(axis=1)})

    lengths_column = F.array(*[F.lit(n) for n in lengths])
    jobs = spark.range(batches).withColumn("n", F.explode(lengths_column))
    peaks = jobs.repartition(spark.sparkContext.defaultParallelism).mapInPandas(trials, "n int, peak double")
    return peaks.groupBy("n").agg(
        *[F.percentile_approx("peak", c / 100).alias(f"q{c}") for c in CONFIDENCES]
    )
