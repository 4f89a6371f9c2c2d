"""Correlation by rank differences against all pairs, and in one crowded window."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from luxframe.operators import correlation
from luxframe.operators.rank_correlation import least_delays, observed_extent, rank_counts

PHOTONS = "particle string, channel int, abs_ns long, micro_ns double"


def table(spark, rows):
    return spark.createDataFrame([(p, c, t, 0.0) for p, c, t in rows], PHOTONS)


def plain_delays(rows, window_ns):
    out = {}
    for p in {r[0] for r in rows}:
        one = np.array([t for q, c, t in rows if q == p and c == 1], np.int64)
        two = np.array([t for q, c, t in rows if q == p and c == 2], np.int64)
        delays = (two[None, :] - one[:, None]).ravel()
        out[p] = delays[np.abs(delays) <= window_ns] * 1000
    return out


@pytest.fixture(scope="module")
def mixed():
    """One crowded and one sparse particle, one without pairs, one with a single pair; many equal times."""
    rng = np.random.default_rng(11)
    rows = [("crowd", int(c), int(t)) for c, t in zip(rng.integers(1, 3, 1500), rng.integers(0, 400, 1500), strict=True)]
    rows += [("thin", int(c), int(t)) for c, t in zip(rng.integers(1, 3, 800), rng.integers(0, 200_000, 800), strict=True)]
    rows += [("alone", 1, 5), ("alone", 1, 9), ("far", 1, 0), ("far", 2, 10_000), ("edge", 1, 0), ("edge", 2, 100)]
    return rows


def test_fixed_bins_against_all_pairs(spark, mixed):
    got = correlation.g2_fixed(table(spark, mixed), 100_000, 20).collect()
    want = {p: d for p, d in plain_delays(mixed, 100).items() if len(d)}
    assert {r["particle"] for r in got} == set(want)
    for particle, delays in want.items():
        spots = np.minimum(np.floor((delays + 100_000.0) / 10_000.0 + 1e-9), 19).astype(int)
        counts = np.bincount(spots, minlength=20).tolist()
        assert [r["counts"] for r in sorted(got, key=lambda r: r["bin"]) if r["particle"] == particle] == counts


def test_observed_bins_against_stored_delays(spark, mixed):
    photons = table(spark, mixed)
    stored = correlation.g2_histogram(correlation.g2_events(photons, 100_000), 7)
    got = correlation.g2_observed(photons, 100_000, 7)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stored.collect()))


def test_extent_across_partitions(spark, mixed):
    photons = table(spark, mixed)
    first, second = correlation.arrivals(photons, 1), correlation.arrivals(photons, 2)
    want = {p: (d.min(), d.max()) for p, d in plain_delays(mixed, 100).items() if len(d)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for width in ("1", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", width)
            got = {r["particle"]: (r["lo"], r["hi"]) for r in observed_extent(first, second, 100_000).collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_crowded_window_needs_no_pairs(spark):
    """10^5 photons in one window: 2.5 * 10^9 pairs, counted from two million ranks."""
    times = spark.range(100_000).select(
        F.lit("hot").alias("particle"), (F.col("id") % 2 + 1).cast("int").alias("channel"), (F.col("id") * 7919 % 100_003).alias("t_ps"), F.lit(1).cast("long").alias("w")
    )
    first, second = times.where("channel = 1").drop("channel"), times.where("channel = 2").drop("channel")
    edges = least_delays([-200_000.0], [200_000.0], 40)[0]
    bounds = {"lo": F.lit(-200_000.0), "hi": F.lit(200_000.0)}
    counted = rank_counts(first.withColumns(bounds), second, 40)
    got = {r["bin"]: r["counts"] for r in counted.collect()}
    ids = np.arange(100_000)
    at = ids * 7919 % 100_003
    one, two = np.sort(at[ids % 2 == 0]), np.sort(at[ids % 2 == 1])
    ranks = np.array([np.searchsorted(two, one + d).sum() for d in edges])
    assert got == {k: n for k, n in enumerate(np.diff(ranks).tolist()) if n}
    assert sum(got.values()) == 2_500_000_000
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "particle" in plan and "dt_ps" not in plan


def test_least_delays_follow_the_bin_rule():
    rng = np.random.default_rng(2)
    lo = rng.integers(-(10**16), 0, 40).astype(float)
    hi = lo + rng.integers(3, 10**16, 40)
    for bins in (1, 7, 60):
        found = least_delays(lo, hi, bins)
        width = (hi - lo) / float(bins)
        for k in range(1, bins):
            inside = np.floor((found[:, k].astype(float) - lo) / width + 1e-9)
            before = np.floor(((found[:, k] - 1).astype(float) - lo) / width + 1e-9)
            assert (inside >= k).all() and (before < k).all()


def test_empty_and_null(spark):
    empty = table(spark, [])
    assert correlation.g2_fixed(empty, 1000, 4).count() == 0 and correlation.g2_observed(empty, 1000, 4).count() == 0
    rows = [(None, 1, 0), (None, 2, 1), ("a", 1, 0), ("a", 2, 1), ("a", 2, None)]
    got = correlation.g2_fixed(table(spark, rows), 10_000, 2)
    assert {r["particle"] for r in got.where("counts > 0").collect()} == {"a"}
