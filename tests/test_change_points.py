import numpy as np
import pandas as pd
import pytest

from luxframe.config import ChangePointSettings
from luxframe.functions.critical_values import accept_value, simulate
from luxframe.functions.wlr import segment_constants, series
from luxframe.operators import change_points as cpa

S = ChangePointSettings()


def stream(seed, pieces):
    """Arrival times in ns for ``(rate per second, photons)`` pieces."""
    rng = np.random.default_rng(seed)
    gaps = np.concatenate([rng.exponential(1e9 / rate, size) for rate, size in pieces])
    return np.cumsum(gaps).astype(np.int64)


def frame(spark, streams):
    parts = [
        pd.DataFrame({"particle": name, "photon_ind": np.arange(len(t)), "abs_ns": t}) for name, t in streams.items()
    ]
    return spark.createDataFrame(pd.concat(parts, ignore_index=True))


def unbroken(times, settings=S):
    """Plain recursive walk over the whole stream, written from the segment rules."""
    total, found = len(times), []
    last = total - 1

    def split(low, high):
        hit = cpa.best_point(times[low:high], settings)
        if hit:
            found.append(low + hit[0])
            at = found[-1]
            split(low, at - 1)
            split(at, high)

    if total < 200:
        return []
    start, end = (0, 1000) if total > 1000 else (0, last)
    while True:
        split(start, end)
        fresh = bool(found) and end - 200 < found[-1] < end
        if last >= end + 800:
            if fresh:
                start, end = found[-1], min(found[-1] + 1000, last)
            else:
                start, end = end - 200, end + 800
        elif last - end >= (10 if found else 20):
            start, end = (max(found) if fresh else end - 200), last
        else:
            return sorted(set(found))


def test_series_matches_formula():
    rng = np.random.default_rng(3)
    t = np.cumsum(rng.exponential(size=120))
    n = len(t)
    ratio = series(t)
    for k in (2, 17, 60, 118):
        v = (t[k] - t[0]) / (t[-1] - t[0])
        u = lambda x: -sum(1 / j for j in range(x, n))
        q = lambda x: sum(1 / j**2 for j in range(x, n))
        raw = -2 * k * np.log(v) + 2 * k * u(k) - 2 * (n - k) * np.log(1 - v) + 2 * (n - k) * u(n - k)
        sig = np.pi**2 / 6 - sum(1 / j**2 for j in range(1, n))
        dev = np.sqrt(4 * k * k * q(k) + 4 * (n - k) ** 2 * q(n - k) - 8 * k * (n - k) * sig)
        assert ratio[k] == pytest.approx(raw / dev + 0.5 * np.log(4 * k * (n - k) / n**2))
    assert len(segment_constants(n)[0]) == n - 3


def test_known_steps_are_found(spark):
    streams = {"a": stream(1, [(2000, 1500), (8000, 4000), (500, 900)]), "b": stream(2, [(3000, 2500)])}
    got = cpa.find_change_points(frame(spark, streams)).toPandas()
    a = np.sort(got[got.particle == "a"].cpt_ind.to_numpy())
    assert len(a) == 2 and abs(a[0] - 1500) < 40 and abs(a[1] - 5500) < 40
    region = got[got.particle == "a"].sort_values("cpt_ind")
    assert (region.region_lo <= region.cpt_ind).all() and (region.region_hi >= region.cpt_ind).all()
    assert (got.particle == "b").sum() <= 1


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_chunks_give_the_unbroken_chain(spark, seed):
    rng = np.random.default_rng(seed)
    streams = {
        "quiet": stream(seed, [(1000, 9000)]),
        "busy": stream(seed + 10, [(rng.choice([500, 3000, 9000]), rng.integers(60, 900)) for _ in range(30)]),
        "late": stream(seed + 20, [(1000, 1337), (6000, 7000 + seed)]),
        "edge": stream(seed + 30, [(1000, 4000)]),
        "tail": stream(seed + 40, [(1000, 2000), (5000, 2007)]),
    }
    got = cpa.find_change_points(frame(spark, streams), chunk=2000).toPandas()
    for name, times in streams.items():
        assert sorted(got[got.particle == name].cpt_ind) == unbroken(times), name


def test_lengths_around_the_limits(spark):
    streams = {str(n): stream(n, [(200, n // 2), (9000, n - n // 2)]) for n in (1, 19, 199, 200, 1000, 1001, 1019, 2005)}
    got = cpa.find_change_points(frame(spark, streams), chunk=1000).toPandas()
    for name, times in streams.items():
        assert sorted(got[got.particle == name].cpt_ind) == unbroken(times), name
    assert not (got.particle == "199").any() and (got.particle == "200").any()


def test_constant_rate_rarely_accepted():
    rng = np.random.default_rng(5)
    gaps = rng.exponential(size=(2000, 400))
    hits = sum(cpa.best_point(t, S) is not None for t in np.cumsum(gaps, axis=1))
    assert hits / 2000 < 0.02


def test_simulation_reproduces_table(spark):
    row = simulate(spark, [100], batches=16, batch=1000).first()
    assert row.q69 == pytest.approx(accept_value(100, 69), abs=0.15)
    assert row.q95 == pytest.approx(accept_value(100, 95), abs=0.35)


def test_expression_series_matches_numpy(spark):
    t = stream(9, [(1000, 250)])
    got = cpa.segment_series(frame(spark, {"x": t}), segment=100).toPandas()
    for segment in range(3):
        part = t[segment * 100 : (segment + 1) * 100].astype(float)
        rows = got[got.segment == segment].sort_values("k")
        np.testing.assert_allclose(rows.wlr, series(part)[rows.k], rtol=1e-6, atol=1e-6)
