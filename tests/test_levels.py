import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from luxframe.config import BurstSettings
from luxframe.operators import bursts, levels, roi


def level_frame(spark, ints, dwell=None, flags=None):
    n = len(ints)
    dwell = np.full(n, 1.0) if dwell is None else np.asarray(dwell, dtype=float)
    ends = np.cumsum(dwell)
    frame = pd.DataFrame(
        {
            "particle": "p",
            "level_ind": range(n),
            "int_p_s": np.asarray(ints, dtype=float),
            "dwell_s": dwell,
            "start_s": ends - dwell,
            "end_s": ends,
            "num_photons": (np.asarray(ints) * dwell).astype(int),
        }
    )
    if flags is not None:
        frame["is_burst"] = list(flags)
    return spark.createDataFrame(frame)


def test_define_levels(spark):
    cpts = spark.createDataFrame([("p", 100), ("p", 250), ("p", 400), ("q", 60)], "particle string, cpt_ind long")
    totals = spark.createDataFrame([("p", 500), ("q", 90), ("r", 70)], "particle string, num_photons long")
    plain = [(r.particle, r.first_ind, r.last_ind) for r in levels.define_levels(cpts, totals).orderBy("particle", "first_ind").collect()]
    assert plain == [("p", 0, 99), ("p", 100, 249), ("p", 250, 399), ("p", 400, 499), ("q", 0, 59), ("q", 60, 89), ("r", 0, 69)]
    shared = levels.define_levels(cpts, totals, overlapping=True).orderBy("particle", "first_ind").collect()
    assert [(r.first_ind, r.last_ind) for r in shared if r.particle == "p"] == [(0, 99), (100, 250), (250, 399), (400, 499)]
    assert [(r.first_ind, r.last_ind) for r in shared if r.particle == "q"] == [(0, 59), (60, 89)]


def test_level_stats_add_up(spark):
    t = np.cumsum(np.random.default_rng(0).integers(1, 9, 300)) * 1_000_000
    photons = spark.createDataFrame(pd.DataFrame({"particle": "p", "photon_ind": range(300), "abs_ns": t}))
    cpts = spark.createDataFrame([("p", 100), ("p", 101)], "particle string, cpt_ind long")
    got = levels.level_stats(photons, levels.define_levels(cpts, levels.photon_totals(photons))).orderBy("level_ind").toPandas()
    assert got.num_photons.tolist() == [100, 1, 199] and got.num_photons.sum() == 300
    assert got.dwell_s[0] == pytest.approx((t[99] - t[0]) / 1e9)
    assert got.int_p_s.isna().tolist() == [False, True, False]


def removed_by_walk(ints, flags):
    """Borders removed when bursts are taken from the last to the first, on a plain list."""
    borders, top = list(range(len(ints) - 1)), len(ints) - 1
    for b in reversed([i for i, f in enumerate(flags) if f]):
        if b == top:
            left = True
        elif b == 0:
            left = False
        else:
            left = not ints[b + 1] > ints[b - 1]
        if left:
            del borders[b - 1]
            top -= 1
        else:
            del borders[b]
    return borders


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.lists(st.tuples(st.integers(1, 9), st.booleans()), min_size=2, max_size=14))
def test_burst_removal_matches_the_sequential_walk(spark, data):
    ints, flags = [d[0] for d in data], [d[1] for d in data]
    if all(flags):
        flags[len(flags) // 2] = False
    borders = removed_by_walk(ints, flags)
    want, run = [], 0
    for i in range(len(ints)):
        want.append(run)
        run += i in borders
    got = bursts.burst_merges(level_frame(spark, ints, flags=flags)).orderBy("level_ind").toPandas()
    assert got.merged_ind.tolist() == want


def test_burst_removal_moves_levels_once(spark):
    """Levels meet their borders in one order instead of joins by position; their columns stay."""
    df = level_frame(spark, [5, 9, 1, 8], flags=[False, True, False, True]).select("particle", "level_ind", "int_p_s", "num_photons", "is_burst")
    merged = bursts.burst_merges(df)
    assert merged.columns == [*df.columns, "merged_ind"]
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "level_ind" in line]
    assert [r.merged_ind for r in merged.orderBy("level_ind").collect()] == [0, 0, 1, 1]


def test_detect_bursts(spark):
    df = level_frame(spark, [100, 9000, 100, 120], [1, 0.0005, 2, 1])
    found = bursts.detect_bursts(df, BurstSettings()).orderBy("level_ind").toPandas()
    assert found.is_burst.tolist() == [False, True, False, False]
    fixed = bursts.detect_bursts(df, BurstSettings(use_sigma=False, absolute_int=9000)).toPandas()
    assert not fixed.is_burst.any()


def test_trim_trace(spark):
    bright = level_frame(spark, [900, 800, 950, 20, 10], [1, 1, 1, 2, 4])
    row = roi.trim_trace(bright, 5.0, 400).first()
    assert row.trimmed is True and row.roi_end_s == 3.0 and row.roi_last_level == 2 and row.tail_s == 6.0
    assert roi.trim_trace(bright, 7.0, 400).first().trimmed is False
    assert roi.trim_trace(level_frame(spark, [900, 800, 950]), 1.0, 400).first().trimmed is None
    assert roi.trim_trace(level_frame(spark, [900, 20, 10]), 1.0, 400).first().trimmed is False
    region = spark.createDataFrame([("p", 2.8, 9.0)], "particle string, roi_start_s double, roi_end_s double")
    kept = roi.trim_trace(bright, 5.0, 400, region).first()
    assert kept.roi_start_s == pytest.approx(2.5) and kept.roi_end_s == 3.0


def test_roi_beyond_the_trace_is_clamped(spark):
    photons = spark.createDataFrame(
        pd.DataFrame({"particle": "p", "photon_ind": range(10), "abs_ns": np.arange(10) * 1_000_000_000})
    )
    region = spark.createDataFrame([("p", 2.5, 99.0)], "particle string, roi_start_s double, roi_end_s double")
    row = roi.photon_bounds(photons, region).first()
    assert (row.first_photon, row.last_photon) == (3, 9)
    whole = spark.createDataFrame([("p", 0.01, 9.02)], "particle string, roi_start_s double, roi_end_s double")
    assert tuple(roi.photon_bounds(photons, whole).first())[1:] == (0, 9)


def test_levels_in_roi_edges(spark):
    df = level_frame(spark, [1, 2, 3, 4], [1, 1, 1, 1])
    region = spark.createDataFrame([("p", 1.0, 2.9996)], "particle string, roi_start_s double, roi_end_s double")
    assert [r.level_ind for r in roi.levels_in_roi(df, region).orderBy("level_ind").collect()] == [1, 2]
    assert [r.level_ind for r in roi.levels_in_roi(df, region, last_included=False).collect()] == [1]
