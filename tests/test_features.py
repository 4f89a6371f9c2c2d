import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from luxframe.config import Bound, LevelFilter, Settings
from luxframe.operators import filtering, imaging, selection

NAN = float("nan")


@pytest.fixture(scope="module")
def levels(spark):
    rows = [
        ("ok", 200, 1000.0, 2.0, 1.9, 0.1, 1.0, 1.8),
        ("dim", 50, 1000.0, 2.0, 1.9, 0.1, 1.0, 1.8),
        ("edge", 100, 4000.0, 5.0, 1.8, 1.5, 1.3, 1.8),
        ("unfitted", 200, 1000.0, None, None, None, None, None),
        ("nan", 200, 1000.0, NAN, 1.9, 0.1, 1.0, 1.8),
    ]
    names = "level string, num_photons long, int_p_s double, av_tau double, dw double, irf_shift double, chisq double, dw_5 double"
    return spark.createDataFrame(rows, names)


RULES = LevelFilter(Bound(100), Bound(0, 4000), Bound(maximum=5), Bound(0.8, 1.3), Bound(-1.5, 1.5), "5%")


def flags(df):
    return {r.level: r.is_filtered_out for r in df.collect()}


def test_interactive_filter_fails_the_unknown(levels):
    out = filtering.filter_all(levels, RULES)
    assert flags(out) == {"ok": False, "dim": True, "edge": False, "unfitted": True, "nan": True}
    masked = {r.level: r.av_tau for r in filtering.masked_features(levels, RULES).collect()}
    assert masked == {"ok": 2.0, "dim": 2.0, "edge": 5.0, "unfitted": None, "nan": None}


def test_export_filter_null_policies(levels):
    assert flags(filtering.filter_export(levels, RULES, "pass"))["unfitted"] is False
    strict = filtering.filter_export(levels, RULES, "fail")
    assert flags(strict)["unfitted"] is True and flags(strict)["ok"] is False
    assert "failed_dw_5" in strict.columns and "failed_tau_min" not in strict.columns


def test_counts(levels):
    row = filtering.count_datapoints(levels, "av_tau", RULES).first()
    assert (row.filtered, row.unfiltered) == (3, 3)


@pytest.mark.parametrize("origin", [False, True])
def test_regression_matches_numpy(spark, origin):
    rng = np.random.default_rng(0)
    x = rng.uniform(1, 9, 60)
    y = 0.7 * x + (0 if origin else 2) + rng.normal(scale=0.3, size=60)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "x": x, "y": y}))
    row = filtering.regression(df, ["k"], "x", "y", origin).first()
    design = x[:, None] if origin else np.column_stack([x, np.ones(60)])
    coefficients, sse, _, _ = np.linalg.lstsq(design, y, rcond=None)
    errors = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * sse[0] / (60 - design.shape[1]))
    total = np.sum(y**2) if origin else np.sum((y - y.mean()) ** 2)
    assert row.slope == pytest.approx(coefficients[0]) and row.slope_err == pytest.approx(errors[0])
    assert row.r2 == pytest.approx(1 - sse[0] / total)
    assert row.intercept is None if origin else row.intercept_err == pytest.approx(errors[1])


def test_normalise_and_undo(spark):
    frame = pd.DataFrame(
        {
            "level": ["a", "b", "c", "d"],
            "num_photons": [100, 100, 100, 100],
            "dwell_s": [0.5, 0.5, 0.5, 0.5],
            "int_p_s": [200.0] * 4,
            "av_tau": [2.0, 5.0, 2.0, None],
            "is_filtered_out": [False, False, True, False],
        }
    )
    df = spark.createDataFrame(frame)
    out = {r.level: r for r in filtering.normalise(df, F.lit(0.02), F.lit(0.99)).collect()}
    assert out["a"].num_photons == 25 and out["a"].int_p_s == 50.0  # 50.5 * 0.5 = 25.25
    assert out["c"].num_photons == 100 and out["c"].is_normalized is False and out["d"].is_normalized is False
    drift = {r.level: r.num_photons for r in filtering.normalise(df, F.lit(0.02), F.lit(0.99), True).collect()}
    assert drift["a"] == 25 and drift["b"] == 100
    back = filtering.undo_normalise(filtering.normalise(df, F.lit(0.02), F.lit(0.99))).orderBy("level").toPandas()
    assert back.num_photons.tolist() == frame.num_photons.tolist() and back.int_p_s.tolist() == frame.int_p_s.tolist()


def test_half_counts_round_to_even(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0, 2.5, False), (0, 1.0, 1.0, 3.5, False)], "num_photons long, dwell_s double, int_p_s double, av_tau double, is_filtered_out boolean")
    assert sorted(r.num_photons for r in filtering.normalise(df, F.lit(1.0), F.lit(0.0)).collect()) == [2, 4]


def test_selection_text(spark):
    assert selection.parse_ranges("1-3, 7,9-") == [(1, 3), (7, 7), (9, None)]
    with pytest.raises(ValueError):
        selection.parse_ranges("3-a")
    df = spark.createDataFrame([(i, i == 2) for i in range(1, 5)], "particle_number long, selected boolean")
    picked = lambda mode: [r.particle_number for r in selection.select_particles(df, "1-2,4", mode).where("selected").orderBy("particle_number").collect()]
    assert [picked(m) for m in selection.MODES] == [[1, 2, 4], [1, 2, 4], [], [1, 4]]


def test_raster_runs(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate("AABA")], "particle_ind long, scan string")
    runs = imaging.raster_runs(df, "scan", "particle_ind").orderBy("particle_ind").collect()
    assert [r.raster_ind for r in runs] == [0, 0, 1, 2]


def test_scan_hash_ignores_row_order_but_not_content(spark):
    pixels = [(0, 0, 0, 5.0), (0, 1, 0, 6.0), (1, 1, 0, 6.0), (1, 0, 0, 5.0), (2, 0, 0, 6.0), (2, 1, 0, 5.0)]
    df = spark.createDataFrame(pixels, "particle_ind long, x int, y int, counts double")
    marks = {r.particle_ind: r.scan for r in imaging.scan_hash(df).collect()}
    assert marks[0] == marks[1] != marks[2]


def test_settings_round_trip():
    settings = Settings(open_bin_ms=50.0)
    assert Settings.from_json(settings.to_json()) == settings
    assert json.loads(settings.to_json())["change_points"]["segment"] == 1000
