import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from luxframe.config import FitSettings
from luxframe.functions import decay
from luxframe.functions.decay import FitModel, Parameter
from luxframe.operators import binning, decay_fit, decay_range

WIDTH = 0.05
T = np.arange(500) * WIDTH
IRF = np.exp(-((np.arange(500) - 60) ** 2) / (2 * 4.0**2)) * 1000


def simulated(tau, amp, shift=0.0, bg=0.0, photons=300_000, seed=1):
    curve = decay.model_curve(tau, amp, shift, IRF / IRF.max(), T, 0, len(T), True, photons) + bg
    return np.random.default_rng(seed).poisson(np.maximum(curve, 0))


def fit(spark, counts, model):
    rows = [("a", T.tolist(), [int(c) for c in counts])]
    df = spark.createDataFrame(rows, "particle string, t_ns array<double>, counts array<bigint>")
    return decay_fit.fit_lifetimes(df, ["particle"], WIDTH, model, IRF.tolist()).first()


def test_one_exponential_least_squares(spark):
    out = fit(spark, simulated([3.4], [1.0], 2.3, 5), FitModel(1, shift=Parameter(0, -40, 40)))
    assert out["tau"][0] == pytest.approx(3.4, rel=0.02)
    assert out["shift_ns"] == pytest.approx(2.3 * WIDTH, abs=0.02)
    assert out["chisq"] == pytest.approx(1.0, abs=0.25) and 1.6 < out["dw"] < 2.4
    assert out["avtau"] == out["tau"][0] and out["tau_std"][0] < 0.1


def test_one_exponential_likelihood(spark):
    model = FitModel(1, "ml", shift=Parameter(0, -40, 40), start_mode="Manual", start=0, auto_end=False)
    out = fit(spark, simulated([2.0], [1.0], 1.0, 4, photons=60_000), model)
    assert out["tau"][0] == pytest.approx(2.0, rel=0.03)
    assert out["chisq"] == pytest.approx(1.0, abs=0.25)


@pytest.mark.parametrize("method", ["ls", "ml"])
def test_two_exponentials(spark, method):
    model = FitModel(
        2,
        method,
        tau=(Parameter(0.3, 0.01, 2), Parameter(5, 1, 20)),
        shift=Parameter(0, -10, 10),
        start_mode="Manual",
        start=0,
        auto_end=False,
    )
    out = fit(spark, simulated([0.5, 4.0], [0.6, 0.4], 0.0, 1, photons=2_000_000), model)
    share = np.array(out["amp"]) / sum(out["amp"])
    np.testing.assert_allclose(out["tau"], [0.5, 4.0], rtol=0.08)
    np.testing.assert_allclose(share, [0.6, 0.4], atol=0.05)
    assert out["avtau"] == pytest.approx(0.6 * 0.5 + 0.4 * 4.0, rel=0.05)


def test_three_exponentials_likelihood_keeps_amplitudes_together(spark):
    model = FitModel(3, "ml", shift=Parameter(0, -5, 5), start_mode="Manual", start=0, auto_end=False)
    out = fit(spark, simulated([0.2, 1.5, 6.0], [0.4, 0.3, 0.3], photons=3_000_000), model)
    assert sum(out["amp"]) == pytest.approx(1.0) and min(out["amp"]) >= -1e-9
    assert out["chisq"] < 1.6


def test_fixed_parameter_stays(spark):
    model = FitModel(1, tau=(Parameter(3.0, 0.01, 100, fixed=True),), shift=Parameter(0, -5, 5))
    assert fit(spark, simulated([3.4], [1.0]), model)["tau"][0] == pytest.approx(3.0, abs=2e-4)


def test_simulated_response():
    sharp = decay.gaussian_irf(0.3, WIDTH, simulated([3.0], [1.0]))
    top = simulated([3.0], [1.0])
    assert sharp.argmax() == top.argmax() and sharp.max() == top.max()
    half = np.flatnonzero(sharp > sharp.max() / 2)
    assert (half[-1] - half[0]) * WIDTH == pytest.approx(0.3, abs=2 * WIDTH)


def test_shift_is_circular_and_linear():
    curve = np.array([0.0, 4.0, 0.0, 0.0])
    assert decay.shift_circular(curve, 1).tolist() == [0, 0, 4, 0]
    assert decay.shift_circular(curve, 0.25).tolist() == [0, 3, 1, 0]
    assert decay.shift_circular(curve, -2).tolist() == [0, 0, 0, 4]
    assert decay.shift_circular(curve, -0.5).tolist() == [2, 2, 0, 0]


def test_convolution_matches_plain_sums():
    rng = np.random.default_rng(0)
    a, long = rng.random(37), rng.random(200)
    for x in (a, long):
        want = np.convolve(x, 0.9 ** np.arange(len(x)))[: len(x)]
        np.testing.assert_allclose(decay.convolved_exponential(x, 0.9), want)


def channels(spark, counts):
    return spark.createDataFrame([("a", k, float(c)) for k, c in enumerate(counts)], "particle string, ch int, counts double")


def test_smoothing_is_the_moving_average(spark):
    counts = np.random.default_rng(0).random(137)
    df = spark.createDataFrame([("a", counts.tolist())], "particle string, counts array<double>")
    short = df.select("particle", decay_range.smoothed("counts", 10).alias("counts"))
    got = [r.counts for r in decay_range.channels_of(short, ["particle"]).orderBy("ch").collect()]
    want = binning.moving_average(channels(spark, counts).withColumn("ch", F.col("ch").cast("bigint")), ["particle"], "ch", "counts", 10)
    assert got == pytest.approx([r.smooth for r in want.orderBy("ch").collect()])
    few = spark.createDataFrame([([4.0, 8.0, 0.0],)], "counts array<double>")
    assert few.select(decay_range.smoothed("counts", 10).alias("c")).first().c == [4.0, 8.0, 0.0]


def test_background_before_the_rise(spark):
    def found(counts):
        return decay_range.background(channels(spark, counts), ["particle"]).first()

    steady = found(np.r_[np.zeros(20), np.full(80, 10.0), 40, 90, 300, 900, 700, 500 * np.exp(-np.arange(200) / 40)])
    assert steady.rise_ch == 99 and steady.bg == pytest.approx(10.0)
    assert found(np.r_[np.full(60, 10.0), 100, 90, 50]).bg == pytest.approx(5.0)
    island = found(np.r_[np.zeros(5), 3, np.zeros(60), np.full(80, 2.0), 200, 900, 700 * np.exp(-np.arange(200) / 40)])
    assert island.bg == pytest.approx(2.0)
    two = found(np.r_[0, 3, np.zeros(40), 4, 0, 4, np.zeros(40), np.full(80, 2.0), 200, 900, 700 * np.exp(-np.arange(200) / 40)])
    assert two.bg == pytest.approx(2.0)
    nothing = found(np.zeros(200))
    assert (nothing.rise_ch, nothing.bg) == (0, 0.0)


def test_fit_range_modes(spark):
    counts = simulated([3.0], [1.0]).astype(float)
    df = spark.createDataFrame([("a", counts.tolist())], "particle string, counts array<double>")
    plain = FitSettings(use_moving_avg=False)

    def limits(mode="(Close to) max", start=None, end=None, auto_end=True):
        row = decay_range.fit_ranges(df, ["particle"], WIDTH, 2.0, mode, start, end, auto_end, plain).first()
        return row.first_ch, row.last_ch

    near, end = limits()
    assert counts[near] > 0.8 * counts.max() and near <= counts.argmax()
    assert end == np.flatnonzero(counts > max(40.0, 0.01 * counts.max()))[-1]
    rise, middle, safe = (limits(m)[0] for m in ("Rise start", "Rise middle", "Safe rise start"))
    assert safe <= rise <= middle <= near and middle == (rise + near) // 2
    assert limits("Manual", 7, 10_000, False) == (7, 499)
    assert limits("Manual", 7, 9, False) == (7, 17)


def test_response_background(spark):
    irf = np.r_[np.full(40, 3.0), np.linspace(5, 900, 30), np.linspace(900, 4, 30)]
    assert decay_range.response_background(channels(spark, irf), ["particle"]).first().irf_bg == pytest.approx(3.0)


def test_convolved_curve_is_the_fitted_model(spark):
    df = spark.createDataFrame([("a", T.tolist(), [1] * len(T))], "particle string, t_ns array<double>, counts array<bigint>")
    drawn = decay_range.convolved_curves(df, ["particle"], [0.5, 4.0], [0.6, 0.4], (IRF / IRF.max()).tolist(), 2.25).first().model
    want = decay.model_curve([0.5, 4.0], [0.6, 0.4], 2.25, IRF / IRF.max(), T, 0, len(T), False)
    np.testing.assert_allclose(drawn, want, rtol=1e-9, atol=1e-12)


def test_dw_bounds_fall_with_certainty():
    b5, b1, b03, b01 = decay.dw_bounds(1000, 2)
    assert 2 > b5 > b1 > b03 > b01 > 1.7
    assert b03 == pytest.approx(2 - 3 * np.sqrt(4 * 1000**2 * 998 / (1001 * 999**3)), abs=1e-3)


def test_rows_in_rows_out(spark):
    good, poor = simulated([3.0], [1.0], bg=5), np.zeros(500, dtype=int)
    poor[60] = 12
    frame = pd.DataFrame({"particle": ["a", "b", "c"], "t_ns": [T, T, T], "counts": [good, poor, np.zeros(500, dtype=int)]})
    df = spark.createDataFrame(frame, "particle string, t_ns array<double>, counts array<bigint>")
    out = {r.particle: r for r in decay_fit.fit_lifetimes(df, ["particle"], WIDTH, FitModel(1), IRF.tolist()).collect()}
    assert set(out) == {"a", "b"}  # too few photons in c
    assert out["a"].tau[0] == pytest.approx(3.0, rel=0.03) and out["a"].error is None
    assert len(out["a"].model) == out["a"].num_points
