import numpy as np
import pandas as pd
import pytest

from luxframe.operators import binning


def photons(spark, abs_ns, micro=None, particle="p"):
    micro = np.zeros(len(abs_ns)) if micro is None else micro
    return spark.createDataFrame(
        pd.DataFrame({"particle": particle, "channel": 1, "abs_ns": np.asarray(abs_ns, dtype=np.int64), "micro_ns": micro})
    )


def test_trace_is_dense_and_last_bin_is_closed(spark):
    rows = binning.bin_trace(photons(spark, [0, 5, 10, 35, 40]), 10).orderBy("bin").collect()
    assert [r.counts for r in rows] == [2, 1, 0, 2]
    assert [r.t_ms for r in rows] == pytest.approx([0, 1e-5, 2e-5, 3e-5])


def test_trace_matches_numpy(spark):
    times = np.sort(np.random.default_rng(1).integers(0, 10_000, 700))
    rows = binning.bin_trace(photons(spark, times), 300).orderBy("bin").toPandas()
    edges = np.arange(0, np.ceil(times.max() / 300) * 300 + 1, 300)
    assert rows.counts.tolist() == np.histogram(times, edges)[0].tolist()


@pytest.mark.parametrize("top", [8.0, 40.0])
def test_decay_histogram_matches_numpy(spark, top):
    width = 0.5
    micro = np.random.default_rng(2).uniform(0.3, top, 900).round(3)
    counts = binning.micro_counts(photons(spark, np.arange(900), micro), ["particle"])
    got = binning.decay_histogram(counts, ["particle"], width).orderBy("ch").toPandas()
    low = min(0.0, micro.min())
    high = np.sort(micro)[np.searchsorted(np.sort(micro), max(25, micro.max())) - 1]
    want, edges = np.histogram(micro, np.arange(low, high, width))
    kept = edges[:-1] > 0
    assert got.counts.tolist() == want[kept].tolist()
    np.testing.assert_allclose(got.t_ns, edges[:-1][kept] - edges[:-1][kept].min(), atol=1e-9)


def test_channel_width_of_a_lattice(spark):
    micro = np.array([0.0, 0.5, 1.5, 2.0, 4.0, 5.5])
    counts = binning.micro_counts(photons(spark, np.arange(6), micro), ["particle"])
    assert binning.channel_width(counts, ["particle"], 9.0).first().channel_width_ns == pytest.approx(0.5)
    single = binning.micro_counts(photons(spark, [1], [0.3]), ["particle"])
    assert binning.channel_width(single, ["particle"], 9.0).first().channel_width_ns == 9.0


def test_startpoint_rules(spark):
    def decay(values):
        return pd.DataFrame({"particle": str(values)[:40], "ch": range(len(values)), "counts": values})

    long_gap = [3] + [0] * 14 + [1, 9, 20, 5]
    short_gap = [3] + [0] * 4 + [1, 9, 20, 5]
    frame = pd.concat([decay(long_gap), decay(short_gap), decay([5, 20, 4])])
    row = binning.decay_startpoint(spark.createDataFrame(frame)).first()
    # back from the peak at 17: gap starts 2 bins back, its tenth empty bin is 11 back; peak at 7: 2 back; none: 0
    assert row.start_channel == pytest.approx(((17 - 11) + (7 - 2) + 0) / 3)


def test_zero_runs_and_smoothing(spark):
    values = [0, 0, 3, 0, 0, 0, 1, 0]
    frame = pd.DataFrame({"particle": "p", "ch": range(8), "counts": values})
    frame = pd.concat([frame, pd.DataFrame({"particle": "q", "ch": range(2), "counts": [1, 2]})])
    df = spark.createDataFrame(frame)
    got = {r.particle: r.max_zeros for r in binning.max_zero_run(df, ["particle"], "ch", "counts").collect()}
    assert got == {"p": 3, "q": 0}
    smooth = binning.moving_average(df.where("particle = 'p'"), ["particle"], "ch", "counts", 3).orderBy("ch").toPandas()
    padded = np.array([0] + values + [0, 0])
    assert smooth.smooth.tolist() == pytest.approx([padded[i : i + 3].mean() for i in range(8)])
