import pandas as pd
import pytest

from luxframe.operators.binning import bin_trace
from luxframe.streaming.live import live_trace, photon_stream


@pytest.mark.parametrize("bin_ns, gap_ns", [(2_000_000_000, 300_000_000), (2500, 700)])
def test_live_trace_equals_the_finished_trace(spark, tmp_path, bin_ns, gap_ns):
    photons = pd.DataFrame({"particle": "p", "channel": 1, "abs_ns": [i * gap_ns for i in range(200)], "micro_ns": 0.0})
    folder = str(tmp_path / "photons")
    for start in range(0, 200, 50):
        spark.createDataFrame(photons[start : start + 50]).write.mode("append").parquet(folder)
    trace = live_trace(photon_stream(spark, folder, 1), bin_ns)
    running = (
        trace.writeStream.format("memory").queryName("live").outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "state")).start()
    )
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    rows = spark.table("live").collect()
    got = {r.bin: r.counts for r in rows}
    assert len(rows) == len(got)
    want = {r.bin: r.counts for r in bin_trace(spark.createDataFrame(photons), bin_ns).collect() if r.counts}
    assert got == want


def test_final_bins_come_once_in_append_mode(spark, tmp_path):
    """Bins of 2500 ns; only bins that later photons have closed are given out, each once."""
    folder = str(tmp_path / "photons")
    photons = pd.DataFrame({"particle": "p", "channel": 1, "abs_ns": [i * 700 + i // 100 * 10**9 for i in range(400)], "micro_ns": 0.0})
    for start in range(0, 400, 100):
        spark.createDataFrame(photons[start : start + 100]).coalesce(1).write.mode("append").parquet(folder)
    trace = live_trace(photon_stream(spark, folder, 1), 2500, late_s=0.1)
    running = (
        trace.writeStream.format("memory").queryName("final").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "state")).start()
    )
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    rows = spark.table("final").collect()
    want = photons.groupby(photons["abs_ns"] // 2500).size().to_dict()
    assert rows and len({r.bin for r in rows}) == len(rows) < len(want)
    assert all(want[r.bin] == r.counts for r in rows)
