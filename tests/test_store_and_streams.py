"""The photon store's plans, bursts over streams, SQL functions and file listings."""

import pytest
from pyspark.sql import functions as F

from luxframe.functions import sql_functions
from luxframe.operators import decay_fit
from luxframe.operators.levels import define_levels, photon_totals, photons_in_levels
from luxframe.operators.ordered import index_rows
from luxframe.sources import demo, formats, photon_store
from luxframe.streaming import bursts
from luxframe.streaming.live import photon_stream

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    df.count()
    return df._jdf.queryExecution().executedPlan().toString()


def test_levels_meet_stored_photons_without_moving_them(spark):
    photons = demo.stored_photons(spark, FOLDER)
    levels = define_levels(demo.true_change_points(photons), photon_totals(photons))
    levels = spark.createDataFrame(levels.collect(), levels.schema)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = photons_in_levels(photons.select("particle", "photon_ind", "block"), levels)
        plan = joined._jdf.queryExecution().optimizedPlan().toString(), plan_of(joined)
        assert plan[1].count("Exchange hashpartitioning") <= 1 + plan[1].count("Initial Plan")
        assert "Bucketed: true" in plan[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    fresh = index_rows(demo.photons(spark, FOLDER), ["particle"], ["abs_ns", "photon_id"], "photon_ind")
    want = sorted(map(tuple, photons_in_levels(fresh.select("particle", "photon_ind"), levels).select("particle", "photon_ind", "level_ind").collect()))
    assert sorted(map(tuple, joined.select("particle", "photon_ind", "level_ind").collect())) == want


def test_store_is_written_once_and_again_when_files_change(spark, tmp_path):
    rows = [("p", 5, 1), ("p", 3, 2), ("q", 1, 3), (None, 4, 4)]
    path = str(tmp_path / "photons")
    schema = "particle string, abs_ns long, photon_id long"
    spark.createDataFrame(rows, schema).write.parquet(path)
    source = spark.read.parquet(path)
    first = photon_store.opened(source, source)
    assert photon_store.opened(source, source).inputFiles() == first.inputFiles()
    known = {(r["particle"], r["photon_id"]): r["photon_ind"] for r in first.collect()}
    assert {k: v for k, v in known.items() if k[0]} == {("p", 2): 0, ("p", 1): 1, ("q", 3): 0}
    spark.createDataFrame([("q", 0, 5)], schema).write.mode("append").parquet(path)
    again = spark.read.parquet(path)
    second = photon_store.opened(again, again)
    assert second.inputFiles() != first.inputFiles() and second.where("particle = 'q'").count() == 2


@pytest.mark.parametrize("files_per_batch", [1, 3, 10])
def test_runs_of_a_stream_equal_those_of_the_finished_table(spark, tmp_path, files_per_batch):
    times = [k * 40_000 + k // 7 * 900_000 + k // 30 * 5_000_000 for k in range(200)]
    rows = [(p, 1, t, 0.0) for t in times for p in ("a", "b")]
    folder = str(tmp_path / "photons")
    schema = "particle string, channel int, abs_ns long, micro_ns double"
    for start in range(0, len(rows), 50):
        spark.createDataFrame(rows[start : start + 50], schema).coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([(None, 0, times[-1] + 10**12, 0.0)], schema).coalesce(1).write.mode("append").parquet(folder)
    runs = bursts.photon_runs(photon_stream(spark, folder, files_per_batch), 500, late_s=0.01)
    got = bursts.replayed(spark, runs, str(tmp_path / "out"), str(tmp_path / "state"))
    finished = bursts.photon_runs(spark.createDataFrame(rows, schema), 500)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, finished.collect()))
    assert bursts.bursts(got, 7, 400_000).count() == bursts.bursts(finished, 7, 400_000).count() > 0
    again = bursts.replayed(spark, runs, str(tmp_path / "out"), str(tmp_path / "state"))
    assert again.count() == finished.count()  # a restart from the checkpoint adds nothing


def test_functions_in_sql_text(spark):
    sql_functions.register(spark)
    sql_functions.register(spark)
    row = spark.sql("SELECT dw_bound(300D, 2, 5), dw_bound(300D, 9, 5), dw_normal_bound(300D, 3D), weighted_residual(9D, 4D)").first()
    want = spark.range(1).select(decay_fit.dw_bound(F.lit(300.0), 2, 5), decay_fit.dw_normal_bound(F.lit(300.0), 3.0)).first()
    assert (row[0], row[2]) == tuple(want) and row[1] is None and row[3] == -2.5
    mean = spark.sql("SELECT average_lifetime(array(1D, 3D), array(1D, 3D)), average_lifetime(array(1D), array(0D))").first()
    assert tuple(mean) == (2.5, None)


def test_listing_reads_names_only(spark, tmp_path):
    for name in ("a/trace1.csv", "a/b/trace2.csv", "a/trace3.txt"):
        place = tmp_path / name
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_text("x" * 9)
    listed = formats.listed_files(spark, str(tmp_path), "*.csv")
    assert sorted((r["path"].rsplit("/", 1)[1], r["length"]) for r in listed.collect()) == [("trace1.csv", 9), ("trace2.csv", 9)]
    assert "content" not in listed.columns
