"""Whole analyses: all tables or none."""

import os

import pytest
from pyspark.sql import functions as F

from luxframe.sources import snapshot


@pytest.fixture
def tables(spark):
    levels = spark.range(1000).select(F.concat(F.lit("p"), F.col("id") % 3).alias("particle"), "id", (F.col("id") / 7).alias("int p_s"))
    return {"levels": levels, "empty": levels.where("id < 0"), "none": levels.limit(0), "odd": spark.createDataFrame([(None, [1]), (None, [1]), ("x", None)], "a string, b array<int>")}


def facts(spark, folder, number=None):
    return {r.saved: (r.n, r.verified) for r in snapshot.verified(spark, folder, number).collect()}


def test_round_trip_and_older_snapshots(spark, tmp_path, tables):
    folder = str(tmp_path / "a")
    assert snapshot.save_snapshot(tables, folder) == 1
    want = {"levels": (1000, True), "empty": (0, True), "none": (0, True), "odd": (3, True)}
    assert facts(spark, folder) == want
    loaded = snapshot.load_snapshot(spark, folder)
    for name, table in tables.items():
        assert loaded[name].dtypes == table.dtypes
        assert sorted(map(str, loaded[name].collect())) == sorted(map(str, table.collect()))
    assert snapshot.save_snapshot({"levels": tables["levels"].limit(5)}, folder) == 2
    assert facts(spark, folder) == {"levels": (5, True)} and facts(spark, folder, 1) == want


def test_a_save_that_breaks_leaves_the_last_one(spark, tmp_path, tables):
    folder = str(tmp_path / "a")
    with pytest.raises(FileNotFoundError):
        snapshot.load_snapshot(spark, folder)
    snapshot.save_snapshot(tables, folder)
    torn = tables["levels"].withColumn("id", F.when(F.col("id") == 999, F.raise_error(F.lit("lost"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        snapshot.save_snapshot({"odd": tables["odd"], "levels": torn}, folder)
    assert facts(spark, folder)["levels"] == (1000, True)
    with pytest.raises(FileNotFoundError):
        snapshot.load_snapshot(spark, folder, 2)


def test_cut_missing_or_foreign_files_are_refused(spark, tmp_path, tables):
    folder = tmp_path / "a"
    snapshot.save_snapshot(tables, str(folder))
    part = next(path for path in folder.rglob("levels/part-*") if path.suffix == ".parquet")
    whole = part.read_bytes()
    part.write_bytes(whole[:-10])
    with pytest.raises(ValueError, match="levels"):
        snapshot.load_snapshot(spark, str(folder))
    part.write_bytes(whole)
    snapshot.load_snapshot(spark, str(folder))
    (part.parent / "part-foreign.parquet").write_bytes(whole)
    with pytest.raises(ValueError, match="levels"):
        snapshot.load_snapshot(spark, str(folder))


def test_other_rows_under_the_same_sizes_are_found(spark, tmp_path, tables):
    folder = tmp_path / "a"
    snapshot.save_snapshot({"levels": tables["levels"].coalesce(1)}, str(folder))
    part = next(path for path in folder.rglob("levels/part-*") if path.suffix == ".parquet")
    other = tables["levels"].coalesce(1).withColumn("id", F.col("id") + F.when(F.col("id") == 0, 1).otherwise(0))
    other.write.option("compression", "zstd").parquet(str(tmp_path / "b"))
    fake = next(path for path in (tmp_path / "b").glob("part-*"))
    body = fake.read_bytes()
    manifest = next(folder.glob("manifest-*"))
    manifest.write_text(manifest.read_text().replace(f'"bytes": {os.path.getsize(part)}', f'"bytes": {len(body)}'))
    part.write_bytes(body)
    for check in folder.rglob(".*.crc"):
        os.remove(check)
    assert facts(spark, str(folder)) == {"levels": (1000, False)}


def test_a_number_is_published_once(spark, tmp_path):
    files = snapshot._Files(spark, str(tmp_path))
    files.publish(f"{tmp_path}/manifest-00000001.json", "{}")
    with pytest.raises(RuntimeError):
        files.publish(f"{tmp_path}/manifest-00000001.json", "{1}")
    assert sorted(files.sizes(str(tmp_path))) == ["manifest-00000001.json"]
