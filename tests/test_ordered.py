import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from luxframe.operators import binning, ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    n = 400
    key = np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abc"), n))
    frame = pd.DataFrame({"key": key, "id": np.arange(n), "t": rng.integers(0, 120, n), "v": rng.integers(0, 5, n)})
    frame = frame.sort_values(["key", "t", "id"]).reset_index(drop=True)
    frame["pos"] = frame.groupby("key").cumcount()
    return frame, spark.createDataFrame(frame.sample(frac=1, random_state=1))


def compare(got, want, columns):
    got = got.toPandas().sort_values(["key", "pos"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[["key", "pos", *columns]], want[["key", "pos", *columns]], check_dtype=False)


def test_index_rows(rows):
    want, df = rows
    compare(ordered.index_rows(df.drop("pos"), ["key"], ["t", "id"], "pos"), want, ["id"])


def test_index_rows_adds_running_totals(rows, spark):
    want, df = rows
    want = want.assign(v=want["v"].astype("Int64").where((want["v"] != 1) & (want["pos"] > 2)))
    known = want.groupby("key")["v"].cummax().groupby(want["key"]).ffill().notna()
    want["total"] = want["v"].fillna(0).groupby(want["key"]).cumsum().where(known)
    given = F.when((F.col("v") != 1) & (F.col("pos") > 2), F.col("v")).cast("bigint")
    df = df.withColumn("v", given).drop("pos")
    for size in (3, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = ordered.index_rows(df, ["key"], ["t", "id"], "pos", totals={"total": "v"})
            frame = got.toPandas().sort_values(["key", "pos"]).reset_index(drop=True)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert frame["id"].tolist() == want["id"].tolist() and frame["pos"].tolist() == want["pos"].tolist()
        pd.testing.assert_series_equal(frame["total"].astype("Int64"), want["total"].astype("Int64"), check_names=False)
    assert got.columns == [*df.columns, "pos", "total"]


def test_indexed_rows_are_not_shuffled_again(rows):
    plan = ordered.index_rows(rows[1].drop("pos"), ["key"], ["t", "id"], "pos", totals={"total": "v"})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_index_rows_without_key(rows):
    want, df = rows
    got = ordered.index_rows(df.drop("pos"), [], ["id"], "pos").toPandas()
    assert (got["pos"] == got["id"]).all()


@pytest.mark.parametrize("block", [1, 7, 64, 10_000])
def test_running_total_and_last_known(rows, block):
    want, df = rows
    want = want.copy()
    want["total"] = want.groupby("key")["v"].cumsum()
    marked = want["v"].where(want["v"] > 2)
    want["before"] = marked.groupby(want["key"]).ffill()
    want["behind"] = marked.groupby(want["key"]).bfill()
    compare(ordered.running_total(df, ["key"], "pos", F.col("v"), "total", block), want, ["total"])
    value = F.when(F.col("v") > 2, F.col("v").cast("double"))
    compare(ordered.last_known(df, ["key"], "pos", value, "before", block=block), want, ["before"])
    compare(ordered.last_known(df, ["key"], "pos", value, "behind", forward=False, block=block), want, ["behind"])


@pytest.mark.parametrize("block", [3, 50, 10_000])
def test_neighbours_and_frames(rows, block):
    want, df = rows
    want = want.copy()
    want["left"] = want.groupby("key")["v"].shift(1)
    want["right"] = want.groupby("key")["v"].shift(-1)
    want["mean"] = want.groupby("key")["v"].transform(lambda s: s.rolling(5, min_periods=1, center=True).sum())
    got = ordered.neighbours(df, ["key"], "pos", before={"left": "v"}, after={"right": "v"}, block=block)
    compare(got, want, ["left", "right"])
    compare(ordered.moving_frame(df, ["key"], "pos", F.sum("v"), "mean", 2, 2, block), want, ["mean"])


@pytest.mark.parametrize("block", [2, 16, 1000])
def test_sparse_positions(rows, block):
    want, df = rows
    want = want[want["v"] == 0].copy()
    want["next"] = want.groupby("key")["pos"].shift(-1)
    want["rank"] = want.groupby("key").cumcount()
    sparse = df.where("v = 0")
    want = want.reset_index(drop=True)
    compare(ordered.following_position(sparse, ["key"], "pos", "next", block), want, ["next"])
    compare(ordered.ordinal(sparse, ["key"], "pos", "rank", block), want, ["rank"])


def test_spine_and_intervals(spark, rows):
    want, df = rows
    bounds = spark.createDataFrame([("a", 0), ("b", 5), ("c", 9000)], "key string, n long")
    spine = ordered.dense_spine(bounds, ["key"], "n", "i", step=1000).groupBy("key").agg(F.count("*").alias("n"), F.max("i").alias("top"))
    assert {(r.key, r.n, r.top) for r in spine.collect()} == {("b", 5, 4), ("c", 9000, 8999)}
    intervals = spark.createDataFrame([("hot", 3, 90), ("hot", 80, 81), ("a", 0, 0)], "key string, lo long, hi long")
    joined = ordered.rows_in_intervals(df, intervals, ["key"], "pos", "lo", "hi", block=10)
    assert joined.count() == 88 + 2 + 1


def test_quantiles(spark):
    rng = np.random.default_rng(2)
    values = np.round(rng.exponential(size=501), 1)
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    got = binning.quantiles(df, "x", [0.0, 0.25, 0.5, 0.9, 1.0])
    np.testing.assert_allclose(got, np.quantile(values, [0.0, 0.25, 0.5, 0.9, 1.0]))


def test_feature_hist_matches_numpy(spark):
    rng = np.random.default_rng(4)
    values = rng.normal(size=700)
    df = spark.createDataFrame(pd.DataFrame({"x": np.append(values, np.nan)}))
    for bins in (7, None):
        got = binning.feature_hist(df, "x", bins).orderBy("bin").toPandas()
        counts, edges = np.histogram(values, bins="auto" if bins is None else bins)
        assert got.counts.tolist() == counts.tolist()
        np.testing.assert_allclose(got.left_edge, edges[:-1])
