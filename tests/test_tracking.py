"""Change points of a stream and from SQL text equal those of the finished table."""

import numpy as np
import pandas as pd
import pytest

from luxframe.config import ChangePointSettings
from luxframe.operators import change_point_sql
from luxframe.operators.change_points import find_change_points
from luxframe.plans import catalog
from luxframe.streaming.bursts import replayed
from luxframe.streaming.change_points import OpenChain, track_change_points
from luxframe.streaming.live import photon_stream
from test_change_points import frame, stream, unbroken

S = ChangePointSettings()
COLUMNS = ["particle", "cpt_ind", "region_lo", "region_hi", "wlr"]
SCHEMA = "particle string, channel int, abs_ns long, micro_ns double"


def points(df):
    return sorted((r.particle, r.cpt_ind, r.region_lo, r.region_hi, round(r.wlr, 9)) for r in df.select(*COLUMNS).collect())


def streams():
    rng = np.random.default_rng(4)
    busy = [(rng.choice([500, 3000, 9000]), rng.integers(60, 900)) for _ in range(20)]
    return {
        "busy": stream(1, busy),
        "quiet": stream(2, [(1000, 6000)]),
        "edge": stream(3, [(1000, 1337), (6000, 3007)]),
        "short": stream(4, [(300, 100), (9000, 99)]),
        "least": stream(5, [(300, 100), (9000, 100)]),
    }


@pytest.mark.parametrize("size", [1, 19, 199, 200, 999, 1000, 1001, 1019, 1200, 2000, 2005])
def test_open_chain_at_every_cut(size):
    times = stream(size, [(200, size // 2), (9000, size - size // 2)])
    rng = np.random.default_rng(size)
    for _ in range(5):
        chain, got = OpenChain(S), []
        for part in np.split(times, np.sort(rng.integers(0, size, 12))):
            got += chain.advance(part)
            assert len(chain.times) <= S.segment + S.overlap
            held = list(chain.held.values())
            chain = OpenChain(S, chain.base, chain.end, chain.latest, chain.highest, chain.seen, chain.times.tolist(), held)
        got += chain.advance(np.zeros(0, dtype=np.int64), closed=True)
        assert [p[0] for p in got] == unbroken(times)


def write(spark, folder, rows):
    rng = np.random.default_rng(len(rows))
    mixed = rows.iloc[rng.permutation(len(rows))]  # photons of a batch come in any order
    spark.createDataFrame(mixed, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def track(spark, tmp_path, files_per_batch, idle_s=50.0):
    photons = photon_stream(spark, str(tmp_path / "photons"), files_per_batch)
    return replayed(spark, track_change_points(photons, idle_s=idle_s, late_s=0.5), str(tmp_path / "out"), str(tmp_path / "state"))


@pytest.mark.parametrize("files_per_batch", [1, 3])
def test_stream_equals_the_finished_table(spark, tmp_path, files_per_batch):
    given = streams()
    rows = pd.concat([pd.DataFrame({"particle": p, "channel": 1, "abs_ns": t, "micro_ns": 0.0}) for p, t in given.items()])
    rows = rows.sort_values("abs_ns", ignore_index=True)
    folder = str(tmp_path / "photons")
    cuts = [0, 3000, 3001, 9000, len(rows)]
    for low, high in zip(cuts, cuts[1:]):
        write(spark, folder, rows[low:high])
    early = track(spark, tmp_path, files_per_batch)  # stops in the middle of every trace's last segment
    want = points(find_change_points(frame(spark, given)))
    assert set(points(early)) <= set(want)
    end = int(rows["abs_ns"].max())
    write(spark, folder, pd.DataFrame({"particle": [None], "channel": 0, "abs_ns": end + 10**12, "micro_ns": 0.0}))
    assert points(track(spark, tmp_path, files_per_batch)) == want  # from the checkpoint on, each point once


def test_a_long_pause_ends_the_recording(spark, tmp_path):
    times = stream(7, [(1000, 700), (9000, 900)])
    folder = str(tmp_path / "photons")
    for part, start in enumerate((0, 10**12)):
        late = times + start
        write(spark, folder, pd.DataFrame({"particle": "p", "channel": 1, "abs_ns": late, "micro_ns": 0.0}))
        write(spark, folder, pd.DataFrame({"particle": "tick", "channel": 1, "abs_ns": [int(late[-1]) + 10**11], "micro_ns": 0.0}))
    write(spark, folder, pd.DataFrame({"particle": "tick", "channel": 1, "abs_ns": [10**13], "micro_ns": 0.0}))
    rows = track(spark, tmp_path, 1, idle_s=20.0).collect()
    want = unbroken(times)
    assert sorted((r.recording, r.cpt_ind) for r in rows) == [(n, at) for n in (0, 1) for at in want] and want


@pytest.mark.parametrize("chunk", [2000, 200_000])
def test_table_function_equals_the_operator(spark, chunk):
    photons = frame(spark, streams())
    change_point_sql.register(spark, photons, chunk=chunk, view="few", name="points_of")
    got = spark.sql("SELECT * FROM points_of(TABLE(few) PARTITION BY (particle, chunk) ORDER BY (photon_ind))")
    assert points(got) == points(find_change_points(photons))
    some = spark.sql(
        "SELECT * FROM points_of(TABLE(SELECT * FROM few WHERE particle = 'edge') PARTITION BY (particle, chunk) ORDER BY (photon_ind))"
    )
    assert {r.particle for r in some.collect()} == {"edge"}
    with pytest.raises(ValueError):
        change_point_sql.photon_chunks(photons, chunk=1000)


def test_table_function_on_no_photons(spark):
    empty = frame(spark, {"x": stream(1, [(100, 1)])}).limit(0)
    change_point_sql.register(spark, empty, view="nothing", name="points_of_nothing")
    got = spark.sql("SELECT * FROM points_of_nothing(TABLE(nothing) PARTITION BY (particle, chunk) ORDER BY (photon_ind))")
    assert got.count() == 0 and got.columns == COLUMNS


def test_queries_agree_on_the_events(spark):
    catalog.load()
    folder = "/root/testdata/sf0.01"
    want = points(catalog.QUERIES["cpa_find_all"](spark, folder))
    assert points(catalog.QUERIES["sql_change_points"](spark, folder)) == want
    assert points(catalog.QUERIES["stream_change_points"](spark, folder)) == want and want
