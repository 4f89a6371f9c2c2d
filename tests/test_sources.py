import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from luxframe.operators import exporting
from luxframe.sources import formats, saved, timetags

RATE, RESOLUTION = 1_000_000, 0.0625


def pt3_file(path, words, image=3):
    head = bytearray(timetags.ROUTERS_AT + timetags.ROUTER_BYTES * 4 + timetags.AFTER_ROUTERS["end"])
    base = timetags.ROUTERS_AT + timetags.ROUTER_BYTES * 4
    struct.pack_into("<i", head, timetags.ROUTING_CHANNELS_AT, 4)
    struct.pack_into("<f", head, timetags.RESOLUTION_AT, RESOLUTION)
    struct.pack_into("<i", head, base + 12, RATE)
    struct.pack_into("<I", head, base + 28, len(words))
    struct.pack_into("<i", head, base + 32, image)
    path.write_bytes(bytes(head) + b"\0" * 4 * image + np.asarray(words, dtype="<u4").tobytes())


def word(channel, dtime, pulse):
    return (channel << 28) | (dtime << 16) | pulse


OVERFLOW = 15 << 28


def test_pt3_records(spark, tmp_path):
    words = [word(1, 10, 5), OVERFLOW, word(2, 4095, 65535), word(15, 1, 0), OVERFLOW, word(1, 0, 0)]
    pt3_file(tmp_path / "a.pt3", words)
    pt3_file(tmp_path / "b.pt3", [word(2, 1, 1)] * 3, image=0)
    for split in (2, 1000):
        rows = timetags.read_pt3(spark, str(tmp_path), split).orderBy("file", "record").collect()
        got = [(r.channel, r.macro_ns, r.micro_ns) for r in rows if r.file.endswith("a.pt3")]
        want = [(1, 5, 10), (2, 65536 + 65535, 4095), (1, 2 * 65536, 0)]
        assert got == [(c, pytest.approx(p * 1e9 / RATE + d * RESOLUTION), d * RESOLUTION) for c, p, d in want]
        assert sum(r.file.endswith("b.pt3") for r in rows) == 3


def test_overflow_totals_cross_blocks(spark):
    rng = np.random.default_rng(0)
    kinds = rng.random(300) < 0.3
    words = [OVERFLOW if k else word(1, 0, 7) for k in kinds]
    raw = spark.createDataFrame(
        pd.DataFrame({"file": "f", "record": range(300), "word": words, "resolution_ns": 1.0, "sync_rate": 1_000_000_000})
    )
    got = timetags.decode_t3(raw, block=16).orderBy("record").toPandas()
    want = (np.cumsum(kinds) * 65536 + 7)[~kinds]
    assert got.macro_ns.tolist() == want.tolist()


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("macro,micro\n10,0.5\n20,1.5\n")
    assert [tuple(r) for r in formats.read_csv(spark, str(tmp_path)).orderBy("macro_ns").collect()] == [(10.0, 0.5), (20.0, 1.5)]


def test_spectra_text(spark, tmp_path):
    (tmp_path / "s1.txt").write_text("500.5 1 2 3\n400.5\t4 5 6\n\n")
    rows = formats.read_spectra(spark, str(tmp_path), 2.0).orderBy("wl_ind", "t_ind").collect()
    assert [(r.particle, r.wl_ind, r.wavelength_nm, r.t_s, r.counts) for r in rows][:2] == [
        ("s1.txt", 0, 400.5, 2.0, 4.0),
        ("s1.txt", 0, 400.5, 4.0, 5.0),
    ]
    assert len(rows) == 6


def test_scaling(spark):
    raw = spark.createDataFrame([(100, 200)], "timestamp long, nanotime long")
    row = formats.scale_photon_hdf5(raw, F.lit(5e-9), F.lit(1e-11)).first()
    assert (row.macro_ns, row.micro_ns) == (pytest.approx(500), pytest.approx(2))
    row = formats.scale_mat(spark.createDataFrame([(2.0, 350.0)], "tt1 double, kin1 double")).first()
    assert (row.macro_ns, row.micro_ns) == (2e6, 3.5)


def test_file_matching(spark):
    names = spark.createDataFrame([("trace1.pt3",), ("trace12.pt3",), ("trace2.txt",), ("spec1.pt3",), ("trace.pt3",)], "file string")
    got = {r.file: r.number for r in formats.matching_files(names, "trace", ".pt3").collect()}
    assert set(got) == {"trace1.pt3", "trace12.pt3", "trace.pt3"}


def test_saved_analysis(spark, tmp_path):
    levels = spark.createDataFrame([("p", 1.0)], "particle string, int_p_s double")
    saved.save_analysis({"levels": levels}, str(tmp_path), "1.05")
    row = saved.load_analysis(spark, str(tmp_path), ["levels"])["levels"].first()
    assert (row.channel, row.is_normalized, row.saved_version) == (1, False, saved.CURRENT)


@pytest.mark.parametrize("fmt", ["parquet", "csv", "orc", "json", "feather"])
def test_export_formats(spark, tmp_path, fmt):
    df = spark.createDataFrame([("p", 1, 2.5), ("q", 2, 3.5)], "particle string, n long, x double")
    path = str(tmp_path / f"out.{fmt}")
    listed = exporting.write_table(df, path, fmt)
    if fmt == "feather":
        files = listed.collect()
        assert sum(r.rows for r in files) == 2
        back = pd.concat([pd.read_feather(r.file.removeprefix("file://")) for r in files])
    else:
        back = spark.read.schema(df.schema).option("header", True).format(fmt).load(path).toPandas()
    assert sorted(back.itertuples(index=False, name=None)) == [("p", 1, 2.5), ("q", 2, 3.5)]


def test_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError):
        exporting.write_table(spark.range(1), str(tmp_path / "x"), "docx")


def test_per_particle_csv_headers(spark, tmp_path):
    df = spark.createDataFrame([("p", 1, 0.5, 7)], "particle string, bin_number long, t_s double, counts long")
    exporting.write_per_particle(df, str(tmp_path / "t"), exporting.TRACE_HEADERS)
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).columns[:2] == ["Bin #", "Bin Time (s)"]


def test_padding(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "tau array<double>")
    assert tuple(df.select(*exporting.padded("tau", 3, "tau_")).first()) == (1.0, 2.0, None)
