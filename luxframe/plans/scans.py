"""Sources and conversions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from luxframe.operators import binning, selection
from luxframe.operators.ordered import dense_spine, index_rows, rows_in_intervals, whole
from luxframe.plans.catalog import query
from luxframe.session import checkpoint_folder
from luxframe.sources import demo, formats, saved, timetags
from luxframe.sources.demo import PHOTONS_SQL, table


def scratch(spark, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "scan_photons",
    f"WITH {PHOTONS_SQL} SELECT particle, photon_id, abs_ns, micro_ns FROM raw WHERE channel = 2",
)
def scan_photons(spark, folder):
    photons = selection.card_filter(demo.photons(spark, folder), 2)
    return photons.select("particle", "photon_id", "abs_ns", "micro_ns")


@query(
    "scan_photon_slice",
    f"""WITH {PHOTONS_SQL}, b AS (SELECT particle, count(*) // 4 AS lo, count(*) // 2 AS hi FROM ph GROUP BY ALL)
SELECT ph.particle, photon_ind, abs_ns, micro_ns FROM ph JOIN b ON b.particle = ph.particle
WHERE photon_ind BETWEEN lo AND hi""",
)
def scan_photon_slice(spark, folder):
    photons = demo.indexed_photons(spark, folder)
    slices = photons.groupBy("particle").agg(
        F.floor(F.count(F.lit(1)) / 4).alias("lo"), F.floor(F.count(F.lit(1)) / 2).alias("hi")
    )
    inside = rows_in_intervals(photons, slices, ["particle"], "photon_ind", "lo", "hi")
    return inside.select("particle", "photon_ind", "abs_ns", "micro_ns")


@query(
    "scan_pt3",
    """WITH ev AS (SELECT event_id, event_type AS file, CAST(user_id % 2 + 1 AS INTEGER) AS channel,
  date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) // 10000000 AS pulse,
  CAST(round(value * 10) AS BIGINT) AS tenths FROM events),
un AS (SELECT greatest(1, (max(tenths) + 4094) // 4095) AS step FROM ev)
SELECT file, channel, round(pulse * 1e9 / 100000 + (tenths // step) * (0.5e0 * step), 3) AS macro_ns,
  (tenths // step) * (0.5e0 * step) AS micro_ns FROM ev, un""",
)
def scan_pt3(spark, folder):
    """Events packed into T3 words with wrap-around records in between, and decoded again.

    The timing unit is so wide that the largest micro time fits the 12 bits of a record.
    """
    tenths = F.round(F.col("value") * 10).cast("bigint")
    largest = table(spark, folder, "events").agg(F.max(tenths)).first()[0] or 0
    step = max(1, -(-largest // 4095))
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    shots = table(spark, folder, "events").select(
        F.col("event_type").alias("file"),
        "event_id",
        F.pmod("user_id", F.lit(2)).cast("bigint").alias("odd"),
        F.floor(us / 10_000_000).alias("pulse"),
        whole(tenths, step).alias("dtime"),
    )
    word = F.shiftleft(F.col("odd") + 1, 28) + F.shiftleft("dtime", 16) + F.pmod("pulse", F.lit(65_536))
    photons = shots.select("file", "pulse", F.lit(1).alias("kind"), "event_id", word.alias("word"))
    wraps = shots.groupBy("file").agg(F.floor(F.max("pulse") / 65_536).alias("last")).where("last > 0").select(
        "file", F.explode(F.sequence(F.lit(1).cast("bigint"), "last")).alias("wrap")
    )
    markers = wraps.select(
        "file",
        (F.col("wrap") * 65_536).alias("pulse"),
        F.lit(0).alias("kind"),
        F.lit(-1).cast("bigint").alias("event_id"),
        F.lit(15 << 28).cast("bigint").alias("word"),
    )
    stream = index_rows(photons.unionByName(markers), ["file"], ["pulse", "kind", "event_id"], "record")
    records = stream.withColumn("resolution_ns", F.lit(0.5 * step)).withColumn("sync_rate", F.lit(100_000).cast("bigint"))
    decoded = timetags.decode_t3(records)
    return decoded.select("file", "channel", F.round("macro_ns", 3).alias("macro_ns"), "micro_ns")


@query(
    "scan_csv",
    f"WITH {PHOTONS_SQL} SELECT CAST(abs_ns AS DOUBLE) AS macro_ns, micro_ns FROM raw",
)
def scan_csv(spark, folder):
    path = scratch(spark, "csv")
    photons = demo.photons(spark, folder).select(F.col("abs_ns").alias("macro_ns"), "micro_ns")
    photons.write.option("header", True).csv(path)
    return formats.read_csv(spark, path)


@query(
    "scan_photon_hdf5",
    f"""WITH {PHOTONS_SQL} SELECT particle, photon_id, CAST(round(abs_ns * 5e-9 * 1e9) AS BIGINT) AS macro_ns,
  round(CAST(round(micro_ns * 10) AS BIGINT) * 1.6e-11 * 1e9, 6) AS micro_ns FROM raw""",
)
def scan_photon_hdf5(spark, folder):
    raw = demo.photons(spark, folder).select(
        "particle",
        "photon_id",
        F.col("abs_ns").alias("timestamp"),
        F.round(F.col("micro_ns") * 10).cast("bigint").alias("nanotime"),
    )
    scaled = formats.scale_photon_hdf5(raw, F.lit(5e-9), F.lit(1.6e-11))
    return scaled.withColumns({"macro_ns": F.round("macro_ns").cast("bigint"), "micro_ns": F.round("micro_ns", 6)})


@query(
    "scan_mat",
    f"""WITH {PHOTONS_SQL} SELECT particle, photon_id, CAST(round(abs_ns / 1e6 * 1e6) AS BIGINT) AS macro_ns,
  round(micro_ns * 100 / 1e2, 6) AS micro_ns FROM raw""",
)
def scan_mat(spark, folder):
    raw = demo.photons(spark, folder).select(
        "particle", "photon_id", (F.col("abs_ns") / 1e6).alias("tt1"), (F.col("micro_ns") * 100).alias("kin1")
    )
    return formats.scale_mat(raw).withColumns({"macro_ns": F.round("macro_ns").cast("bigint"), "micro_ns": F.round("micro_ns", 6)})


@query(
    "scan_h5",
    f"""WITH {PHOTONS_SQL} SELECT particle || CASE channel WHEN 2 THEN '_2' ELSE '' END AS unique_name, channel,
  channel = 2 AS is_secondary, count(*) AS num_photons, max(abs_ns) AS last_ns FROM raw GROUP BY ALL""",
)
def scan_h5(spark, folder):
    """Particle list of a measurement: a second channel is a sibling of its own."""
    return (
        demo.photons(spark, folder)
        .groupBy("particle", "channel")
        .agg(F.count(F.lit(1)).alias("num_photons"), F.max("abs_ns").alias("last_ns"))
        .select(
            F.concat("particle", F.when(F.col("channel") == 2, "_2").otherwise("")).alias("unique_name"),
            "channel",
            (F.col("channel") == 2).alias("is_secondary"),
            "num_photons",
            "last_ns",
        )
    )


CURVE_SQL = """hist AS (SELECT event_type AS particle, CAST(floor(value * 2) AS BIGINT) AS ch, count(*) AS n
  FROM events GROUP BY ALL),
spine AS (SELECT particle, UNNEST(range(0, max(ch) + 1)) AS ch FROM hist GROUP BY particle),
curve AS (SELECT s.particle, s.ch, coalesce(n, 0) AS counts FROM spine s
  LEFT JOIN hist h ON h.particle = s.particle AND h.ch = s.ch)"""


@query(
    "scan_phu_irf",
    f"""WITH {CURVE_SQL}, l AS (SELECT particle, max(ch) AS last FROM curve WHERE counts > 0 GROUP BY ALL)
SELECT c.particle, c.ch, round(c.ch * 5e-11 * 1e9, 6) AS t_ns, c.counts FROM curve c JOIN l ON l.particle = c.particle
WHERE c.ch <= last""",
)
def scan_phu_irf(spark, folder):
    """Histogram curves over all channels up to the last count."""
    counted = (
        table(spark, folder, "events")
        .groupBy(F.col("event_type").alias("particle"), F.floor(F.col("value") * 2).cast("bigint").alias("ch"))
        .agg(F.count(F.lit(1)).alias("counts"))
    )
    channels = counted.groupBy("particle").agg((F.max("ch") + 1).alias("channels"))
    spine = dense_spine(channels, ["particle"], "channels", "ch").drop("channels")
    curve = spine.join(counted, ["particle", "ch"], "left").withColumn("counts", F.coalesce("counts", F.lit(0)))
    trimmed = binning.trimmed_curve(curve, ["particle"], F.lit(5e-11))
    return trimmed.withColumn("t_ns", F.round("t_ns", 6))


@query(
    "scan_h5_irf",
    f"""WITH {PHOTONS_SQL}, f AS (SELECT min(particle) AS p FROM raw),
g AS (SELECT micro_ns FROM raw WHERE particle = (SELECT p FROM f)),
b AS (SELECT least(0e0, min(micro_ns)) AS lo, max(micro_ns) AS mx FROM g),
t AS (SELECT max(micro_ns) AS top FROM g, b WHERE micro_ns < greatest(25e0, mx)),
k AS (SELECT lo, CAST(ceil((top - lo) / 0.5e0 - 1e-9) AS BIGINT) - 1 AS bins FROM b, t),
h AS (SELECT CASE WHEN abs(micro_ns - (lo + bins * 0.5e0)) <= 1e-9 * 0.5e0 THEN bins - 1
  ELSE CAST(floor((micro_ns - lo) / 0.5e0 + 1e-9) AS BIGINT) END AS bin FROM g, k),
s AS (SELECT UNNEST(range(1, bins)) AS bin FROM k)
SELECT s.bin - 1 AS ch, round((s.bin - 1) * 0.5e0, 6) AS t_ns, count(h.bin) AS counts
FROM s LEFT JOIN h ON h.bin = s.bin GROUP BY ALL""",
)
def scan_h5_irf(spark, folder):
    """Response = decay histogram of the first particle of a measurement."""
    photons = demo.photons(spark, folder)
    first = photons.agg(F.min("particle").alias("particle"))
    micro = binning.micro_counts(photons.join(F.broadcast(first), "particle", "left_semi"), ["particle"])
    decay = binning.decay_histogram(micro, ["particle"], 0.5)
    return decay.select("ch", F.round("t_ns", 6).alias("t_ns"), "counts")


@query(
    "scan_spectra_txt",
    """WITH v AS (SELECT vec_id, CAST(label AS VARCHAR) AS particle, embedding FROM embeddings),
e AS (SELECT vec_id, UNNEST(embedding) AS x, UNNEST(range(0, 64)) AS t_ind FROM v)
SELECT CAST(vec_id AS BIGINT) AS wl_ind, round(400 + vec_id * 0.25e0, 4) AS wavelength_nm, CAST(t_ind AS INTEGER) AS t_ind,
  round((t_ind + 1) * 0.5e0, 4) AS t_s, round(CAST(x AS DOUBLE), 5) AS counts FROM e""",
)
def scan_spectra_txt(spark, folder):
    """Vectors written as spectral text lines and parsed again."""
    values = F.transform("embedding", lambda x: x.cast("double").cast("string"))
    lines = table(spark, folder, "embeddings").select(
        F.lit("spectra").alias("particle"),
        F.col("vec_id").alias("wl_ind"),
        F.concat_ws(" ", (400 + F.col("vec_id") * 0.25).cast("string"), F.array_join(values, " ")).alias("line"),
    )
    parsed = formats.parse_spectra(lines, 0.5)
    return parsed.select(
        "wl_ind", F.round("wavelength_nm", 4).alias("wavelength_nm"), "t_ind", F.round("t_s", 4).alias("t_s"),
        F.round("counts", 5).alias("counts"),
    )


@query(
    "scan_raster",
    """WITH r AS (SELECT vec_id AS particle, UNNEST(embedding) AS v, UNNEST(range(0, 64)) AS i FROM embeddings)
SELECT particle, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x,
  round(10 + (i % 8) * 5e0 / 7, 6) AS x_um, round(20 + (i // 8) * 5e0 / 7, 6) AS y_um, CAST(v AS DOUBLE) AS counts FROM r""",
)
def scan_raster(spark, folder):
    """8 x 8 images with pixel positions from start and range."""
    from luxframe.operators.imaging import pixel_axis

    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.slice("embedding", y * 8 + 1, 8).cast("array<double>"))
    images = table(spark, folder, "embeddings").select(F.col("vec_id").alias("particle"), rows.alias("image"))
    pixels = formats.raster_rows(images)
    return pixels.select(
        "particle",
        "y",
        "x",
        F.round(pixel_axis(F.col("x"), F.lit(10), F.lit(5.0), F.lit(8)), 6).alias("x_um"),
        F.round(pixel_axis(F.col("y"), F.lit(20), F.lit(5.0), F.lit(8)), 6).alias("y_um"),
        "counts",
    )


@query(
    "scan_parquet_timestamps",
    """SELECT CASE WHEN l_linenumber % 3 = 0 THEN 'R' WHEN l_linenumber % 3 = 1 THEN 'A' ELSE 'B' END AS channel,
  l_orderkey * 7 + l_linenumber AS ticks, round((l_orderkey * 7 + l_linenumber) * 0.16461e0, 6) AS t_ns FROM lineitem""",
)
def scan_parquet_timestamps(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("ticks"),
        F.element_at(F.array(F.lit("R"), F.lit("A"), F.lit("B")), F.pmod("l_linenumber", F.lit(3)) + 1).alias("channel"),
    )
    path = scratch(spark, "timestamps")
    lines.write.partitionBy("channel").parquet(path)
    tables = {c: spark.read.parquet(f"{path}/channel={c}") for c in ("A", "B", "R")}
    return formats.timestamp_channels(tables).withColumn("t_ns", F.round("t_ns", 6))


@query(
    "file_filter",
    """WITH n AS (SELECT 'trace' || c_custkey || CASE WHEN c_acctbal > 0 THEN '.pt3' ELSE '.txt' END AS file FROM customer)
SELECT file, CAST(regexp_extract(file, '(\\d+)\\D*\\d*$', 1) AS BIGINT) AS number FROM
 (SELECT file FROM n WHERE starts_with(file, 'trace') AND ends_with(file, '.txt'))""",
)
def file_filter(spark, folder):
    extension = F.when(F.col("c_acctbal") > 0, ".pt3").otherwise(".txt")
    names = table(spark, folder, "customer").select(F.concat(F.lit("trace"), "c_custkey", extension).alias("file"))
    return formats.matching_files(names, "trace", ".txt")


@query(
    "file_pairing",
    """SELECT c_custkey AS number, 'spectra' AS missing FROM customer WHERE c_custkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT p_partkey, 'photons' FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)""",
)
def file_pairing(spark, folder):
    """Customers as photon files, parts as spectra files: which number lacks a partner."""
    photon_files = table(spark, folder, "customer").select(F.col("c_custkey").alias("number"))
    spectra_files = table(spark, folder, "part").select(F.col("p_partkey").alias("number"))
    return formats.unpaired(photon_files, spectra_files)


@query(
    "scan_saved_analysis",
    """SELECT l_suppkey AS particle_id, l_orderkey AS line_order, l_linenumber AS line_no, l_quantity AS int_p_s,
  1 AS channel, false AS is_normalized, '1.08' AS saved_version FROM lineitem""",
)
def scan_saved_analysis(spark, folder):
    """A level table saved by an older version, loaded and brought up to date."""
    levels = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("particle_id"),
        F.col("l_orderkey").alias("line_order"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_quantity").alias("int_p_s"),
    )
    path = scratch(spark, "saved")
    saved.save_analysis({"levels": levels}, path, "1.05")
    return saved.load_analysis(spark, path, ["levels"])["levels"]


@query(
    "scan_files",
    """SELECT event_type AS folder, 'shots_' || event_type || '.csv' AS kind, count(*) AS num_files, true AS has_content
FROM (SELECT DISTINCT event_type, CAST(user_id % 2 AS INTEGER) AS half FROM events) GROUP BY ALL""",
)
def scan_files(spark, folder):
    """A tree of measurement folders, listed without opening a file."""
    path = scratch(spark, "tree")
    shots = table(spark, folder, "events").select(
        F.col("event_type").alias("folder"), F.pmod("user_id", F.lit(2)).cast("int").alias("half"), "event_id", "value"
    )
    halves = shots.repartition("folder", "half")
    halves.write.partitionBy("folder", "half").csv(path)
    shots.limit(1).write.json(f"{path}/notes")
    listed = formats.listed_files(spark, path, "*.csv")
    return listed.select(F.regexp_extract("path", "folder=([^/]*)/", 1).alias("folder"), "length").groupBy("folder").agg(
        F.concat(F.lit("shots_"), F.first("folder"), F.lit(".csv")).alias("kind"),
        F.count(F.lit(1)).alias("num_files"),
        (F.min("length") > 0).alias("has_content"),
    )
