"""Intensity traces, decay histograms, distributions, correlation and change-point series."""

from __future__ import annotations

from pyspark.sql import functions as F

from luxframe.operators import binning, correlation
from luxframe.operators.change_points import find_change_points, segment_series, segment_sums, until
from luxframe.plans.catalog import query
from luxframe.sources import demo
from luxframe.sources.demo import PHOTONS_SQL

BIN_NS = 6 * 3_600_000_000_000

TRACE_SQL = (
    PHOTONS_SQL
    + f""",
nb AS (SELECT particle, greatest(CAST(ceil(max(abs_ns) / {BIN_NS}e0) AS BIGINT), 1) AS bins FROM raw GROUP BY ALL),
sp AS (SELECT particle, UNNEST(range(0, bins)) AS bin FROM nb),
ct AS (SELECT r.particle, least(abs_ns // {BIN_NS}, bins - 1) AS bin, count(*) AS n FROM raw r
  JOIN nb ON nb.particle = r.particle GROUP BY ALL),
tr AS (SELECT sp.particle, sp.bin, sp.bin * {BIN_NS} / 1e6 AS t_ms, coalesce(n, 0) AS counts
  FROM sp LEFT JOIN ct ON ct.particle = sp.particle AND ct.bin = sp.bin)"""
)


@query("bin_trace", f"WITH {TRACE_SQL} SELECT particle, bin, t_ms, counts FROM tr")
def bin_trace(spark, folder):
    return binning.bin_trace(demo.photons(spark, folder), BIN_NS)


WIDTH = 0.1
DECAY_SQL = (
    PHOTONS_SQL
    + f""",
db AS (SELECT particle, least(0e0, min(micro_ns)) AS lo, greatest(25e0, max(micro_ns)) AS lim FROM raw GROUP BY ALL),
dt AS (SELECT r.particle, min(lo) AS lo, max(micro_ns) AS top FROM raw r JOIN db ON db.particle = r.particle
  WHERE micro_ns < lim GROUP BY ALL),
dk AS (SELECT particle, lo, CAST(ceil((top - lo) / {WIDTH}e0 - 1e-9) AS BIGINT) - 1 AS bins FROM dt),
dh AS (SELECT r.particle, CASE WHEN abs(micro_ns - (lo + bins * {WIDTH}e0)) <= 1e-9 * {WIDTH}e0 THEN bins - 1
  ELSE CAST(floor((micro_ns - lo) / {WIDTH}e0 + 1e-9) AS BIGINT) END AS bin, count(*) AS n
  FROM raw r JOIN dk ON dk.particle = r.particle GROUP BY ALL),
ds AS (SELECT particle, UNNEST(range(1, bins)) AS bin FROM dk),
dc AS (SELECT ds.particle, ds.bin - 1 AS ch, coalesce(n, 0) AS counts FROM ds
  LEFT JOIN dh ON dh.particle = ds.particle AND dh.bin = ds.bin)"""
)


def particle_decays(spark, folder):
    micro = binning.micro_counts(demo.photons(spark, folder), ["particle"])
    return binning.decay_histogram(micro, ["particle"], WIDTH)


@query("decay_histogram", f"WITH {DECAY_SQL} SELECT particle, ch, round(ch * {WIDTH}e0, 6) AS t_ns, counts FROM dc")
def decay_histogram(spark, folder):
    return particle_decays(spark, folder).withColumn("t_ns", F.round("t_ns", 6))


@query(
    "decay_startpoint",
    f"""WITH {DECAY_SQL},
pk AS (SELECT particle, arg_max(ch, counts * 100000 - ch) AS peak FROM dc GROUP BY ALL),
bk AS (SELECT dc.particle, peak, peak - 1 - ch AS back FROM dc JOIN pk ON pk.particle = dc.particle
  WHERE ch < peak AND counts = 0),
rn AS (SELECT *, back - row_number() OVER (PARTITION BY particle ORDER BY back) AS isle FROM bk),
rk AS (SELECT *, row_number() OVER (PARTITION BY particle, isle ORDER BY back) AS r FROM rn),
st AS (SELECT particle, coalesce(min(CASE WHEN r = 11 THEN back - 1 END), min(back)) AS back FROM rk GROUP BY ALL)
SELECT round(avg(CASE WHEN st.back IS NULL THEN 0 ELSE peak - st.back END), 6) AS start_channel,
  count(*) AS particles FROM pk LEFT JOIN st ON st.particle = pk.particle""",
)
def decay_startpoint(spark, folder):
    start = binning.decay_startpoint(particle_decays(spark, folder))
    return start.withColumn("start_channel", F.round("start_channel", 6))


@query("global_tmin", f"WITH {PHOTONS_SQL} SELECT min(micro_ns) AS tmin_ns FROM raw")
def global_tmin(spark, folder):
    return binning.global_tmin(binning.micro_counts(demo.photons(spark, folder), ["particle"]))


@query(
    "channel_width",
    f"""WITH {PHOTONS_SQL}, u AS (SELECT DISTINCT particle, micro_ns FROM raw),
g AS (SELECT DISTINCT particle, round(micro_ns - lag(micro_ns) OVER (PARTITION BY particle ORDER BY micro_ns), 9) AS gap
  FROM u),
s AS (SELECT particle, round(gap - lag(gap) OVER (PARTITION BY particle ORDER BY gap NULLS FIRST), 9) AS step FROM g)
SELECT particle, coalesce(min(CASE WHEN step > 1e-4 THEN step END), 0.01220703125e0) AS channel_width_ns
FROM s GROUP BY ALL""",
)
def channel_width(spark, folder):
    micro = binning.micro_counts(demo.photons(spark, folder), ["particle"])
    return binning.channel_width(micro, ["particle"], 0.01220703125)


@query(
    "roi_level_decays",
    f"""WITH {PHOTONS_SQL},
db AS (SELECT particle, period, least(0e0, min(micro_ns)) AS lo, greatest(25e0, max(micro_ns)) AS lim FROM raw GROUP BY ALL),
dt AS (SELECT r.particle, r.period, min(lo) AS lo, max(micro_ns) AS top FROM raw r
  JOIN db ON db.particle = r.particle AND db.period = r.period WHERE micro_ns < lim GROUP BY ALL),
dk AS (SELECT particle, period, lo, CAST(ceil((top - lo) / 1e0 - 1e-9) AS BIGINT) - 1 AS bins FROM dt),
dh AS (SELECT r.particle, r.period, CASE WHEN abs(micro_ns - (lo + bins * 1e0)) <= 1e-9 THEN bins - 1
  ELSE CAST(floor((micro_ns - lo) / 1e0 + 1e-9) AS BIGINT) END AS bin, count(*) AS n
  FROM raw r JOIN dk ON dk.particle = r.particle AND dk.period = r.period GROUP BY ALL),
ds AS (SELECT particle, period, UNNEST(range(1, bins)) AS bin FROM dk)
SELECT ds.particle, ds.period AS scope_ind, ds.bin - 1 AS ch, (ds.bin - 1) * 1e0 AS t_ns, coalesce(n, 0) AS counts FROM ds
LEFT JOIN dh ON dh.particle = ds.particle AND dh.period = ds.period AND dh.bin = ds.bin""",
)
def roi_level_decays(spark, folder):
    """Decay histogram of every level."""
    photons = demo.photons(spark, folder).withColumn("scope_ind", F.col("period"))
    micro = binning.micro_counts(photons, ["particle", "scope_ind"])
    return binning.decay_histogram(micro, ["particle", "scope_ind"], 1.0)


@query(
    "intensity_hist",
    f"""WITH {TRACE_SQL}, e0 AS (SELECT particle, -max(counts) AS a, -min(counts) AS b FROM tr GROUP BY ALL),
e AS (SELECT particle, CASE WHEN a = b THEN a - 0.5e0 ELSE a END AS lo, CASE WHEN a = b THEN b + 0.5e0 ELSE b END AS hi FROM e0),
h AS (SELECT tr.particle, CAST(least(floor((-counts - lo) / ((hi - lo) / 100e0) + 1e-9), 99) AS BIGINT) AS bin, count(*) AS n
  FROM tr JOIN e ON e.particle = tr.particle GROUP BY ALL),
m AS (SELECT particle, max(n) AS top FROM h GROUP BY ALL), s AS (SELECT particle, top, UNNEST(range(0, 100)) AS bin FROM m)
SELECT s.particle, s.bin, round(coalesce(n, 0) / top, 6) AS frequency FROM s
LEFT JOIN h ON h.particle = s.particle AND h.bin = s.bin""",
)
def intensity_hist(spark, folder):
    hist = binning.intensity_hist(bin_trace(spark, folder))
    return hist.withColumn("frequency", F.round("frequency", 6))


@query(
    "moving_avg",
    f"""WITH {DECAY_SQL} SELECT particle, ch, round(sum(counts) OVER (PARTITION BY particle ORDER BY ch
  ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10e0, 6) AS smooth FROM dc""",
)
def moving_avg(spark, folder):
    smooth = binning.moving_average(particle_decays(spark, folder), ["particle"], "ch", "counts", 10)
    return smooth.select("particle", "ch", F.round("smooth", 6).alias("smooth"))


@query(
    "max_zero_run",
    f"""WITH {DECAY_SQL}, z AS (SELECT particle, ch, ch - row_number() OVER (PARTITION BY particle ORDER BY ch) AS isle
  FROM dc WHERE counts = 0), r AS (SELECT particle, isle, count(*) AS n FROM z GROUP BY ALL)
SELECT p.particle, coalesce(max(n), 0) AS max_zeros FROM (SELECT DISTINCT particle FROM dc) p
LEFT JOIN r ON r.particle = p.particle GROUP BY ALL""",
)
def max_zero_run(spark, folder):
    return binning.max_zero_run(particle_decays(spark, folder), ["particle"], "ch", "counts")


G2_WINDOW_PS = 1_800_000_000_000_000
T_PS = "abs_ns * 1000 + CAST(round(micro_ns * 1000) AS BIGINT)"
EVENTS_SQL = (
    PHOTONS_SQL
    + f""",
c1 AS (SELECT particle, {T_PS} AS t FROM raw WHERE channel = 1),
c2 AS (SELECT particle, {T_PS} AS t FROM raw WHERE channel = 2),
dl AS (SELECT c1.particle, c2.t - c1.t AS dt_ps FROM c1 JOIN c2 ON c1.particle = c2.particle
  AND c2.t BETWEEN c1.t - {G2_WINDOW_PS} AND c1.t + {G2_WINDOW_PS})"""
)


def delays(spark, folder):
    return correlation.g2_events(demo.photons(spark, folder), G2_WINDOW_PS)


@query("g2_events", f"WITH {EVENTS_SQL} SELECT particle, dt_ps, count(*) AS pairs FROM dl GROUP BY ALL")
def g2_events(spark, folder):
    return delays(spark, folder)


def _hist_sql(bins: int, edges: str) -> str:
    return f"""{EVENTS_SQL}, ge AS ({edges}),
gh AS (SELECT dl.particle, CAST(least(floor((dt_ps - lo) / ((hi - lo) / {bins}e0) + 1e-9), {bins - 1}) AS BIGINT) AS bin,
  count(*) AS n FROM dl JOIN ge ON ge.particle = dl.particle GROUP BY ALL),
gs AS (SELECT particle, lo, hi, UNNEST(range(0, {bins})) AS bin FROM ge),
gg AS (SELECT gs.particle, gs.bin, round((lo + gs.bin * ((hi - lo) / {bins}e0)) / 1000e0, 1) AS left_ns, coalesce(n, 0) AS counts
  FROM gs LEFT JOIN gh ON gh.particle = gs.particle AND gh.bin = gs.bin)"""


OBSERVED = "SELECT particle, CAST(min(dt_ps) AS DOUBLE) AS lo, CAST(max(dt_ps) AS DOUBLE) AS hi FROM dl GROUP BY ALL"
WINDOWED = f"SELECT DISTINCT particle, CAST(-{G2_WINDOW_PS} AS DOUBLE) AS lo, CAST({G2_WINDOW_PS} AS DOUBLE) AS hi FROM dl"


@query("g2_histogram", f"WITH {_hist_sql(100, OBSERVED)} SELECT * FROM gg")
def g2_histogram(spark, folder):
    return correlation.g2_observed(demo.photons(spark, folder), G2_WINDOW_PS, 100).withColumn("left_ns", F.round("left_ns", 1))


@query("g2_fixed_window", f"WITH {_hist_sql(60, WINDOWED)} SELECT * FROM gg")
def g2_fixed_window(spark, folder):
    hist = correlation.g2_fixed(demo.photons(spark, folder), G2_WINDOW_PS, 60)
    return hist.withColumn("left_ns", F.round("left_ns", 1))


@query("g2_rebin", f"WITH {_hist_sql(25, OBSERVED)} SELECT * FROM gg")
def g2_rebin(spark, folder):
    """New bins over delays stored once."""
    from luxframe.plans.scans import scratch

    path = scratch(spark, "delays")
    # Delays come sorted: the second version of the format writes them as differences.
    delays(spark, folder).write.options(**{"compression": "zstd", "parquet.writer.version": "v2"}).parquet(path)
    return correlation.g2_histogram(spark.read.parquet(path), 25, stored=True).withColumn("left_ns", F.round("left_ns", 1))


@query("g2_sum", f"WITH {_hist_sql(60, WINDOWED)} SELECT bin, CAST(sum(counts) AS BIGINT) AS counts FROM gg GROUP BY ALL")
def g2_sum(spark, folder):
    hist = correlation.g2_fixed(demo.photons(spark, folder), G2_WINDOW_PS, 60)
    return correlation.g2_sum(hist, demo.photons(spark, folder))


@query(
    "g2_unsigned",
    f"""WITH {PHOTONS_SQL}, c1 AS (SELECT particle, abs_ns * 1000 AS t FROM raw WHERE channel = 1),
c2 AS (SELECT particle, abs_ns * 1000 AS t FROM raw WHERE channel = 2)
SELECT c1.particle, c2.t - c1.t AS dt_ps, count(*) AS pairs FROM c1 JOIN c2 ON c1.particle = c2.particle
  AND c2.t > c1.t AND c2.t <= c1.t + {G2_WINDOW_PS} GROUP BY ALL""",
)
def g2_unsigned(spark, folder):
    """Reverse start-stop with the second channel as laser pulses."""
    photons = demo.photons(spark, folder)
    first = correlation.arrivals(photons, 1, use_micro=False)
    return correlation.laser_delays(first, correlation.arrivals(photons, 2, use_micro=False), G2_WINDOW_PS)


@query(
    "join_laser_sync",
    f"""WITH {PHOTONS_SQL}, c2 AS (SELECT particle, abs_ns FROM raw WHERE channel = 2)
SELECT r.particle, r.photon_id, r.abs_ns, min(c2.abs_ns) AS sync_ns FROM raw r LEFT JOIN c2
  ON c2.particle = r.particle AND c2.abs_ns > r.abs_ns WHERE r.channel = 1 GROUP BY ALL""",
)
def join_laser_sync(spark, folder):
    """The first pulse after each photon, as a look ahead instead of a join."""
    from luxframe.operators.ordered import last_known, neighbours

    photons = demo.indexed_photons(spark, folder)
    pulse = F.when(F.col("channel") == 2, F.col("abs_ns"))
    ahead = last_known(photons, ["particle"], "photon_ind", pulse, "_pulse", forward=False)
    following = neighbours(ahead, ["particle"], "photon_ind", after={"sync_ns": "_pulse"})
    return following.where("channel = 1").select("particle", "photon_id", "abs_ns", "sync_ns")


@query(
    "join_g2_pairs",
    f"""WITH {EVENTS_SQL} SELECT particle, count(*) AS pairs, CAST(sum(abs(dt_ps)) / 1000000000 AS BIGINT) AS spread_ms
FROM dl GROUP BY ALL""",
)
def join_g2_pairs(spark, folder):
    pairs = delays(spark, folder)
    spread = F.floor(F.sum(F.abs("dt_ps").cast("decimal(38,0)") * F.col("pairs")) / 1_000_000_000 + F.lit(0.5))
    return pairs.groupBy("particle").agg(F.sum("pairs").alias("pairs"), spread.cast("bigint").alias("spread_ms"))


SEGMENT = 200
WLR_SQL = f"""{PHOTONS_SQL},
sg AS (SELECT particle, photon_ind // {SEGMENT} AS segment, photon_ind % {SEGMENT} AS k, abs_ns,
  count(*) OVER w AS n, min(abs_ns) OVER w AS t0, max(abs_ns) OVER w AS t1 FROM ph
  WINDOW w AS (PARTITION BY particle, photon_ind // {SEGMENT})),
hs AS (SELECT j, sum(1e0 / j) OVER (ORDER BY j) AS h1, sum(1e0 / (j * j)) OVER (ORDER BY j) AS h2
  FROM (SELECT UNNEST(range(1, {SEGMENT + 1})) AS j)),
wj AS (SELECT s.*, (abs_ns - t0) / (t1 - t0) AS v, a.h1 AS n1, a.h2 AS n2, b.h1 AS k1, b.h2 AS k2, c.h1 AS r1, c.h2 AS r2
  FROM sg s JOIN hs a ON a.j = n - 1 JOIN hs b ON b.j = k - 1 JOIN hs c ON c.j = n - k - 1
  WHERE n >= 20 AND k BETWEEN 2 AND n - 2),
wl AS (SELECT particle, segment, k, (-2e0 * k * ln(v) - 2e0 * (n - k) * ln(1 - v) + 2e0 * k * (k1 - n1) + 2e0 * (n - k) * (r1 - n1))
  / sqrt(4e0 * k * k * (n2 - k2) + 4e0 * (n - k) * (n - k) * (n2 - r2) - 8e0 * k * (n - k) * (pi() * pi() / 6 - n2))
  + 0.5e0 * ln(4e0 * k * (n - k) / (n * n)) AS wlr FROM wj)"""


@query(
    "sums_table",
    f"""WITH {WLR_SQL} SELECT particle, segment, k, n, round(k1 - n1, 8) AS u_k, round(r1 - n1, 8) AS u_nk,
  round(n2 - k2, 8) AS v2_k, round(n2 - r2, 8) AS v2_nk, round(pi() * pi() / 6 - n2, 8) AS sig_e FROM wj""",
)
def sums_table(spark, folder):
    """Expectation and variance sums of every photon's place in its segment."""
    sums = segment_sums(demo.indexed_photons(spark, folder), SEGMENT)
    rounded = {c: F.round(c, 8) for c in ("u_k", "u_nk", "v2_k", "v2_nk", "sig_e")}
    return sums.withColumns(rounded).select("particle", "segment", "k", "n", *rounded)


@query("cpa_wlr", f"WITH {WLR_SQL} SELECT particle, segment, k, round(wlr, 4) AS wlr FROM wl")
def cpa_wlr(spark, folder):
    """Likelihood ratio of every photon in consecutive segments of the whole stream."""
    return segment_series(demo.indexed_photons(spark, folder), SEGMENT).withColumn("wlr", F.round("wlr", 4))


@query(
    "cpa_segments",
    f"""WITH {WLR_SQL} SELECT particle, segment, arg_max(k, wlr) AS k, round(max(wlr), 4) AS wlr FROM wl GROUP BY ALL""",
)
def cpa_segments(spark, folder):
    """Best candidate of each segment."""
    series = segment_series(demo.indexed_photons(spark, folder), SEGMENT)
    return series.groupBy("particle", "segment").agg(
        F.max_by("k", "wlr").alias("k"), F.round(F.max("wlr"), 4).alias("wlr")
    )


@query("cpa_find_all")
def cpa_find_all(spark, folder):
    return find_change_points(demo.indexed_photons(spark, folder))


@query(
    "cpa_end_time",
    f"WITH {PHOTONS_SQL} SELECT particle, photon_ind, abs_ns FROM ph WHERE abs_ns <= 1000000e0 * 1e9",
)
def cpa_end_time(spark, folder):
    return until(demo.indexed_photons(spark, folder), 1_000_000.0).select("particle", "photon_ind", "abs_ns")


GAP_US = 600_000_000
LEAST, LONGEST_US = 3, 3_600_000_000


@query(
    "stream_bursts",
    f"""WITH {PHOTONS_SQL}, gp AS (SELECT *, CASE WHEN abs_ns - lag(abs_ns) OVER w < {GAP_US * 1000} THEN 0 ELSE 1 END AS opens
  FROM ph WINDOW w AS (PARTITION BY particle ORDER BY photon_ind)),
ru AS (SELECT *, sum(opens) OVER (PARTITION BY particle ORDER BY photon_ind) AS run FROM gp)
SELECT particle, min(abs_ns) AS start_ns, max(abs_ns) AS end_ns, count(*) AS num_photons FROM ru GROUP BY particle, run
HAVING count(*) >= {LEAST} AND max(abs_ns) - min(abs_ns) < {LONGEST_US * 1000}""",
)
def stream_bursts(spark, folder):
    """Photon files as a stream; a closing marker behind the last photon lets the watermark finish the last runs."""
    from luxframe.plans.scans import scratch
    from luxframe.streaming import bursts
    from luxframe.streaming.live import photon_stream

    path, target, state = (scratch(spark, name) for name in ("photons", "bursts", "state"))
    columns = ["particle", "channel", "abs_ns", "micro_ns"]
    photons = demo.photons(spark, folder).select(*columns)
    photons.write.parquet(path)
    written = len(spark.read.parquet(path).inputFiles())
    far = (F.max("abs_ns") + 1_000_000_000 * 86_400).alias("abs_ns")
    marker = photons.agg(far).select(
        F.lit(None).cast("string").alias("particle"), F.lit(0).alias("channel"), "abs_ns", F.lit(0.0).alias("micro_ns")
    )
    marker.where("abs_ns IS NOT NULL").write.mode("append").parquet(path)
    runs = bursts.photon_runs(photon_stream(spark, path, max(written, 1)), GAP_US)
    return bursts.bursts(bursts.replayed(spark, runs, target, state), LEAST, LONGEST_US * 1000)


@query("sql_change_points")
def sql_change_points(spark, folder):
    """``cpa_find_all`` asked in SQL text."""
    from luxframe.operators import change_point_sql

    change_point_sql.register(spark, demo.indexed_photons(spark, folder))
    return spark.sql("SELECT * FROM change_points(TABLE(photon_chunks) PARTITION BY (particle, chunk) ORDER BY (photon_ind))")


REPLAYED_PARTS = 4


@query("stream_change_points")
def stream_change_points(spark, folder):
    """The measurement arrives in parts of equal length; the stream is stopped after each and goes on from its checkpoint."""
    from luxframe.plans.scans import scratch
    from luxframe.streaming import bursts
    from luxframe.streaming.change_points import track_change_points
    from luxframe.streaming.live import PHOTON_FILES, photon_stream

    path, target, state = (scratch(spark, name) for name in ("photons", "points", "state"))
    photons = demo.photons(spark, folder).select("particle", "channel", "abs_ns", "micro_ns")
    first, last = photons.agg(F.min("abs_ns"), F.max("abs_ns")).first()
    if first is None:
        photons.write.parquet(path)
        return spark.createDataFrame([], "particle string, cpt_ind bigint, region_lo bigint, region_hi bigint, wlr double")
    whole_s = (last - first) // 1_000_000_000 + 1  # no pause of this measurement ends a recording
    borders = [first + (last - first) * part // REPLAYED_PARTS for part in range(REPLAYED_PARTS)] + [last + 1]
    for low, high in zip(borders, borders[1:]):
        photons.where((F.col("abs_ns") >= low) & (F.col("abs_ns") < high)).write.mode("append").parquet(path)
        files = len(spark.read.schema(PHOTON_FILES).parquet(path).inputFiles())
        bursts.replayed(spark, track_change_points(photon_stream(spark, path, files), idle_s=whole_s), target, state)
    marker = spark.range(1).select(
        F.lit(None).cast("string").alias("particle"),
        F.lit(0).alias("channel"),
        F.lit(last + (whole_s + 3600) * 1_000_000_000).alias("abs_ns"),
        F.lit(0.0).alias("micro_ns"),
    )
    marker.write.mode("append").parquet(path)
    points = bursts.replayed(spark, track_change_points(photon_stream(spark, path), idle_s=whole_s), target, state)
    return points.drop("recording")
