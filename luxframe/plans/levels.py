"""Levels, bursts and regions of interest."""

from __future__ import annotations

from pyspark.sql import functions as F

from luxframe.config import BurstSettings
from luxframe.operators import bursts, levels as ops, roi
from luxframe.plans.catalog import query
from luxframe.session import settle
from luxframe.sources import demo
from luxframe.sources.demo import LEVELS_SQL, LINES_SQL, PHOTONS_SQL

BURSTS = BurstSettings(min_dwell_s=0.02, sigma=1.0)


def level_bounds(spark, folder):
    """Photons with positions, and the levels between the true change points."""
    photons = demo.stored_photons(spark, folder)
    return photons, ops.define_levels(demo.true_change_points(photons), ops.photon_totals(photons))


def stats(spark, folder):
    return ops.level_stats(*level_bounds(spark, folder))


@query("define_levels", f"WITH {LEVELS_SQL} SELECT particle, level_ind, first_ind, last_ind FROM lv")
def define_levels(spark, folder):
    return level_bounds(spark, folder)[1]


@query(
    "define_levels_overlapping",
    f"""WITH {LEVELS_SQL}, m AS (SELECT particle, max(level_ind) AS top FROM lv GROUP BY ALL)
SELECT lv.particle, level_ind, first_ind, last_ind + CASE WHEN level_ind > 0 AND level_ind < top - 1 THEN 1 ELSE 0 END
  AS last_ind FROM lv JOIN m ON m.particle = lv.particle""",
)
def define_levels_overlapping(spark, folder):
    """Index ranges that count a boundary photon twice, for comparison with older results."""
    photons = demo.indexed_photons(spark, folder)
    cpts = demo.true_change_points(photons)
    return ops.define_levels(cpts, ops.photon_totals(photons), overlapping=True)


@query(
    "join_level_photons",
    f"""WITH {LEVELS_SQL} SELECT ph.particle, photon_ind, level_ind FROM ph JOIN lv ON lv.particle = ph.particle
  AND photon_ind BETWEEN first_ind AND last_ind""",
)
def join_level_photons(spark, folder):
    return ops.photons_in_levels(*level_bounds(spark, folder)).select("particle", "photon_ind", "level_ind")


@query(
    "level_stats",
    f"""WITH {LEVELS_SQL} SELECT particle, level_ind, first_ind, last_ind, start_ns, end_ns, num_photons,
  round(dwell_s, 6) AS dwell_s, round(int_p_s * 1e6, 4) AS int_p_ms FROM lv""",
)
def level_stats(spark, folder):
    return stats(spark, folder).select(
        "particle",
        "level_ind",
        "first_ind",
        "last_ind",
        "start_ns",
        "end_ns",
        "num_photons",
        F.round("dwell_s", 6).alias("dwell_s"),
        F.round(F.col("int_p_s") * 1e6, 4).alias("int_p_ms"),
    )


@query(
    "particle_stats",
    f"""WITH {LEVELS_SQL}, l AS (SELECT particle, count(*) AS num_levels FROM lv GROUP BY ALL)
SELECT p.particle, p.num_photons, p.dwell_s, l.num_levels FROM
 (SELECT particle, count(*) AS num_photons, round((max(abs_ns) - min(abs_ns)) / 1e9, 6) AS dwell_s FROM ph GROUP BY ALL) p
 JOIN l ON l.particle = p.particle""",
)
def particle_stats(spark, folder):
    photons, bounds = level_bounds(spark, folder)
    return ops.particle_stats(photons, bounds).withColumn("dwell_s", F.round("dwell_s", 6))


MEAN_SQL = f"""{LINES_SQL},
mn AS (SELECT particle, sum(dwell_s * int_p_s) / sum(dwell_s) AS mean_int FROM ln GROUP BY ALL),
sd AS (SELECT ln.particle, min(mean_int) AS mean_int,
  sqrt(sum(dwell_s * power(int_p_s - mean_int, 2)) / sum(dwell_s)) AS std_int
  FROM ln JOIN mn ON mn.particle = ln.particle GROUP BY ALL)"""


@query(
    "weighted_mean_std",
    f"WITH {MEAN_SQL} SELECT particle, round(mean_int, 4) AS mean_int, round(std_int, 4) AS std_int FROM sd",
)
def weighted_mean_std(spark, folder):
    lines = demo.line_levels(spark, folder, ordered=False)
    return ops.weighted_mean_std(lines).select(
        "particle", F.round("mean_int", 4).alias("mean_int"), F.round("std_int", 4).alias("std_int")
    )


BURST_SQL = f"""{MEAN_SQL},
bu AS (SELECT ln.*, int_p_s > mean_int + std_int * {BURSTS.sigma}e0 AND dwell_s < {BURSTS.min_dwell_s}e0 AS is_burst
  FROM ln JOIN sd ON sd.particle = ln.particle)"""


def line_bursts(spark, folder):
    return bursts.detect_bursts(demo.line_levels(spark, folder), BURSTS)


@query("detect_bursts", f"WITH {BURST_SQL} SELECT particle, level_ind, is_burst FROM bu")
def detect_bursts(spark, folder):
    return bursts.detect_bursts(demo.line_levels(spark, folder), BURSTS).select("particle", "level_ind", "is_burst")


@query(
    "detect_bursts_absolute",
    f"WITH {LINES_SQL} SELECT particle, level_ind, int_p_s > 5000 AND dwell_s < 0.05e0 AS is_burst FROM ln",
)
def detect_bursts_absolute(spark, folder):
    rules = BurstSettings(min_dwell_s=0.05, use_sigma=False, absolute_int=5000.0)
    judged = bursts.detect_bursts(demo.line_levels(spark, folder), rules)
    return judged.select("particle", "level_ind", "is_burst")


MERGE_SQL = f"""{BURST_SQL},
nb AS (SELECT particle, level_ind, num_photons, dwell_ms, is_burst, lag(int_p_s) OVER w AS l, lead(int_p_s) OVER w AS r,
  coalesce(max(CASE WHEN NOT is_burst THEN level_ind END) OVER (PARTITION BY particle), -1) AS steady FROM bu
  WINDOW w AS (PARTITION BY particle ORDER BY level_ind)),
dr AS (SELECT *, CASE WHEN NOT is_burst THEN NULL WHEN level_ind = 0 THEN false WHEN level_ind > steady THEN true
  ELSE NOT (r > l) END AS goes_left FROM nb),
st AS (SELECT *, min(CASE WHEN NOT coalesce(goes_left, false) THEN level_ind END) OVER (PARTITION BY particle
  ORDER BY level_ind ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop FROM dr),
dp AS (SELECT DISTINCT particle, CASE WHEN goes_left THEN level_ind ELSE stop END AS level_ind FROM st
  WHERE goes_left IS NOT NULL),
mi AS (SELECT st.*, CAST(sum(CASE WHEN dp.level_ind IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY st.particle
  ORDER BY st.level_ind) - 1 AS BIGINT) AS merged_ind FROM st
  LEFT JOIN dp ON dp.particle = st.particle AND dp.level_ind = st.level_ind)"""


@query("remove_bursts", f"WITH {MERGE_SQL} SELECT particle, merged_ind, count(*) AS num_merged, CAST(sum(num_photons) AS BIGINT) AS num_photons, CAST(sum(dwell_ms) AS BIGINT) AS dwell_ms FROM mi GROUP BY ALL")
def remove_bursts(spark, folder):
    merged = bursts.burst_merges(line_bursts(spark, folder))
    return merged.groupBy("particle", "merged_ind").agg(
        F.count(F.lit(1)).alias("num_merged"), F.sum("num_photons").alias("num_photons"), F.sum("dwell_ms").alias("dwell_ms")
    )


@query(
    "levels_without_bursts",
    f"""WITH {MERGE_SQL}, jn AS (SELECT mi.particle, merged_ind AS level_ind, min(end_ms - ln.dwell_ms) AS b, max(end_ms) AS e,
  CAST(sum(mi.num_photons) AS BIGINT) AS num_photons, count(*) AS num_merged FROM mi
  JOIN ln ON ln.particle = mi.particle AND ln.level_ind = mi.level_ind GROUP BY ALL)
SELECT particle, level_ind, round(b / 1000e0, 3) AS start_s, round(e / 1000e0, 3) AS end_s, num_photons, num_merged,
  round((e - b) / 1000e0, 3) AS dwell_s, round(num_photons / ((e - b) / 1000e0), 3) AS int_p_s FROM jn""",
)
def levels_without_bursts(spark, folder):
    """The level table that remains: times, photons and intensities of the joined levels."""
    joined = bursts.merged_levels(bursts.burst_merges(line_bursts(spark, folder)))
    return joined.withColumns({c: F.round(c, 3) for c in ("start_s", "end_s", "dwell_s", "int_p_s")})


@query("restore_bursts", f"WITH {LINES_SQL} SELECT particle, level_ind, num_photons FROM ln")
def restore_bursts(spark, folder):
    """The levels as they were saved before the removal."""
    from luxframe.plans.scans import scratch
    from luxframe.sources import saved

    path = scratch(spark, "before-removal")
    saved.save_analysis({"levels": line_bursts(spark, folder)}, path)
    return saved.load_analysis(spark, path, ["levels"])["levels"].select("particle", "level_ind", "num_photons")


@query(
    "level_at_time",
    f"""WITH {LEVELS_SQL}, pr AS (SELECT particle, first_ind, start_ns + (end_ns - start_ns) // 2 AS t_ns FROM lv)
SELECT pr.particle, t_ns, min(level_ind) AS level_ind FROM pr JOIN lv ON lv.particle = pr.particle
  AND t_ns BETWEEN start_ns AND end_ns GROUP BY ALL""",
)
def level_at_time(spark, folder):
    found = stats(spark, folder)
    middle = F.col("start_ns") + F.floor((F.col("end_ns") - F.col("start_ns")) / 2).cast("bigint")
    return ops.level_at_time(found, found.select("particle", middle.alias("t_ns")))


ROI_SQL = (
    PHOTONS_SQL
    + """,
rg AS (SELECT particle, max(abs_ns) / 1e9 * 0.25e0 AS s, max(abs_ns) / 1e9 * 0.75e0 AS e, max(abs_ns) / 1e9 AS stop,
  count(*) AS n FROM ph GROUP BY ALL),
rb AS (SELECT ph.particle, coalesce(min(CASE WHEN abs_ns / 1e9 >= s THEN photon_ind END), 0) AS first_photon,
  coalesce(min(CASE WHEN abs_ns / 1e9 >= e THEN photon_ind END), min(n) - 1) AS last_photon
  FROM ph JOIN rg ON rg.particle = ph.particle GROUP BY ALL)"""
)


def middle_half(photons):
    return roi.full_roi(photons).select(
        "particle", (F.col("roi_end_s") * 0.25).alias("roi_start_s"), (F.col("roi_end_s") * 0.75).alias("roi_end_s")
    )


@query("roi_photon_bounds", f"WITH {ROI_SQL} SELECT particle, first_photon, last_photon FROM rb")
def roi_photon_bounds(spark, folder):
    photons = demo.indexed_photons(spark, folder)
    return roi.photon_bounds(photons, middle_half(photons))


@query("roi_photon_count", f"WITH {ROI_SQL} SELECT particle, last_photon - first_photon AS num_photons_roi FROM rb")
def roi_photon_count(spark, folder):
    return roi.photon_count(roi_photon_bounds(spark, folder))


@query(
    "roi_microtimes",
    f"""WITH {ROI_SQL} SELECT ph.particle, photon_ind, micro_ns FROM ph JOIN rb ON rb.particle = ph.particle
WHERE photon_ind BETWEEN first_photon AND last_photon""",
)
def roi_microtimes(spark, folder):
    photons = demo.indexed_photons(spark, folder)
    return roi.microtimes(photons, middle_half(photons))


@query(
    "roi_reset",
    f"WITH {PHOTONS_SQL} SELECT particle, 0e0 AS roi_start_s, max(abs_ns) / 1e9 AS roi_end_s FROM raw GROUP BY ALL",
)
def roi_reset(spark, folder):
    return roi.full_roi(demo.photons(spark, folder))


@query(
    "roi_set",
    f"""WITH {PHOTONS_SQL}, f AS (SELECT particle, max(abs_ns) / 1e9 AS e FROM raw GROUP BY ALL)
SELECT particle, CASE WHEN length(particle) > 5 THEN e * 0.25e0 ELSE 0e0 END AS roi_start_s,
  CASE WHEN length(particle) > 5 THEN e * 0.75e0 ELSE e END AS roi_end_s, length(particle) > 5 AS changed FROM f""",
)
def roi_set(spark, folder):
    """A wide request is taken over, one within the tolerance is not."""
    photons = demo.photons(spark, folder)
    current = roi.full_roi(photons)
    near = current.select("particle", (F.col("roi_start_s") + 0.05).alias("roi_start_s"), "roi_end_s")
    wide = F.length("particle") > 5
    wanted = middle_half(photons).where(wide).unionByName(near.where(~wide))
    return roi.set_roi(current, wanted)


LINE_ROI_SQL = f"""{LINES_SQL},
lr AS (SELECT particle, max(end_s) * 0.3e0 AS s, max(end_s) * 0.8e0 AS e FROM ln GROUP BY ALL),
lb AS (SELECT ln.particle, coalesce(min(CASE WHEN end_s > s THEN level_ind END), 0) AS first_level,
  coalesce(min(CASE WHEN round_even(end_s, 3) >= round_even(e, 3) THEN level_ind END), 0) AS last_level
  FROM ln JOIN lr ON lr.particle = ln.particle GROUP BY ALL)"""


def line_roi(lines):
    return lines.groupBy("particle").agg(
        (F.max("end_s") * 0.3).alias("roi_start_s"), (F.max("end_s") * 0.8).alias("roi_end_s")
    )


@query(
    "roi_levels",
    f"""WITH {LINE_ROI_SQL} SELECT ln.particle, level_ind, num_photons FROM ln JOIN lb ON lb.particle = ln.particle
WHERE level_ind BETWEEN first_level AND last_level""",
)
def roi_levels(spark, folder):
    lines = demo.line_levels(spark, folder)
    return roi.levels_in_roi(lines, line_roi(lines)).select("particle", "level_ind", "num_photons")


@query(
    "roi_level_ints",
    f"""WITH {LINE_ROI_SQL} SELECT ln.particle, level_ind, round(int_p_s, 4) AS int_p_s FROM ln
JOIN lb ON lb.particle = ln.particle WHERE level_ind >= first_level AND level_ind < last_level""",
)
def roi_level_ints(spark, folder):
    """Intensities of the region without its last level."""
    lines = demo.line_levels(spark, folder)
    inside = roi.levels_in_roi(lines, line_roi(lines), last_included=False)
    return inside.select("particle", "level_ind", F.round("int_p_s", 4).alias("int_p_s"))


@query(
    "roi_dwell",
    f"""WITH {LINE_ROI_SQL} SELECT ln.particle, round(max(end_s) - min(start_s), 6) AS dwell_roi_s,
  count(*) AS num_levels_roi, CAST(sum(num_photons) AS BIGINT) AS num_photons_roi FROM ln
JOIN lb ON lb.particle = ln.particle WHERE level_ind BETWEEN first_level AND last_level GROUP BY ALL""",
)
def roi_dwell(spark, folder):
    lines = demo.line_levels(spark, folder)
    return roi.dwell(lines, line_roi(lines)).withColumn("dwell_roi_s", F.round("dwell_roi_s", 6))


TRIM_INT = 30_000.0
TRIM_SQL = f"""{LINES_SQL},
tf AS (SELECT particle, max(level_ind) AS last, arg_max(int_p_s, level_ind) AS last_int,
  coalesce(max(CASE WHEN int_p_s > {TRIM_INT}e0 THEN level_ind END), 0) AS stop FROM ln GROUP BY ALL),
tt AS (SELECT ln.particle, min(stop) AS stop, min(last_int) AS last_int,
  sum(CASE WHEN level_ind >= stop AND (level_ind > stop OR int_p_s <= {TRIM_INT}e0) THEN dwell_s ELSE 0 END) AS tail_s,
  max(CASE WHEN level_ind = stop THEN end_s END) AS active FROM ln JOIN tf ON tf.particle = ln.particle GROUP BY ALL)"""


@query(
    "trim_trace",
    f"""WITH {TRIM_SQL}, o AS (SELECT *, CASE WHEN last_int < {TRIM_INT}e0 THEN tail_s >= 0.5e0 AND stop > 1 END AS trimmed
  FROM tt)
SELECT particle, trimmed, round(tail_s, 6) AS tail_s, CASE WHEN trimmed THEN 0e0 END AS roi_start_s,
  round(CASE WHEN trimmed THEN active END, 6) AS roi_end_s, CASE WHEN trimmed THEN stop END AS roi_last_level FROM o""",
)
def trim_trace(spark, folder):
    trimmed = roi.trim_trace(demo.line_levels(spark, folder), 0.5, TRIM_INT)
    return trimmed.withColumns({"tail_s": F.round("tail_s", 6), "roi_end_s": F.round("roi_end_s", 6)})


@query(
    "trim_trace_keep_roi",
    f"""WITH {TRIM_SQL}, lr AS (SELECT particle, max(end_s) * 0.3e0 AS s, max(end_s) * 0.8e0 AS e FROM ln GROUP BY ALL),
k AS (SELECT tt.*, CASE WHEN active - s > 0.5e0 THEN s ELSE active - 0.5e0 END AS ns, least(active, e) AS ne
  FROM tt JOIN lr ON lr.particle = tt.particle),
o AS (SELECT *, CASE WHEN last_int < {TRIM_INT}e0 THEN tail_s >= 0.5e0 AND stop > 1 AND ns >= 0 END AS trimmed FROM k)
SELECT particle, trimmed, round(tail_s, 6) AS tail_s, round(CASE WHEN trimmed THEN ns END, 6) AS roi_start_s,
  round(CASE WHEN trimmed THEN ne END, 6) AS roi_end_s, CASE WHEN trimmed THEN stop END AS roi_last_level FROM o""",
)
def trim_trace_keep_roi(spark, folder):
    lines = demo.line_levels(spark, folder)
    trimmed = roi.trim_trace(lines, 0.5, TRIM_INT, line_roi(lines))
    return trimmed.withColumns({c: F.round(c, 6) for c in ("tail_s", "roi_start_s", "roi_end_s")})


@query(
    "lifetime_trace",
    f"""WITH {LINES_SQL} SELECT particle, level_ind, 0 AS vertex, round(start_s, 3) AS t, round(av_tau, 6) AS y FROM ln
WHERE av_tau IS NOT NULL UNION ALL
SELECT particle, level_ind, 1, round(end_s, 3), round(av_tau, 6) FROM ln WHERE av_tau IS NOT NULL""",
)
def lifetime_trace(spark, folder):
    curve = ops.lifetime_trace(demo.line_levels(spark, folder))
    return curve.withColumns({"t": F.round("t", 3), "y": F.round("y", 6)})


@query(
    "cpa_levels",
)
def cpa_levels(spark, folder):
    """Levels between detected change points."""
    from luxframe.operators.change_points import find_change_points
    photons = settle(demo.indexed_photons(spark, folder))
    totals = ops.photon_totals(photons)
    bounds = ops.define_levels(find_change_points(photons), totals.where("num_photons >= 200"))
    return ops.level_stats(photons, bounds)
