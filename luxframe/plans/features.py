"""Selection, filters, regression, normalisation, distributions and images."""

from __future__ import annotations

from pyspark.sql import functions as F

from luxframe.config import Bound, LevelFilter
from luxframe.operators import binning, decay_fit, filtering, imaging, selection
from luxframe.plans.catalog import query
from luxframe.plans.groups import GROUPED_SQL, grouped_lines
from luxframe.plans.levels import stats
from luxframe.plans.traces import BIN_NS, TRACE_SQL, bin_trace
from luxframe.sources import demo
from luxframe.sources.demo import LEVELS_SQL, LINES_SQL, PHOTONS_SQL, table

RULES = LevelFilter(
    photons=Bound(minimum=100),
    intensity=Bound(500, 40_000),
    lifetime=Bound(maximum=8),
    chi_squared=Bound(0.8, 1.3),
    irf_shift=Bound(-1.5, 1.5),
    dw_test="5%",
)
KEYS = "particle, line_order, line_no, part_key"
DW5 = "round_even(2 - 3.312097e0 / 10 - 3.332536e0 / 100 - 3.632166e0 / 1000 + 19.31135e0 / 10000, 3)"
FITTED_SQL = f"""{LINES_SQL}, fl AS (SELECT *, CASE WHEN av_tau IS NOT NULL THEN {DW5} END AS dw_5 FROM ln1)"""
PASS_SQL = f"""coalesce(num_photons >= 100, false) AND coalesce(int_p_s >= 500 AND int_p_s <= 40000, false)
  AND coalesce(av_tau <= 8, false) AND coalesce(dw >= dw_5, false) AND coalesce(irf_shift >= -1.5e0 AND irf_shift <= 1.5e0, false)
  AND coalesce(chisq >= 0.8e0 AND chisq <= 1.3e0, false)"""


def fitted_lines(spark, folder):
    bound = decay_fit.dw_bound(F.lit(100.0), 1, 5)
    lines = demo.line_levels(spark, folder, ordered=False)
    return lines.withColumn("dw_5", F.when(F.col("av_tau").isNotNull(), bound))


@query(
    "filter_levels_ui",
    f"""WITH {FITTED_SQL} SELECT {KEYS}, CASE WHEN num_photons >= 100 THEN num_photons END AS num_photons,
  round(CASE WHEN int_p_s >= 500 AND int_p_s <= 40000 THEN int_p_s END, 4) AS int_p_s,
  round(CASE WHEN av_tau <= 8 THEN av_tau END, 6) AS av_tau, round(CASE WHEN dw >= dw_5 THEN dw END, 6) AS dw,
  round(CASE WHEN irf_shift >= -1.5e0 AND irf_shift <= 1.5e0 THEN irf_shift END, 6) AS irf_shift,
  round(CASE WHEN chisq >= 0.8e0 AND chisq <= 1.3e0 THEN chisq END, 6) AS chisq FROM fl""",
)
def filter_levels_ui(spark, folder):
    masked = filtering.masked_features(fitted_lines(spark, folder), RULES)
    digits = {"int_p_s": 4, "av_tau": 6, "dw": 6, "irf_shift": 6, "chisq": 6}
    return masked.select(
        "particle", "line_order", "line_no", "part_key", "num_photons", *[F.round(c, d).alias(c) for c, d in digits.items()]
    )


@query("filter_levels_all", f"WITH {FITTED_SQL} SELECT {KEYS}, NOT ({PASS_SQL}) AS is_filtered_out FROM fl")
def filter_levels_all(spark, folder):
    judged = filtering.filter_all(fitted_lines(spark, folder), RULES)
    return judged.select("particle", "line_order", "line_no", "part_key", "is_filtered_out")


FAILED = {
    "failed_photon_min": "num_photons < 100",
    "failed_int_max": "int_p_s > 40000",
    "failed_int_min": "int_p_s < 500",
    "failed_tau_max": "av_tau > 8",
    "failed_dw_5": "dw < dw_5",
    "failed_irf_max": "irf_shift > 1.5e0",
    "failed_irf_min": "irf_shift < -1.5e0",
    "failed_chisq_max": "chisq > 1.3e0",
    "failed_chisq_min": "chisq < 0.8e0",
}


def _export_sql(unknown: str) -> str:
    tests = {name: f"coalesce({test}, {unknown})" for name, test in FAILED.items()}
    columns = ", ".join(f"{test} AS {name}" for name, test in tests.items())
    return f"WITH {FITTED_SQL} SELECT {KEYS}, {columns}, {' OR '.join(tests.values())} AS is_filtered_out FROM fl"


def _export(spark, folder, policy):
    judged = filtering.filter_export(fitted_lines(spark, folder), RULES, policy)
    return judged.select("particle", "line_order", "line_no", "part_key", *FAILED, "is_filtered_out")


@query("filter_levels_export", _export_sql("false"))
def filter_levels_export(spark, folder):
    return _export(spark, folder, "pass")


@query("filter_levels_export_strict", _export_sql("true"))
def filter_levels_export_strict(spark, folder):
    return _export(spark, folder, "fail")


@query(
    "count_datapoints",
    f"""WITH {FITTED_SQL} SELECT count(*) FILTER (av_tau IS NOT NULL) AS unfiltered, count(*) FILTER (av_tau <= 8) AS filtered
FROM fl""",
)
def count_datapoints(spark, folder):
    return filtering.count_datapoints(fitted_lines(spark, folder), "av_tau", RULES)


@query(
    "two_feature_scatter",
    f"""WITH {FITTED_SQL} SELECT {KEYS}, round(int_p_s, 4) AS int_p_s, round(av_tau, 6) AS av_tau FROM fl WHERE {PASS_SQL}""",
)
def two_feature_scatter(spark, folder):
    points = filtering.feature_pairs(fitted_lines(spark, folder), "int_p_s", "av_tau", RULES)
    return points.select(
        "particle", "line_order", "line_no", "part_key", F.round("int_p_s", 4).alias("int_p_s"), F.round("av_tau", 6).alias("av_tau")
    )


@query(
    "level_source",
    f"""WITH {GROUPED_SQL} SELECT particle, line_order, line_no, part_key, num_photons, false AS is_grouped FROM gl
UNION ALL SELECT particle, NULL, NULL, NULL, num_photons, true FROM gs""",
)
def level_source(spark, folder):
    """Resolved levels and groups side by side."""
    from luxframe.operators.grouping import group_stats

    lines = grouped_lines(spark, folder, ordered=False)
    resolved = lines.select("particle", "line_order", "line_no", "part_key", "num_photons", F.lit(False).alias("is_grouped"))
    groups = group_stats(lines).select("particle", "num_photons", F.lit(True).alias("is_grouped"))
    return resolved.unionByName(groups, allowMissingColumns=True)


OLS_SQL = f"""{LINES_SQL}, pt AS (SELECT particle, num_photons AS x, av_tau AS y FROM ln1 WHERE av_tau IS NOT NULL),
rg AS (SELECT particle, count(*) AS n, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy, avg(x) AS mx,
  avg(y) AS my FROM pt GROUP BY ALL),
rs AS (SELECT *, sxy / sxx AS slope, greatest(syy - sxy / sxx * sxy, 0) AS sse FROM rg)"""


@query(
    "ols_int_lifetime",
    f"""WITH {OLS_SQL} SELECT particle, n, round(slope, 7) AS slope, round(sqrt(sse / (n - 2) / sxx), 7) AS slope_err,
  round(my - slope * mx, 5) AS intercept, round(sqrt(sse / (n - 2) * (1e0 / n + mx * mx / sxx)), 5) AS intercept_err,
  round(1 - sse / syy, 6) AS r2 FROM rs""",
)
def ols_int_lifetime(spark, folder):
    fit = filtering.regression(demo.line_levels(spark, folder, ordered=False), ["particle"], "num_photons", "av_tau")
    digits = {"slope": 7, "slope_err": 7, "intercept": 5, "intercept_err": 5, "r2": 6}
    return fit.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(
    "ols_through_origin",
    f"""WITH {OLS_SQL}, o AS (SELECT particle, count(*) AS n, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM pt
  GROUP BY ALL), q AS (SELECT *, sxy / sxx AS slope, greatest(syy - sxy / sxx * sxy, 0) AS sse FROM o)
SELECT particle, n, round(slope, 7) AS slope, round(sqrt(sse / (n - 1) / sxx), 7) AS slope_err,
  round(1 - sse / syy, 6) AS r2 FROM q""",
)
def ols_through_origin(spark, folder):
    lines = demo.line_levels(spark, folder, ordered=False)
    fit = filtering.regression(lines, ["particle"], "num_photons", "av_tau", through_origin=True)
    digits = {"slope": 7, "slope_err": 7, "r2": 6}
    return fit.withColumns({c: F.round(c, d) for c, d in digits.items()}).drop("intercept", "intercept_err")


@query(
    "regression_curve",
    f"""WITH {OLS_SQL}, t AS (SELECT particle, CAST(max(num_photons) AS DOUBLE) AS top FROM ln1 GROUP BY ALL),
s AS (SELECT rs.particle, slope, my - slope * mx AS b, top, UNNEST(range(0, 100)) AS step FROM rs JOIN t ON t.particle = rs.particle)
SELECT particle, CAST(step AS INTEGER) AS step, round(top * step / 99, 5) AS x, round(b + slope * (top * step / 99), 5) AS y FROM s""",
)
def regression_curve(spark, folder):
    lines = demo.line_levels(spark, folder, ordered=False)
    fit = filtering.regression(lines, ["particle"], "num_photons", "av_tau")
    curve = filtering.regression_curve(fit, lines, ["particle"], "num_photons")
    return curve.withColumns({"x": F.round("x", 5), "y": F.round("y", 5)})


def _normal_sql(changes: str) -> str:
    return f"""WITH {FITTED_SQL}, j AS (SELECT *, NOT ({PASS_SQL}) AS is_filtered_out, (av_tau - 0.5e0) / 0.0005e0 AS pred FROM fl),
c AS (SELECT *, ({changes}) AS ch FROM j),
m AS (SELECT *, CASE WHEN ch THEN CAST(round_even(pred * dwell_s, 0) AS BIGINT) ELSE num_photons END AS nn FROM c)
SELECT {KEYS}, nn AS num_photons, round(CASE WHEN ch THEN nn / dwell_s ELSE int_p_s END, 4) AS int_p_s,
  num_photons AS unnorm_num_photons, NOT is_filtered_out AND av_tau IS NOT NULL AS is_normalized FROM m"""


def _normalised(spark, folder, drift):
    judged = filtering.filter_all(fitted_lines(spark, folder), RULES)
    return filtering.normalise(judged, F.lit(0.0005), F.lit(0.5), drift)


def _normal_columns(levels):
    return levels.select(
        "particle", "line_order", "line_no", "part_key", "num_photons", F.round("int_p_s", 4).alias("int_p_s"),
        "unnorm_num_photons", "is_normalized",
    )


@query("normalise_intensity", _normal_sql("NOT is_filtered_out AND av_tau IS NOT NULL"))
def normalise_intensity(spark, folder):
    return _normal_columns(_normalised(spark, folder, False))


@query("normalise_only_drift", _normal_sql("NOT is_filtered_out AND av_tau IS NOT NULL AND pred < int_p_s"))
def normalise_only_drift(spark, folder):
    return _normal_columns(_normalised(spark, folder, True))


@query(
    "normalise_undo",
    f"WITH {LINES_SQL} SELECT {KEYS}, num_photons, round(int_p_s, 4) AS int_p_s, false AS is_normalized FROM ln1",
)
def normalise_undo(spark, folder):
    restored = filtering.undo_normalise(_normalised(spark, folder, False))
    return restored.select(
        "particle", "line_order", "line_no", "part_key", "num_photons", F.round("int_p_s", 4).alias("int_p_s"), "is_normalized"
    )


@query(
    "feature_hist",
    f"""WITH {LINES_SQL}, x AS (SELECT av_tau AS x FROM ln1 WHERE av_tau IS NOT NULL),
b AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 10 AS w FROM x),
c AS (SELECT CAST(least(floor((x - lo) / w), 9) AS BIGINT) AS bin, count(*) AS n FROM x, b GROUP BY ALL),
s AS (SELECT UNNEST(range(0, 10)) AS bin, lo, w FROM b)
SELECT s.bin, round(lo + s.bin * w, 5) AS left_edge, coalesce(n, 0) AS counts FROM s LEFT JOIN c ON c.bin = s.bin""",
)
def feature_hist(spark, folder):
    hist = binning.feature_hist(demo.line_levels(spark, folder, ordered=False), "av_tau", 10)
    return hist.withColumn("left_edge", F.round("left_edge", 5))


@query(
    "feature_hist_auto",
    f"""WITH {LINES_SQL}, x AS (SELECT int_p_s AS x FROM ln1),
f AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM x),
g AS (SELECT *, (hi - lo) / (log2(n) + 1) AS st, 2 * iqr / power(n, 1e0 / 3) AS fd FROM f),
k AS (SELECT lo, hi, CAST(greatest(ceil((hi - lo) / CASE WHEN fd = 0 THEN st ELSE least(st, fd) END), 1) AS BIGINT) AS bins FROM g),
b AS (SELECT lo, bins, (hi - lo) / bins AS w FROM k),
c AS (SELECT CAST(least(floor((x - lo) / w), bins - 1) AS BIGINT) AS bin, count(*) AS n FROM x, b GROUP BY ALL),
s AS (SELECT UNNEST(range(0, bins)) AS bin, lo, w FROM b)
SELECT s.bin, round(lo + s.bin * w, 3) AS left_edge, coalesce(n, 0) AS counts FROM s LEFT JOIN c ON c.bin = s.bin""",
)
def feature_hist_auto(spark, folder):
    hist = binning.feature_hist(demo.line_levels(spark, folder, ordered=False), "int_p_s")
    return hist.withColumn("left_edge", F.round("left_edge", 3))


@query(
    "level_int_hist",
    f"""WITH {LEVELS_SQL}, {TRACE_SQL.split("raw GROUP BY ALL),", 1)[0].split("nb AS", 1)[1].join(["nb AS", "raw GROUP BY ALL),"])}
{TRACE_SQL.split("raw GROUP BY ALL),", 1)[1]},
e0 AS (SELECT particle, -max(counts) AS a, -min(counts) AS b FROM tr GROUP BY ALL),
e AS (SELECT particle, CASE WHEN a = b THEN a - 0.5e0 ELSE a END AS lo, CASE WHEN a = b THEN b + 0.5e0 ELSE b END AS hi FROM e0),
v AS (SELECT lv.particle, -(int_p_s * {BIN_NS / 1e9}e0) AS x, dwell_s, lo, hi FROM lv JOIN e ON e.particle = lv.particle),
h AS (SELECT particle, CAST(least(floor((x - lo) / ((hi - lo) / 100e0) + 1e-9), 99) AS BIGINT) AS bin, sum(dwell_s) AS n
  FROM v WHERE x BETWEEN lo AND hi GROUP BY ALL),
m AS (SELECT particle, max(n) AS top FROM h GROUP BY ALL), s AS (SELECT particle, top, UNNEST(range(0, 100)) AS bin FROM m)
SELECT s.particle, s.bin, round(coalesce(n, 0) / top, 6) AS frequency FROM s
LEFT JOIN h ON h.particle = s.particle AND h.bin = s.bin""",
)
def level_int_hist(spark, folder):
    hist = binning.level_int_hist(stats(spark, folder), bin_trace(spark, folder), BIN_NS / 1e6)
    return hist.withColumn("frequency", F.round("frequency", 6))


# Choosing particles.

CHOICE = "1-300,700,900-"


def numbered(spark, folder):
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("particle_number"), (F.col("p_size") > 25).alias("selected")
    )


NAMED_SQL = "(p_partkey BETWEEN 1 AND 300 OR p_partkey = 700 OR p_partkey >= 900)"


def _choose(mode, sql):
    name = f"select_particles_{mode}"

    @query(name, f"SELECT p_partkey AS particle_number, {sql} AS selected FROM part")
    def run(spark, folder):
        return selection.select_particles(numbered(spark, folder), CHOICE, mode)

    return run


select_only = _choose("only", NAMED_SQL)
select_add = _choose("add", f"p_size > 25 OR {NAMED_SQL}")
select_remove = _choose("remove", f"p_size > 25 AND NOT {NAMED_SQL}")
select_invert = _choose("invert", f"CASE WHEN {NAMED_SQL} THEN p_size <= 25 ELSE p_size > 25 END")


@query(
    "semi_selected",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)",
)
def semi_selected(spark, folder):
    chosen = numbered(spark, folder).where("selected").withColumnRenamed("particle_number", "l_partkey")
    rows = selection.scoped(table(spark, folder, "lineitem"), chosen, ["l_partkey"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey")


@query("anti_filtered", f"WITH {FITTED_SQL} SELECT {KEYS} FROM fl WHERE {PASS_SQL}")
def anti_filtered(spark, folder):
    judged = filtering.filter_all(fitted_lines(spark, folder), RULES)
    return judged.where(~F.col("is_filtered_out")).select("particle", "line_order", "line_no", "part_key")


@query(
    "card_filter",
    f"WITH {PHOTONS_SQL} SELECT particle, channel, count(*) AS num_photons FROM raw WHERE channel = 1 GROUP BY ALL",
)
def card_filter(spark, folder):
    kept = selection.card_filter(demo.photons(spark, folder), 1)
    return kept.groupBy("particle", "channel").agg(F.count(F.lit(1)).alias("num_photons"))


@query(
    "join_prim_sec",
    f"""WITH {PHOTONS_SQL}, c AS (SELECT particle, channel, count(*) AS n, min(abs_ns) AS t0 FROM raw GROUP BY ALL)
SELECT a.particle, a.n AS primary_photons, b.n AS secondary_photons, b.t0 - a.t0 AS start_gap_ns FROM c a
JOIN c b ON a.particle = b.particle AND a.channel = 1 AND b.channel = 2""",
)
def join_prim_sec(spark, folder):
    cards = demo.photons(spark, folder).groupBy("particle", "channel").agg(
        F.count(F.lit(1)).alias("n"), F.min("abs_ns").alias("t0")
    )
    first, second = (
        cards.where(F.col("channel") == c).select("particle", F.col("n").alias(f"n{c}"), F.col("t0").alias(f"t{c}")) for c in (1, 2)
    )
    return first.join(second, "particle").select(
        "particle", F.col("n1").alias("primary_photons"), F.col("n2").alias("secondary_photons"),
        (F.col("t2") - F.col("t1")).alias("start_gap_ns"),
    )


# Images and spectra.

RUNS_SQL = """pr AS (SELECT s_suppkey AS particle_ind, s_nationkey // 5 AS scan FROM supplier),
rs AS (SELECT *, CASE WHEN scan IS NOT DISTINCT FROM lag(scan) OVER (ORDER BY particle_ind) THEN 0 ELSE 1 END AS st FROM pr),
ru AS (SELECT particle_ind, scan, CAST(sum(st) OVER (ORDER BY particle_ind) - 1 AS BIGINT) AS raster_ind FROM rs)"""


def scanned(spark, folder):
    particles = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("particle_ind"), F.floor(F.col("s_nationkey") / 5).cast("bigint").alias("scan")
    )
    return imaging.raster_runs(particles, "scan", "particle_ind")


@query("raster_runs", f"WITH {RUNS_SQL} SELECT particle_ind, raster_ind FROM ru")
def raster_runs(spark, folder):
    return scanned(spark, folder).select("particle_ind", "raster_ind")


@query("unique_rasters", f"WITH {RUNS_SQL} SELECT DISTINCT raster_ind FROM ru")
def unique_rasters(spark, folder):
    return scanned(spark, folder).select("raster_ind").distinct()


@query(
    "join_particle_raster",
    f"WITH {RUNS_SQL} SELECT raster_ind, min(particle_ind) AS first_particle, count(*) AS particles FROM ru GROUP BY ALL",
)
def join_particle_raster(spark, folder):
    runs = scanned(spark, folder)
    rasters = runs.groupBy("raster_ind").agg(F.min("particle_ind").alias("first_particle"))
    return runs.join(rasters, "raster_ind").groupBy("raster_ind", "first_particle").agg(F.count(F.lit(1)).alias("particles"))


SPECTRA_SQL = """se AS (SELECT vec_id AS t_ind, CAST(label AS VARCHAR) AS particle, UNNEST(embedding) AS v, UNNEST(range(0, 64)) AS wl_ind
  FROM embeddings), sp AS (SELECT particle, t_ind, CAST(wl_ind AS INTEGER) AS wl_ind, CAST(v AS DOUBLE) AS counts FROM se)"""


def spectra(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("label").cast("string").alias("particle"),
        F.col("vec_id").alias("t_ind"),
        F.posexplode(F.col("embedding").cast("array<double>")).alias("wl_ind", "counts"),
    )


@query(
    "spectra_bg",
    f"""WITH {SPECTRA_SQL}, b AS (SELECT particle, avg(counts) AS bg FROM sp WHERE 63 - wl_ind BETWEEN 1 AND 4 GROUP BY ALL)
SELECT sp.particle, t_ind, wl_ind, round(counts - bg, 5) AS counts FROM sp JOIN b ON b.particle = sp.particle""",
)
def spectra_bg(spark, folder):
    return imaging.spectra_background(spectra(spark, folder)).withColumn("counts", F.round("counts", 5))


@query(
    "spectra_normalise",
    f"""WITH {SPECTRA_SQL}, b AS (SELECT particle, min(counts) AS lo, max(counts) AS hi FROM sp GROUP BY ALL)
SELECT sp.particle, t_ind, wl_ind, round((counts - lo) / (hi - lo), 6) AS counts FROM sp JOIN b ON b.particle = sp.particle""",
)
def spectra_normalise(spark, folder):
    return imaging.normalise_image(spectra(spark, folder)).withColumn("counts", F.round("counts", 6))


@query(
    "spectra_roi_mean",
    f"""WITH {SPECTRA_SQL} SELECT particle, wl_ind, round(avg(counts), 6) AS mean_counts FROM sp
WHERE t_ind BETWEEN 20 AND 400 AND wl_ind BETWEEN 8 AND 48 GROUP BY ALL""",
)
def spectra_roi_mean(spark, folder):
    mean = imaging.spectra_roi_mean(spectra(spark, folder), "time", (20, 400), (8, 48))
    return mean.withColumn("mean_counts", F.round("mean_counts", 6))


@query(
    "spectra_roi_mean_wavelength",
    f"""WITH {SPECTRA_SQL} SELECT particle, t_ind, round(avg(counts), 6) AS mean_counts FROM sp
WHERE t_ind BETWEEN 20 AND 400 AND wl_ind BETWEEN 8 AND 48 GROUP BY ALL""",
)
def spectra_roi_mean_wavelength(spark, folder):
    mean = imaging.spectra_roi_mean(spectra(spark, folder), "wavelength", (20, 400), (8, 48))
    return mean.withColumn("mean_counts", F.round("mean_counts", 6))
