"""Export tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from luxframe.functions.decay import FitModel
from luxframe.operators import binning, correlation, decay_fit, exporting, grouping, imaging, levels as level_ops, roi, selection
from luxframe.plans.catalog import ORACLES, QUERIES, query
from luxframe.plans.features import FITTED_SQL, KEYS, SPECTRA_SQL, spectra
from luxframe.plans.fits import NARROW, SHIFT
from luxframe.plans.groups import GROUPED_SQL, grouped_lines
from luxframe.plans.levels import LINE_ROI_SQL, line_roi, stats
from luxframe.plans.scans import scratch
from luxframe.plans.traces import G2_WINDOW_PS, TRACE_SQL, WINDOWED, WIDTH, _hist_sql, bin_trace, particle_decays
from luxframe.sources import demo, saved, snapshot
from luxframe.sources.demo import LEVELS_SQL, LINES_SQL, PHOTONS_SQL, table


def written(spark, rows, name, headers=None):
    """Rows of a CSV export, read back from its files."""
    return exporting.csv_round_trip(rows, scratch(spark, name), headers)


@query(
    "sink_dataframe",
    f"WITH {LINES_SQL} SELECT {KEYS}, num_photons, dwell_ms FROM ln1",
)
def sink_dataframe(spark, folder):
    """Written in each Spark format in turn, read back from the last."""
    rows = demo.line_levels(spark, folder, ordered=False).select(
        "particle", "line_order", "line_no", "part_key", "num_photons", "dwell_ms"
    )
    for fmt in ("parquet", "orc", "csv"):
        path = scratch(spark, fmt)
        schema = rows.schema
        exporting.write_table(rows, path, fmt)
        rows = spark.read.schema(schema).option("header", True).format(fmt).load(path)
    return rows


@query(
    "sink_levels_df",
    f"""WITH {LINE_ROI_SQL}, w AS (SELECT particle, max(end_s) - min(start_s) AS whole FROM ln GROUP BY ALL)
SELECT ln.particle, level_ind + 1 AS level, round(start_s, 3) AS start, round(end_s, 3) AS "end", round(dwell_s, 3) AS dwell,
  round(dwell_s / whole, 8) AS dwell_frac, round(int_p_s, 4) AS int, num_photons, round(av_tau, 6) AS av_tau,
  round(irf_shift, 6) AS irf_shift, round(chisq, 6) AS chisq, round(dw, 6) AS dw,
  level_ind BETWEEN first_level AND last_level AS is_in_roi, false AS is_grouped
FROM ln JOIN w ON w.particle = ln.particle JOIN lb ON lb.particle = ln.particle""",
)
def sink_levels_df(spark, folder):
    lines = demo.line_levels(spark, folder)
    exported = exporting.levels_table(lines, roi.level_bounds(lines, line_roi(lines)))
    digits = {"start": 3, "end": 3, "dwell": 3, "dwell_frac": 8, "int": 4, "av_tau": 6, "irf_shift": 6, "chisq": 6, "dw": 6}
    return exported.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(
    "sink_groups_df",
    f"""WITH {GROUPED_SQL} SELECT particle, group_ind + 1 AS "group", round(dwell_ms / 1000e0, 3) AS total_dwell_time,
  round(int_p_s, 4) AS int, num_levels, num_photons, 1 AS num_steps, true AS is_best_step, true AS is_primary_particle,
  '1' AS tcspc_card FROM gs""",
)
def sink_groups_df(spark, folder):
    groups = grouping.group_stats(grouped_lines(spark, folder, ordered=False))
    exported = exporting.groups_table(groups, F.lit(1), F.lit(True))
    return exported.withColumns({"total_dwell_time": F.round("total_dwell_time", 3), "int": F.round("int", 4)})


@query("sink_trace_csv", f"WITH {TRACE_SQL} SELECT particle, bin + 1 AS bin_number, t_ms / 1000 AS t_s, counts FROM tr")
def sink_trace_csv(spark, folder):
    path = scratch(spark, "trace")
    exporting.write_per_particle(exporting.trace_table(bin_trace(spark, folder)), path, exporting.TRACE_HEADERS)
    schema = "`Bin #` bigint, `Bin Time (s)` double, `Bin Int (counts)` bigint, particle string"
    back = spark.read.schema(schema).option("header", True).csv(path)
    return back.toDF("bin_number", "t_s", "counts", "particle")


@query(
    "sink_trace_roi_csv",
    f"""WITH {TRACE_SQL}, r AS (SELECT particle, max(t_ms) / 1000 * 0.25e0 AS s, max(t_ms) / 1000 * 0.75e0 AS e FROM tr GROUP BY ALL)
SELECT tr.particle, bin + 1 AS bin_number, t_ms / 1000 AS t_s, counts FROM tr JOIN r ON r.particle = tr.particle
WHERE t_ms / 1000 BETWEEN s AND e""",
)
def sink_trace_roi_csv(spark, folder):
    trace = bin_trace(spark, folder)
    last = F.max("t_ms") / 1000
    region = trace.groupBy("particle").agg((last * 0.25).alias("roi_start_s"), (last * 0.75).alias("roi_end_s"))
    return exporting.trace_table(trace, region, whole=False)


@query(
    "sink_levels_csv",
    f"""WITH {LINES_SQL} SELECT particle, level_ind + 1 AS level, round(start_s, 3) AS start, round(end_s, 3) AS "end",
  dwell_s AS dwell, round(int_p_s, 4) AS int, num_photons FROM ln""",
)
def sink_levels_csv(spark, folder):
    rows = exporting.level_rows(demo.line_levels(spark, folder))
    rounded = rows.withColumns({"start": F.round("start", 3), "end": F.round("end", 3), "int": F.round("int", 4)})
    return written(spark, rounded, "levels", exporting.LEVEL_HEADERS)


@query(
    "sink_level_plot_csv",
    f"""WITH {LINES_SQL} SELECT particle, level_ind, 0 AS vertex, round(start_s, 3) AS t, round(int_p_s, 4) AS y FROM ln
UNION ALL SELECT particle, level_ind, 1, round(end_s, 3), round(int_p_s, 4) FROM ln""",
)
def sink_level_plot_csv(spark, folder):
    curve = level_ops.step_vertices(demo.line_levels(spark, folder), "int_p_s", "start_s", "end_s")
    return written(spark, curve.withColumns({"t": F.round("t", 3), "y": F.round("y", 4)}), "level-plot")


MERGED_SQL = f"""{GROUPED_SQL}, mg AS (SELECT *, level_ind - row_number() OVER (PARTITION BY particle, group_ind ORDER BY level_ind)
  AS isle FROM gl),
rn AS (SELECT particle, group_ind, isle, min(level_ind) AS first_ind, min(end_ms - dwell_ms) AS b, max(end_ms) AS e
  FROM mg GROUP BY ALL)"""


@query(
    "sink_grouped_levels_csv",
    f"""WITH {MERGED_SQL} SELECT rn.particle, row_number() OVER (PARTITION BY rn.particle ORDER BY first_ind) AS level,
  round(b / 1000e0, 3) AS start, round(e / 1000e0, 3) AS "end", round(gs.int_p_s, 4) AS int, rn.group_ind + 1 AS group_index
FROM rn JOIN gs ON gs.particle = rn.particle AND gs.group_ind = rn.group_ind""",
)
def sink_grouped_levels_csv(spark, folder):
    lines = grouped_lines(spark, folder)
    merged = grouping.merge_group_levels(lines, grouping.group_stats(lines))
    rows = merged.select(
        "particle",
        (F.col("gl_ind") + 1).alias("level"),
        F.round(F.col("begin_ns") / 1e9, 3).alias("start"),
        F.round(F.col("stop_ns") / 1e9, 3).alias("end"),
        F.round("int_p_s", 4).alias("int"),
        (F.col("group_ind") + 1).alias("group_index"),
    )
    return written(spark, rows, "grouped-levels")


@query("sink_grouping_results_csv")
def sink_grouping_results_csv(spark, folder):
    return written(spark, exporting.grouping_results(grouping.group_levels(stats(spark, folder))[0]), "grouping-results")


@query(
    "sink_group_info_csv",
    f"""WITH {GROUPED_SQL} SELECT particle, group_ind + 1 AS "group", round(int_p_s, 4) AS int_p_s,
  round(dwell_ms / 1000e0, 3) AS dwell_s, num_levels, num_photons FROM gs""",
)
def sink_group_info_csv(spark, folder):
    info = exporting.group_info(grouping.group_stats(grouped_lines(spark, folder, ordered=False)))
    return written(spark, info.withColumns({"int_p_s": F.round("int_p_s", 4), "dwell_s": F.round("dwell_s", 3)}), "group-info")


@query(
    "sink_lifetimes_csv",
    """SELECT 'meas' || l_suppkey AS particle, l_orderkey AS scope_ind, l_linenumber AS line_no, l_partkey AS part_key,
  round(0.5e0 + l_tax * 10, 6) AS tau_1, round(2e0 + l_quantity / 10, 6) AS tau_2, CAST(NULL AS DOUBLE) AS tau_3,
  round(0.3e0 + l_discount, 6) AS amp_1, round(0.7e0 - l_discount, 6) AS amp_2, CAST(NULL AS DOUBLE) AS amp_3 FROM lineitem""",
)
def sink_lifetimes_csv(spark, folder):
    """Two-exponential fits padded to three exponentials."""
    suppliers = table(spark, folder, "lineitem").select(
        F.concat(F.lit("meas"), "l_suppkey").alias("particle"),
        F.col("l_orderkey").alias("scope_ind"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_key"),
        F.array(F.lit(0.5) + F.col("l_tax") * 10, F.lit(2.0) + F.col("l_quantity") / 10).alias("tau"),
        F.array(F.lit(0.3) + F.col("l_discount"), F.lit(0.7) - F.col("l_discount")).alias("amp"),
    )
    columns = [*exporting.padded("tau", 3, "tau_"), *exporting.padded("amp", 3, "amp_")]
    wide = suppliers.select("particle", "scope_ind", "line_no", "part_key", *columns)
    rounded = wide.withColumns({f"{p}_{k}": F.round(f"{p}_{k}", 6) for p in ("tau", "amp") for k in (1, 2, 3)})
    return written(spark, rounded, "lifetimes")


@query("sink_hists_csv")
def sink_hists_csv(spark, folder):
    """Decay, fitted curve and weighted residual of every particle, inside and outside the fit range."""
    decays = particle_decays(spark, folder)
    packed = binning.decay_arrays(decays, ["particle"])
    fits = decay_fit.fit_lifetimes(packed, ["particle"], WIDTH, FitModel(1, fwhm=NARROW, shift=SHIFT))
    return written(spark, exporting.hist_table(decays, fits), "histograms")


@query("sink_corr_csv", f"WITH {_hist_sql(60, WINDOWED)} SELECT particle, bin + 1 AS bin_number, left_ns, counts / 1e3 AS counts FROM gg")
def sink_corr_csv(spark, folder):
    hist = correlation.g2_fixed(demo.photons(spark, folder), G2_WINDOW_PS, 60).withColumn("left_ns", F.round("left_ns", 1))
    return written(spark, exporting.correlation_rows(hist, per_thousand=True), "correlation")


@query(
    "sink_raster_2d",
    "SELECT p_size AS y, "
    + ", ".join(f"round(sum(p_retailprice) FILTER (p_brand = 'Brand#{k}'), 2) AS \"Brand#{k}\"" for k in range(1, 26))
    + " FROM part GROUP BY ALL",
)
def sink_raster_2d(spark, folder):
    """A grid of part sizes by brand as rows and columns of an image."""
    wide = imaging.matrix(table(spark, folder, "part").withColumnRenamed("p_size", "y"), "y", "p_brand", "p_retailprice")
    return written(spark, wide.select("y", *[F.round(F.col(f"`{b}`"), 2).alias(b) for b in wide.columns if b != "y"]), "raster")


@query(
    "sink_spectra_2d",
    f"WITH {SPECTRA_SQL} SELECT t_ind, "
    + ", ".join(f"round(sum(counts) FILTER (wl_ind = {k}), 6) AS wl_{k}" for k in range(64))
    + " FROM sp GROUP BY ALL",
)
def sink_spectra_2d(spark, folder):
    wide = imaging.matrix(spectra(spark, folder), "t_ind", "wl_ind", "counts", list(range(64)))
    return written(spark, wide.select("t_ind", *[F.round(F.col(f"`{k}`"), 6).alias(f"wl_{k}") for k in range(64)]), "spectra")


@query(
    "sink_particles_h5",
    """SELECT s_name AS name, s_suppkey AS particle_number FROM supplier
UNION ALL SELECT c_name, (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY c_name) FROM customer WHERE c_acctbal > 0""",
)
def sink_particles_h5(spark, folder):
    """Selected particles appended to an existing measurement and numbered on."""
    existing = table(spark, folder, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("particle_number"))
    added = table(spark, folder, "customer").where("c_acctbal > 0").select(
        F.col("c_name").alias("name"), F.col("c_custkey").alias("particle_number")
    )
    return exporting.renumber(existing, added)


@query(
    "sink_convert",
    f"""WITH {PHOTONS_SQL} SELECT 'Particle ' || particle AS particle, photon_ind, abs_ns AS "Absolute Times (ns)",
  micro_ns AS "Micro Times (s)" FROM ph""",
)
def sink_convert(spark, folder):
    """Photons under the column names of a version 1.0 measurement."""
    photons = demo.indexed_photons(spark, folder).select(
        F.concat(F.lit("Particle "), "particle").alias("particle"),
        "photon_ind",
        F.col("abs_ns").alias("Absolute Times (ns)"),
        F.col("micro_ns").alias("Micro Times (s)"),
    )
    path = scratch(spark, "converted")
    exporting.write_table(photons, path)
    return spark.read.parquet(path)


@query(
    "sink_analysis",
    f"""WITH {PHOTONS_SQL}, {GROUPED_SQL} SELECT 'photons' AS saved, particle, count(*) AS n FROM raw GROUP BY ALL
UNION ALL SELECT 'levels', particle, count(*) FROM ln1 GROUP BY ALL
UNION ALL SELECT 'groups', particle, count(*) FROM gs GROUP BY ALL""",
)
def sink_analysis(spark, folder):
    """Every result table saved, loaded again and counted."""
    lines = grouped_lines(spark, folder, ordered=False)
    path = scratch(spark, "analysis")
    tables = {
        "photons": demo.photons(spark, folder),
        "levels": lines,
        "groups": grouping.group_stats(lines),
    }
    saved.save_analysis(tables, path)
    loaded = saved.load_analysis(spark, path, list(tables))
    parts = [
        loaded[name].groupBy("particle").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("saved"), "particle", "n")
        for name in tables
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Tables of a whole analysis, by the query that gives them.
RESULTS = {
    "particles": "particle_stats",
    "levels": "level_stats",
    "grouping_steps": "bic",
    "group_levels": "merge_group_levels",
    "decays": "decay_histogram",
    "fits": "avg_lifetime",
    "g2_hist": "g2_fixed_window",
}


@query(
    "sink_snapshot",
    f"""SELECT 'photons' AS saved, count(*) AS n, true AS verified FROM (WITH {PHOTONS_SQL} SELECT * FROM raw)
UNION ALL SELECT 'cpts', count(*), true FROM (WITH {LEVELS_SQL} SELECT * FROM cp WHERE first_ind > 0)"""
    + "".join(f"\nUNION ALL SELECT '{name}', count(*), true FROM ({ORACLES[source]})" for name, source in RESULTS.items()),
)
def sink_snapshot(spark, folder):
    """A whole analysis saved together, loaded again and compared row by row with what was saved."""
    tables = {
        "photons": demo.photons(spark, folder),
        "cpts": demo.true_change_points(demo.stored_photons(spark, folder)),
        **{name: QUERIES[source](spark, folder) for name, source in RESULTS.items()},
    }
    path = scratch(spark, "snapshot")
    snapshot.save_snapshot(tables, path)
    return snapshot.verified(spark, path)


@query(
    "export_modes",
    f"""WITH {FITTED_SQL}, c AS (SELECT min(particle) AS one FROM ln1),
s AS (SELECT DISTINCT 'meas' || s_suppkey AS particle FROM supplier WHERE s_acctbal > 0)
SELECT 'current' AS mode, count(*) AS n FROM ln1 WHERE particle = (SELECT one FROM c)
UNION ALL SELECT 'selected', count(*) FROM ln1 WHERE particle IN (SELECT particle FROM s)
UNION ALL SELECT 'all', count(*) FROM ln1""",
)
def export_modes(spark, folder):
    """Rows exported for the current, the selected and all particles."""
    lines = demo.line_levels(spark, folder, ordered=False)
    current = lines.agg(F.min("particle").alias("particle"))
    chosen = table(spark, folder, "supplier").where("s_acctbal > 0").select(
        F.concat(F.lit("meas"), "s_suppkey").alias("particle")
    )
    modes = {"current": current, "selected": chosen, "all": None}
    parts = [
        selection.scoped(lines, rows).agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("n")) for mode, rows in modes.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
