"""Lifetime fits and their statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from luxframe.functions import sql_functions
from luxframe.functions.decay import FitModel, Parameter
from luxframe.operators import binning, decay_fit, decay_range, exporting
from luxframe.plans.catalog import query
from luxframe.plans.levels import level_bounds
from luxframe.plans.traces import DECAY_SQL, WIDTH, particle_decays
from luxframe.operators.levels import photons_in_levels
from luxframe.sources import demo
from luxframe.sources.demo import LINES_SQL, table

NARROW = Parameter(0.1, 0.05, 2.0)


def arrays(spark, folder):
    return binning.decay_arrays(particle_decays(spark, folder), ["particle"])


def _summary(fits):
    return fits.drop("model", "residual", "start_ch")


def _fit(name: str, model: FitModel):
    @query(name)
    def run(spark, folder):
        return _summary(decay_fit.fit_lifetimes(arrays(spark, folder), ["particle"], WIDTH, model))

    return run


SHIFT = Parameter(0.0, -20.0, 20.0)
fit_1exp_ls = _fit("fit_1exp_ls", FitModel(1, "ls", fwhm=NARROW, shift=SHIFT))
fit_2exp_ls = _fit("fit_2exp_ls", FitModel(2, "ls", fwhm=NARROW, shift=SHIFT))
fit_3exp_ls = _fit("fit_3exp_ls", FitModel(3, "ls", fwhm=NARROW, shift=SHIFT))
fit_1exp_ml = _fit("fit_1exp_ml", FitModel(1, "ml", fwhm=NARROW, shift=SHIFT))
fit_2exp_ml = _fit("fit_2exp_ml", FitModel(2, "ml", fwhm=NARROW, shift=SHIFT))
fit_3exp_ml = _fit("fit_3exp_ml", FitModel(3, "ml", fwhm=NARROW, shift=SHIFT))


@query("fit_all_scopes")
def fit_all_scopes(spark, folder):
    """Whole trace and every level, one decay per row."""
    photons, bounds = level_bounds(spark, folder)
    levels = photons_in_levels(photons, bounds).withColumn("scope_ind", F.col("level_ind"))
    whole = photons.withColumn("scope_ind", F.lit(-1).cast("bigint"))
    columns = ["particle", "scope_ind", "micro_ns"]
    micro = binning.micro_counts(whole.select(columns).unionByName(levels.select(columns)), ["particle", "scope_ind"])
    decays = binning.decay_histogram(micro, ["particle", "scope_ind"], 0.5)
    packed = binning.decay_arrays(decays, ["particle", "scope_ind"])
    fits = decay_fit.fit_lifetimes(packed, ["particle", "scope_ind"], 0.5, FitModel(1, fwhm=NARROW, shift=SHIFT))
    return _summary(fits)


@query(
    "fit_preview",
    f"""WITH {DECAY_SQL} SELECT particle, CAST(ch AS INTEGER) AS ch, round(sum(counts) OVER w * exp(-ch * {WIDTH}e0 / 5)
  / sum(exp(-ch * {WIDTH}e0 / 5)) OVER w, 5) AS model FROM dc WINDOW w AS (PARTITION BY particle)""",
)
def fit_preview(spark, folder):
    """Single exponential over each decay, with an instantaneous response."""
    curves = decay_fit.preview(arrays(spark, folder), ["particle"], [5.0], [1.0], [1.0], 0.0)
    return curves.select("particle", F.posexplode("model").alias("ch", "model")).withColumn("model", F.round("model", 5))


def background_sql(series: str, tag: str = "") -> str:
    """Tables up to ``bk{tag}`` (particle, rise, top, bg) of a series (particle, ch, counts)."""
    return f"""sz{tag} AS (SELECT particle, count(*) AS size, max(counts) AS top, arg_max(ch, counts * 1000000 - ch) AS peak
  FROM {series} GROUP BY ALL),
fi{tag} AS (SELECT s.particle, ch, size, lag(ch) OVER w AS before, coalesce(lead(ch) OVER w, size) AS after FROM {series} s
  JOIN sz{tag} z ON z.particle = s.particle WHERE counts > 0 WINDOW w AS (PARTITION BY s.particle ORDER BY ch)),
hd{tag} AS (SELECT particle, ch, (before IS NULL OR ch - before > 1) AND size - ch > 100 AND NOT EXISTS (SELECT 1 FROM fi{tag} b
  WHERE b.particle = a.particle AND b.ch >= a.ch AND b.ch < a.ch + 25 AND b.after - b.ch > 25) AS steady FROM fi{tag} a),
st{tag} AS (SELECT particle, coalesce(min(ch) FILTER (steady), min(ch)) AS start FROM hd{tag} GROUP BY ALL),
ty{tag} AS (SELECT s.particle, start, peak, top, avg(counts) FILTER (ch BETWEEN start AND start + 49) AS typical FROM {series} s
  JOIN sz{tag} z ON z.particle = s.particle JOIN st{tag} t ON t.particle = s.particle GROUP BY ALL),
ri{tag} AS (SELECT s.particle, start, top, coalesce(max(ch) FILTER (ch >= start AND ch < peak AND counts <= typical), min(start) + 50) AS rise
  FROM {series} s JOIN ty{tag} t ON t.particle = s.particle GROUP BY ALL),
bk{tag} AS (SELECT s.particle, rise, top, least(coalesce(avg(counts) FILTER (ch >= start AND ch < rise), 0), 0.05e0 * min(top)) AS bg
  FROM {series} s JOIN ri{tag} r ON r.particle = s.particle GROUP BY ALL)"""


@query(
    "estimate_bg",
    f"""WITH {DECAY_SQL}, {background_sql("dc")}
SELECT particle, CAST(rise AS INTEGER) AS rise_ch, round(bg, 8) AS bg FROM bk""",
)
def estimate_bg(spark, folder):
    found = decay_range.background(particle_decays(spark, folder), ["particle"])
    return found.withColumn("bg", F.round("bg", 8))


@query(
    "calc_irf_bg",
    f"""WITH {DECAY_SQL}, h AS (SELECT particle, CAST(floor(avg(counts) FILTER (ch < 20)) AS BIGINT) AS level,
  arg_max(ch, counts * 1000000 - ch) AS peak FROM dc GROUP BY ALL),
l AS (SELECT dc.particle, max(ch) AS last FROM dc JOIN h ON h.particle = dc.particle
  WHERE ch > 0 AND ch <= peak AND counts = level GROUP BY ALL)
SELECT dc.particle, round(coalesce(avg(counts) FILTER (ch < last), 0), 8) AS irf_bg FROM dc
LEFT JOIN l ON l.particle = dc.particle GROUP BY ALL""",
)
def calc_irf_bg(spark, folder):
    """The decays taken as responses."""
    found = decay_range.response_background(particle_decays(spark, folder), ["particle"])
    return found.withColumn("irf_bg", F.round("irf_bg", 8))


MODES = ("(Close to) max", "Rise middle", "Rise start", "Safe rise start")
SMOOTH_SQL = """sm AS (SELECT particle, ch, sum(counts) OVER (PARTITION BY particle ORDER BY ch
  ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10e0 AS counts FROM dc)"""


@query(
    "fit_boundaries",
    f"""WITH {DECAY_SQL}, {background_sql("dc")}, {SMOOTH_SQL},
{background_sql("sm", "2")},
nr AS (SELECT s.particle, b.top, b.rise, r.bg, min(ch) FILTER (counts > 0.8e0 * b.top) AS near, count(*) AS size FROM sm s
  JOIN bk2 b ON b.particle = s.particle JOIN bk r ON r.particle = s.particle GROUP BY ALL),
bg2 AS (SELECT *, UNNEST(['(Close to) max', 'Rise middle', 'Rise start', 'Safe rise start']) AS start_mode FROM nr),
bn AS (SELECT *, CASE start_mode WHEN '(Close to) max' THEN near WHEN 'Rise middle' THEN (rise + near) // 2 WHEN 'Rise start' THEN rise
  ELSE rise - least(near - rise, 10) END AS start FROM bg2),
en AS (SELECT n.particle, start_mode, near, start, coalesce(max(ch) FILTER (ch >= start AND counts > greatest(20 * bg, 0.01e0 * top)
  AND ch < size - 1), min(start) + 5) + 5 AS stop FROM bn n JOIN sm s ON s.particle = n.particle GROUP BY ALL)
SELECT particle, start_mode,
  CAST(CASE WHEN {WIDTH}e0 * (stop - start) < 0.5e0 AND start_mode = 'Safe rise start' THEN start - 2 ELSE start END AS INTEGER) AS first_ch,
  CAST(CASE WHEN {WIDTH}e0 * (stop - start) < 0.5e0 THEN near + 5 ELSE stop END AS INTEGER) AS last_ch FROM en""",
)
def fit_boundaries(spark, folder):
    """Fit range of every decay in the four automatic modes."""
    decays = arrays(spark, folder)
    parts = [
        decay_range.fit_ranges(decays, ["particle"], WIDTH, start_mode=mode).select(
            "particle", F.lit(mode).alias("start_mode"), "first_ch", "last_ch"
        )
        for mode in MODES
    ]
    return reduce(DataFrame.unionByName, parts)


CURVE = {"tau": [1.0, 5.0], "amp": [0.4, 0.6], "irf": [0.2, 0.6, 0.0, 0.2], "shift": 1.25}


@query(
    "convolve_model",
    f"""WITH {DECAY_SQL}, n AS (SELECT particle, count(*) AS size FROM dc GROUP BY ALL),
v AS (SELECT * FROM (VALUES (1, 0.15e0), (2, 0.05e0 + 0.45e0), (3, 0.15e0), (4, 0.15e0), (5, 0.05e0)) AS x(k, w)),
p AS (SELECT particle, k % size AS pos, w FROM n, v)
SELECT dc.particle, CAST(ch AS INTEGER) AS ch, round(coalesce(sum(w * (0.4e0 * exp(-(ch - pos) * {WIDTH}e0) + 0.6e0 * exp(-(ch - pos) * {WIDTH}e0 / 5)))
  FILTER (pos <= ch), 0), 8) AS model FROM dc JOIN p ON p.particle = dc.particle GROUP BY ALL""",
)
def convolve_model(spark, folder):
    """Two exponentials convolved with a shifted response of three filled channels."""
    curves = decay_range.convolved_curves(arrays(spark, folder), ["particle"], **CURVE)
    return curves.select("particle", F.posexplode("model").alias("ch", "model")).withColumn("model", F.round("model", 8))


SIGMA = 0.5 / WIDTH / 2.35482


@query(
    "sim_irf",
    f"""WITH {DECAY_SQL}, pk AS (SELECT particle, max(counts) AS top, arg_max(ch, counts * 100000 - ch) AS top_ch FROM dc GROUP BY ALL)
SELECT dc.particle, ch, round(top * exp(-power((ch - top_ch) / {SIGMA!r}e0, 2) / 2), 6) AS irf FROM dc
JOIN pk ON pk.particle = dc.particle""",
)
def sim_irf(spark, folder):
    """Gaussian response on the peak of each decay."""
    decays = particle_decays(spark, folder)
    peak = decays.groupBy("particle").agg(
        F.max("counts").alias("top"), F.max_by("ch", F.struct("counts", -F.col("ch"))).alias("at")
    )
    return decays.join(peak, "particle").select(
        "particle", "ch", F.round(F.col("top") * F.exp(-F.pow((F.col("ch") - F.col("at")) / SIGMA, F.lit(2)) / 2), 6).alias("irf")
    )


@query(
    "colorshift",
    f"""WITH {DECAY_SQL}, n AS (SELECT particle, count(*) AS size FROM dc GROUP BY ALL),
m AS (SELECT dc.particle, (ch + 2) % size AS ch, counts * (1 - 0.25e0) AS part FROM dc JOIN n ON n.particle = dc.particle
  UNION ALL SELECT dc.particle, (ch + 3) % size, counts * 0.25e0 FROM dc JOIN n ON n.particle = dc.particle)
SELECT particle, ch, round(sum(part), 6) AS shifted FROM m GROUP BY ALL""",
)
def colorshift(spark, folder):
    decays = particle_decays(spark, folder)
    sizes = decays.groupBy("particle").agg(F.count(F.lit(1)).alias("size"))
    moved = decay_fit.colour_shift(decays.join(sizes, "particle"), ["particle"], "size", 2.25)
    return moved.withColumn("shifted", F.round("shifted", 6))


STATS_SQL = f"""{DECAY_SQL},
mo AS (SELECT particle, ch, counts, exp(-ch * {WIDTH}e0 / 5) * 100 AS model FROM dc),
re AS (SELECT *, (model - counts) / sqrt(abs(model)) AS r FROM mo),
df AS (SELECT *, r - lag(r) OVER (PARTITION BY particle ORDER BY ch) AS d FROM re)"""


@query(
    "fit_stats",
    f"""WITH {STATS_SQL} SELECT particle, round(sum(r * r) / (count(*) - 3), 5) AS chisq,
  round(sum(d * d) / sum(r * r), 5) AS dw, count(*) AS num_points FROM df GROUP BY ALL""",
)
def fit_stats(spark, folder):
    curves = particle_decays(spark, folder).withColumn("model", F.exp(-F.col("ch") * WIDTH / 5) * 100)
    found = decay_fit.fit_statistics(curves, ["particle"], "ch", 1)
    return found.withColumns({"chisq": F.round("chisq", 5), "dw": F.round("dw", 5)})


def _dw_sql(b: tuple, name: str) -> str:
    return (
        f"round_even(2 + {b[0]}e0 / sqrt(n) + {b[1]}e0 / n + {b[2]}e0 / (sqrt(n) * sqrt(n) * sqrt(n)) + {b[3]}e0 / (n * n), 3)"
        f" AS {name}"
    )


def _normal_sql(k: float, name: str) -> str:
    return f"round_even(2 - {k}e0 * sqrt(4 * n * n * (n - 2) / ((n + 1) * power(n - 1, 3))), 3) AS {name}"


@query(
    "dw_bounds",
    f"""WITH p AS (SELECT o_orderkey, CAST(50 + o_orderkey % 2000 AS DOUBLE) AS n FROM orders)
SELECT o_orderkey AS decay, {", ".join(_dw_sql(decay_fit.DW_TERMS[level][k - 1], f"dw_{level}_{k}exp") for level in (5, 1) for k in (1, 2, 3))},
 {_normal_sql(3.0, "dw_03")}, {_normal_sql(3.28, "dw_01")} FROM p""",
)
def dw_bounds(spark, folder):
    """The bounds through the functions that SQL text sees."""
    sql_functions.register(spark)
    points = (50 + F.pmod("o_orderkey", F.lit(2000))).cast("double")
    decays = table(spark, folder, "orders").select(F.col("o_orderkey").alias("decay"), points.alias("n"))
    return decays.select(
        "decay",
        *[F.expr(f"dw_bound(n, {k}, {level})").alias(f"dw_{level}_{k}exp") for level in (5, 1) for k in (1, 2, 3)],
        F.expr("dw_normal_bound(n, 3.0D)").alias("dw_03"),
        F.expr("dw_normal_bound(n, 3.28D)").alias("dw_01"),
    )


def line_fits(spark, folder):
    """Two-exponential results made of line columns."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.array(F.lit(0.5) + F.col("l_tax") * 10, F.lit(2.0) + F.col("l_quantity") / 10).alias("tau"),
        F.array(F.lit(0.3) + F.col("l_discount"), F.lit(0.7) - F.col("l_discount")).alias("amp"),
        F.array(F.lit(0.05), F.lit(0.1)).alias("tau_std"),
        F.array(F.lit(0.02), F.lit(0.03)).alias("amp_std"),
    )


LINE_FIT_SQL = """lf AS (SELECT l_orderkey, l_linenumber, l_partkey, 0.5e0 + l_tax * 10 AS t1, 2e0 + l_quantity / 10 AS t2,
  0.3e0 + l_discount AS a1, 0.7e0 - l_discount AS a2 FROM lineitem)"""


@query(
    "avg_lifetime",
    f"""WITH {LINE_FIT_SQL} SELECT l_orderkey, l_linenumber, l_partkey, round((t1 * a1 + t2 * a2) / (a1 + a2), 5) AS avtau FROM lf""",
)
def avg_lifetime(spark, folder):
    value = F.round(decay_fit.average_lifetime("tau", "amp"), 5)
    return line_fits(spark, folder).select("l_orderkey", "l_linenumber", "l_partkey", value.alias("avtau"))


@query(
    "avg_lifetime_std",
    f"""WITH {LINE_FIT_SQL} SELECT l_orderkey, l_linenumber, l_partkey,
  round(sqrt(power(t1 * a1, 2) * (power(0.05e0 / t1, 2) + power(0.02e0 / a1, 2))
           + power(t2 * a2, 2) * (power(0.1e0 / t2, 2) + power(0.03e0 / a2, 2))), 6) AS avtau_std FROM lf""",
)
def avg_lifetime_std(spark, folder):
    value = F.round(decay_fit.average_lifetime_std("tau", "amp", "tau_std", "amp_std"), 6)
    return line_fits(spark, folder).select("l_orderkey", "l_linenumber", "l_partkey", value.alias("avtau_std"))


@query(
    "max_exp_num",
    f"WITH {LINES_SQL} SELECT coalesce(max(CASE WHEN av_tau IS NOT NULL THEN 1 + line_no % 3 END), 0) AS max_exp_num FROM ln1",
)
def max_exp_num(spark, folder):
    numexp = F.when(F.col("av_tau").isNotNull(), 1 + F.pmod("line_no", F.lit(3)))
    return exporting.max_exponents(demo.line_levels(spark, folder, ordered=False).withColumn("numexp", numexp))
