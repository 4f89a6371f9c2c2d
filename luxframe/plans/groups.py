"""Groups of levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from luxframe.operators import grouping, levels as level_ops
from luxframe.plans.catalog import query
from luxframe.plans.levels import stats
from luxframe.session import settle
from luxframe.sources import demo
from luxframe.sources.demo import LEVELS_SQL, LINES_SQL, table

SPLIT = (4_000.0, 15_000.0)
GROUPED_SQL = f"""{LINES_SQL},
gl AS (SELECT *, CASE WHEN int_p_s < {SPLIT[0]}e0 THEN 0 WHEN int_p_s < {SPLIT[1]}e0 THEN 1 ELSE 2 END AS group_ind FROM ln),
gs AS (SELECT particle, group_ind, CAST(sum(num_photons) AS BIGINT) AS num_photons, CAST(sum(dwell_ms) AS BIGINT) AS dwell_ms,
  sum(num_photons) / (sum(dwell_ms) / 1000e0) AS int_p_s, count(*) AS num_levels FROM gl GROUP BY ALL)"""


def grouped_lines(spark, folder, ordered=True):
    band = F.when(F.col("int_p_s") < SPLIT[0], 0).when(F.col("int_p_s") < SPLIT[1], 1).otherwise(2)
    lines = demo.line_levels(spark, folder, ordered).withColumn("group_ind", band)
    if not ordered:
        return lines
    ns = {"start_ns": (F.col("end_ms") - F.col("dwell_ms")) * 1_000_000, "end_ns": F.col("end_ms") * 1_000_000}
    return lines.withColumns({**ns, "first_ind": F.col("level_ind"), "last_ind": F.col("level_ind")})


@query(
    "group_stats",
    f"""WITH {GROUPED_SQL} SELECT particle, group_ind, num_photons, round(dwell_ms / 1000e0, 3) AS dwell_s,
  round(int_p_s, 4) AS int_p_s, num_levels FROM gs""",
)
def group_stats(spark, folder):
    groups = grouping.group_stats(grouped_lines(spark, folder, ordered=False))
    return groups.withColumns({"dwell_s": F.round("dwell_s", 3), "int_p_s": F.round("int_p_s", 4)})


@query(
    "merge_group_levels",
    f"""WITH {GROUPED_SQL}, mg AS (SELECT *, level_ind - row_number() OVER (PARTITION BY particle, group_ind ORDER BY level_ind)
  AS isle FROM gl),
rn AS (SELECT particle, group_ind, isle, min(level_ind) AS first_ind, max(level_ind) AS last_ind,
  round(sum(dwell_ms) / 1000e0, 3) AS dwell_s FROM mg GROUP BY ALL)
SELECT rn.particle, row_number() OVER (PARTITION BY rn.particle ORDER BY first_ind) - 1 AS gl_ind, first_ind, last_ind,
  rn.dwell_s, round(gs.int_p_s, 4) AS int_p_s, rn.group_ind FROM rn
  JOIN gs ON gs.particle = rn.particle AND gs.group_ind = rn.group_ind""",
)
def merge_group_levels(spark, folder):
    lines = grouped_lines(spark, folder)
    merged = grouping.merge_group_levels(lines, grouping.group_stats(lines))
    return merged.select(
        "particle", "gl_ind", "first_ind", "last_ind", F.round("dwell_s", 3).alias("dwell_s"),
        F.round("int_p_s", 4).alias("int_p_s"), "group_ind",
    )


@query(
    "join_group_levels",
    f"""WITH {GROUPED_SQL} SELECT particle, group_ind, level_ind, num_photons FROM gl""",
)
def join_group_levels(spark, folder):
    """Groups with their member levels, from the membership rows of the groups."""
    lines = grouped_lines(spark, folder)
    members = lines.select("particle", "group_ind", "level_ind")
    return members.join(lines.select("particle", "level_ind", "num_photons"), ["particle", "level_ind"]).select(
        "particle", "group_ind", "level_ind", "num_photons"
    )


BOUNDS_SQL = f"""{GROUPED_SQL},
gb AS (SELECT particle, group_ind, row_number() OVER (PARTITION BY particle ORDER BY int_p_s DESC, group_ind DESC) - 1 AS position,
  coalesce((int_p_s + lag(int_p_s) OVER w) / 2, 0e0) AS low,
  coalesce((int_p_s + lead(int_p_s) OVER w) / 2, CAST('inf' AS DOUBLE)) AS high FROM gs
  WINDOW w AS (PARTITION BY particle ORDER BY int_p_s, group_ind))"""


@query(
    "group_bounds",
    f"""WITH {BOUNDS_SQL} SELECT particle, group_ind, position, round(low, 4) AS low,
  CASE WHEN isinf(high) THEN -1e0 ELSE round(high, 4) END AS high FROM gb""",
)
def group_bounds(spark, folder):
    bounds = grouping.group_bounds(grouping.group_stats(grouped_lines(spark, folder, ordered=False)))
    finite = F.when(F.col("high") == float("inf"), F.lit(-1.0)).otherwise(F.round("high", 4))
    return bounds.withColumns({"low": F.round("low", 4), "high": finite})


@query(
    "group_at_intensity",
    f"""WITH {BOUNDS_SQL}, pr AS (SELECT particle, line_order, line_no, part_key, num_photons * 10e0 AS value FROM ln)
SELECT pr.particle, value, group_ind, count(*) AS probes FROM pr JOIN gb ON gb.particle = pr.particle
  AND value >= low AND value < high GROUP BY ALL""",
)
def group_at_intensity(spark, folder):
    lines = grouped_lines(spark, folder, ordered=False)
    bounds = grouping.group_bounds(grouping.group_stats(lines))
    probes = lines.select("particle", (F.col("num_photons") * 10.0).alias("value"))
    found = grouping.group_at_intensity(bounds, probes)
    return found.groupBy("particle", "value", "group_ind").agg(F.count(F.lit(1)).alias("probes"))


@query(
    "ahc_merge",
    f"""WITH {LEVELS_SQL}, pr AS (SELECT a.particle, a.level_ind AS first_level, b.level_ind AS second_level,
  (a.num_photons + b.num_photons) * ln((a.num_photons + b.num_photons) / (a.dwell_s + b.dwell_s))
  - a.num_photons * ln(a.num_photons / a.dwell_s) - b.num_photons * ln(b.num_photons / b.dwell_s) AS merit
  FROM lv a JOIN lv b ON a.particle = b.particle AND a.level_ind < b.level_ind)
SELECT particle, arg_max(first_level, merit) AS first_level, arg_max(second_level, merit) AS second_level,
  round(max(merit), 5) AS merit FROM pr GROUP BY ALL""",
)
def ahc_merge(spark, folder):
    """First agglomeration step; the SQL compares all pairs, the query only neighbours in intensity."""
    found = settle(stats(spark, folder))
    return grouping.best_merge(found).withColumn("merit", F.round("merit", 5))


@query("run_grouping")
def run_grouping(spark, folder):
    return grouping.group_levels(stats(spark, folder))[0]


@query("em_refine")
def em_refine(spark, folder):
    """Group of each level in the best solution."""
    return grouping.group_levels(stats(spark, folder))[1]


@query("run_grouping_lines")
def run_grouping_lines(spark, folder):
    """Best number of groups for every supplier's lines."""
    steps, _ = grouping.group_levels(demo.line_levels(spark, folder).select("particle", "level_ind", "num_photons", "dwell_s"))
    return steps.where("is_best").select("particle", "step", "num_groups", F.round("bic", 4).alias("bic"))


@query(
    "bic",
    f"""WITH {GROUPED_SQL}, t AS (SELECT particle, count(*) AS groups, sum(num_levels) AS levels, sum(num_photons) AS photons,
  sum(num_photons * ln(int_p_s / 1000)) AS log_l FROM gs GROUP BY ALL)
SELECT particle, round(2 * log_l - (2 * groups - 1) * ln(levels - 1) - (levels - 1) * ln(photons), 3) AS bic FROM t""",
)
def bic(spark, folder):
    """Information criterion of the three-band grouping with its Poisson likelihood terms."""
    groups = grouping.group_stats(grouped_lines(spark, folder, ordered=False))
    facts = groups.groupBy("particle").agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("num_levels").alias("levels"),
        F.sum("num_photons").alias("photons"),
        F.sum(F.col("num_photons") * F.ln(F.col("int_p_s") / 1000)).alias("log_l"),
    )
    value = grouping.bic(F.col("log_l"), F.col("groups"), F.col("levels") - 1, F.col("photons"))
    return facts.select("particle", F.round(value, 3).alias("bic"))


@query(
    "apply_groups",
    """SELECT p_partkey AS particle_number, p_size <= 25 AS selected,
  CASE WHEN p_size <= 25 AND p_retailprice > 910 THEN
    NOT (SELECT bool_and(p_size > 10) FROM part WHERE p_size <= 25 AND p_retailprice > 910) ELSE p_size > 10 END AS using_groups
FROM part""",
)
def apply_groups(spark, folder):
    particles = table(spark, folder, "part").select(
        F.col("p_partkey").alias("particle_number"),
        (F.col("p_size") <= 25).alias("selected"),
        (F.col("p_retailprice") > 910).alias("has_groups"),
        (F.col("p_size") > 10).alias("using_groups"),
    )
    return grouping.toggle_groups(particles).drop("has_groups")


GLOBAL_SQL = f"""{LINES_SQL},
sn AS (SELECT particle, sum(dwell_ms) AS span, count(*) AS n FROM ln GROUP BY ALL),
of AS (SELECT particle, row_number() OVER (ORDER BY particle) - 1 AS particle_ind,
  sum(span) OVER (ORDER BY particle) - span AS off_ms, sum(n) OVER (ORDER BY particle) - n AS first_level FROM sn)"""


@query(
    "global_particle",
    f"""WITH {GLOBAL_SQL} SELECT ln.particle, particle_ind, level_ind, CAST(first_level + level_ind AS BIGINT) AS global_ind,
  round((off_ms + end_ms - dwell_ms) / 1000e0, 3) AS global_start_s, round((off_ms + end_ms) / 1000e0, 3) AS global_end_s,
  num_photons, dwell_s FROM ln JOIN of ON of.particle = ln.particle""",
)
def global_particle(spark, folder):
    lines = demo.line_levels(spark, folder)
    joined = level_ops.concatenated(lines, F.col("particle"))
    return joined.withColumns({c: F.round(c, 3) for c in ("global_start_s", "global_end_s")})


@query("global_grouping")
def global_grouping(spark, folder):
    """Levels of all emitters clustered together and handed back to their particles."""
    found = settle(stats(spark, folder))
    ended = {"dwell_ms": F.col("dwell_s") * 1000, "end_ms": F.col("end_ns") / 1e6}
    shared = settle(level_ops.concatenated(found.withColumns(ended), F.col("particle")))
    together = shared.select(F.lit("all").alias("particle"), F.col("global_ind").alias("level_ind"), "num_photons", "dwell_s")
    assigned = grouping.group_levels(together)[1].select(F.col("level_ind").alias("global_ind"), "group_ind")
    return shared.join(assigned, "global_ind").select("particle", "level_ind", "num_photons", "group_ind")
