"""Groups of levels: clustering, group statistics, grouped levels and bounds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from luxframe.functions.clustering import cluster
from luxframe.operators.ordered import neighbours, running_total
from luxframe.schema import GROUPING_STEPS
from luxframe.session import settle, shuffle_width


def run_grouping(levels: DataFrame, totals: DataFrame | None = None, every_step: bool = True) -> DataFrame:
    """All clustering steps of each particle, the best one marked.

    ``levels(particle, level_ind, num_photons, dwell_s)`` of whole traces or of regions;
    ``totals(particle, total_s, total_photons)`` default to the time from the start of the first to
    the end of the last level where ``start_ns`` and ``end_ns`` are known, else to the sum of the
    dwell times.  The steps of a particle follow from one another, so a task takes the level summary
    of one particle, never its photons; the algorithm is the same for any number of levels.  With
    ``every_step=False`` only the best step carries its assignment, which keeps the result linear
    in the number of levels.
    """
    if totals is None:
        total = F.sum("dwell_s")
        if {"start_ns", "end_ns"} <= set(levels.columns):
            total = (F.max("end_ns") - F.min("start_ns")) / 1e9
        totals = levels.groupBy("particle").agg(total.alias("total_s"), F.sum("num_photons").alias("total_photons"))
    # Clustering is heavy for its few bytes, so the partitions are fixed here and not merged by size.
    width = shuffle_width(levels.sparkSession)
    source = levels.select("particle", "level_ind", "num_photons", "dwell_s").join(totals, "particle")
    source = source.repartition(width, "particle")

    def steps(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("level_ind")
        rows = []
        best = None
        for number, (groups, likelihood, criterion, member) in enumerate(
            cluster(frame["num_photons"], frame["dwell_s"], frame["total_s"].iloc[0], frame["total_photons"].iloc[0])
        ):
            if best is None or (criterion is not None and criterion > best[1]):
                best = (number, criterion, member)
            kept = member if every_step else None
            rows.append([frame["particle"].iloc[0], number, groups, likelihood, criterion, False, kept])
        rows[best[0]][5:] = [True, best[2]]
        levels_in_order = frame["level_ind"].tolist()
        for row in rows:
            if row[6] is not None:
                row[6] = [{"level_ind": i, "group_ind": int(g)} for i, g in zip(levels_in_order, row[6])]
        columns = ["particle", "step", "num_groups", "log_l", "bic", "is_best", "level_groups"]
        return pd.DataFrame(rows, columns=columns)

    return source.groupBy("particle").applyInPandas(steps, GROUPING_STEPS)


def group_levels(levels: DataFrame, totals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Steps ``(particle, step, num_groups, log_l, bic, is_best)`` and the best assignment as rows."""
    solved = settle(run_grouping(levels, totals, every_step=False))
    return solved.drop("level_groups"), step_assignment(solved)


def step_assignment(steps: DataFrame, chosen: Column | None = None) -> DataFrame:
    """``(particle, level_ind, group_ind)`` of the best (or another chosen) step."""
    return (
        steps.where(F.col("is_best") if chosen is None else chosen)
        .select("particle", F.explode("level_groups").alias("_g"))
        .select("particle", "_g.level_ind", "_g.group_ind")
    )


def bic(log_l: Column, groups: Column, changes: Column, photons: Column) -> Column:
    return 2 * log_l - (2 * groups - 1) * F.ln(changes) - changes * F.ln(photons)


def merge_merit(n1: Column, t1: Column, n2: Column, t2: Column) -> Column:
    """Log-likelihood change when two groups become one."""
    joined = (n1 + n2) * F.ln((n1 + n2) / (t1 + t2))
    return joined - n1 * F.ln(n1 / t1) - n2 * F.ln(n2 / t2)


def best_merge(levels: DataFrame) -> DataFrame:
    """The first agglomeration step: the pair of levels whose merging costs least.

    The best pair is always adjacent in intensity, so sorting replaces the comparison of all pairs.
    """
    from luxframe.operators.ordered import index_rows

    sorted_levels = index_rows(levels, ["particle"], ["int_p_s", "level_ind"], "_rank")
    paired = neighbours(
        sorted_levels,
        ["particle"],
        "_rank",
        after={"_ind2": "level_ind", "_n2": "num_photons", "_t2": "dwell_s"},
    ).where("_ind2 IS NOT NULL")
    merit = merge_merit(F.col("num_photons"), F.col("dwell_s"), F.col("_n2"), F.col("_t2"))
    pairs = paired.select(
        "particle",
        F.least("level_ind", "_ind2").alias("first_level"),
        F.greatest("level_ind", "_ind2").alias("second_level"),
        merit.alias("merit"),
    )
    return pairs.groupBy("particle").agg(
        F.max_by(F.struct("first_level", "second_level", "merit"), F.struct("merit", -F.col("first_level"))).alias("_b")
    ).select("particle", "_b.*")


def group_stats(levels: DataFrame) -> DataFrame:
    """Photons, dwell time, intensity and number of levels per group."""
    return levels.groupBy("particle", "group_ind").agg(
        F.sum("num_photons").alias("num_photons"),
        F.sum("dwell_s").alias("dwell_s"),
        F.try_divide(F.sum("num_photons"), F.sum("dwell_s")).alias("int_p_s"),
        F.count(F.lit(1)).alias("num_levels"),
    )


def merge_group_levels(levels: DataFrame, groups: DataFrame) -> DataFrame:
    """Adjacent levels of one group become one level with the intensity of the group.

    ``begin_ns`` and ``stop_ns`` are the start of its first and the end of its last level.
    """
    needed = ("particle", "level_ind", "group_ind", "first_ind", "last_ind", "start_ns", "end_ns")
    around = neighbours(levels.select(*needed), ["particle"], "level_ind", before={"_group": "group_ind"})
    starts = F.when(F.col("_group").eqNullSafe(F.col("group_ind")), 0).otherwise(1)
    runs = running_total(around, ["particle"], "level_ind", starts, "_run")
    merged = runs.groupBy("particle", (F.col("_run") - 1).alias("gl_ind")).agg(
        F.min("first_ind").alias("first_ind"),
        F.max("last_ind").alias("last_ind"),
        F.min("start_ns").alias("start_ns"),
        F.max("end_ns").alias("end_ns"),
        F.first("group_ind").alias("group_ind"),
        F.min_by("start_ns", "first_ind").alias("begin_ns"),
        F.max_by("end_ns", "last_ind").alias("stop_ns"),
    )
    ints = settle(groups.select("particle", "group_ind", "int_p_s"))  # written, so that the planner knows it is small
    return merged.join(ints, ["particle", "group_ind"]).select(
        "particle",
        "gl_ind",
        "first_ind",
        "last_ind",
        (F.col("last_ind") - F.col("first_ind") + 1).alias("num_photons"),
        ((F.col("end_ns") - F.col("start_ns")) / 1e9).alias("dwell_s"),
        "int_p_s",
        "group_ind",
        "begin_ns",
        "stop_ns",
    )


def group_bounds(groups: DataFrame, descending: bool = True) -> DataFrame:
    """Intensity range of each group: midpoints to its neighbours, 0 and infinity at the ends."""
    order = W.partitionBy("particle").orderBy("int_p_s", "group_ind")  # groups, not levels
    below = (F.col("int_p_s") + F.lag("int_p_s").over(order)) / 2
    above = (F.col("int_p_s") + F.lead("int_p_s").over(order)) / 2
    rank = W.partitionBy("particle").orderBy(
        *([F.desc("int_p_s"), F.desc("group_ind")] if descending else ["int_p_s", "group_ind"])
    )
    return groups.select(
        "particle",
        "group_ind",
        (F.row_number().over(rank) - 1).alias("position"),
        F.coalesce(below, F.lit(0.0)).alias("low"),
        F.coalesce(above, F.lit(float("inf"))).alias("high"),
    )


def group_at_intensity(bounds: DataFrame, probes: DataFrame) -> DataFrame:
    """Group whose range holds each probe(particle, value); a bound belongs to the upper group."""
    return (
        probes.join(bounds, "particle")
        .where((F.col("value") >= F.col("low")) & (F.col("value") < F.col("high")))
        .select("particle", "value", "group_ind")
    )


def toggle_groups(particles: DataFrame) -> DataFrame:
    """Switch grouped levels on for the selected particles, or off if all of them are on."""
    facts = particles.where("selected AND has_groups").agg(
        F.coalesce(F.min("using_groups"), F.lit(False)).alias("all_on")
    )
    all_on = facts.first()[0]
    switched = F.col("selected") & F.col("has_groups")
    return particles.withColumn(
        "using_groups", F.when(switched, F.lit(not all_on)).otherwise(F.col("using_groups"))
    )
