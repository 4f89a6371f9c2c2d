"""Photon bursts: short bright levels, and their removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from luxframe.config import BurstSettings
from luxframe.operators.levels import weighted_mean_std
from luxframe.operators.ordered import BLOCK, neighbours, ordinal, running_total
from luxframe.session import settle


def detect_bursts(levels: DataFrame, settings: BurstSettings = BurstSettings()) -> DataFrame:
    """Add ``is_burst``: brighter than the threshold and shorter than the minimum dwell time."""
    if settings.use_sigma:
        limits = weighted_mean_std(levels).select(
            "particle", (F.col("mean_int") + F.col("std_int") * settings.sigma).alias("_limit")
        )
        judged = levels.join(settle(limits), "particle")  # written, so that the planner knows it is small
    else:
        judged = levels.withColumn("_limit", F.lit(settings.absolute_int))
    bright = (F.col("int_p_s") > F.col("_limit")) & (F.col("dwell_s") < settings.min_dwell_s)
    return judged.withColumn("is_burst", F.coalesce(bright, F.lit(False))).drop("_limit")


def burst_directions(levels: DataFrame) -> DataFrame:
    """The bursts with ``goes_left``.

    A burst joins its brighter neighbour, the right one only if strictly brighter.  The first level
    can only go right.  A burst with nothing but bursts after it has no right neighbour left when
    its turn comes, because removal runs from the last level to the first, and goes left.
    """
    slim = levels.select("particle", "level_ind", "int_p_s", "is_burst")
    around = neighbours(slim, ["particle"], "level_ind", before={"_left": "int_p_s"}, after={"_right": "int_p_s"})
    last_steady = slim.groupBy("particle").agg(
        F.coalesce(F.max(F.when(~F.col("is_burst"), F.col("level_ind"))), F.lit(-1)).alias("_steady")
    )
    left = (
        F.when(F.col("level_ind") == 0, False)
        .when(F.col("level_ind") > F.col("_steady"), True)
        .otherwise(~(F.col("_right") > F.col("_left")))
    )
    return around.where("is_burst").join(last_steady, "particle").select("particle", "level_ind", left.alias("goes_left"))


def dropped_borders(directed: DataFrame) -> DataFrame:
    """Levels that no longer begin at a border: ``(particle, level_ind)``.

    A burst going left drops the border before it.  One going right drops the nearest border after
    it that is still there: the border behind the run of left-going bursts that follows it, if any.
    """
    lefts = directed.where("goes_left").select("particle", "level_ind")
    rights = directed.where(~F.col("goes_left")).select("particle", (F.col("level_ind") + 1).alias("first"))
    ranked = ordinal(lefts, ["particle"], "level_ind", "_rank")
    runs = ranked.groupBy("particle", (F.col("level_ind") - F.col("_rank")).alias("_run")).agg(
        F.min("level_ind").alias("first"), F.max("level_ind").alias("_last")
    )
    behind = rights.join(runs.drop("_run"), ["particle", "first"], "left").select(
        "particle", F.coalesce(F.col("_last") + 1, F.col("first")).alias("level_ind")
    )
    return lefts.unionByName(behind).distinct()


def merged_levels(merged: DataFrame) -> DataFrame:
    """The level table after removal: what :func:`burst_merges` joined, numbered on from zero."""
    joined = merged.groupBy("particle", F.col("merged_ind").alias("level_ind")).agg(
        F.min("start_s").alias("start_s"),
        F.max("end_s").alias("end_s"),
        F.sum("num_photons").alias("num_photons"),
        F.count(F.lit(1)).alias("num_merged"),
    )
    dwell = F.col("end_s") - F.col("start_s")
    return joined.withColumn("dwell_s", dwell).withColumn("int_p_s", F.try_divide("num_photons", "dwell_s"))


def burst_merges(levels: DataFrame) -> DataFrame:
    """Add ``merged_ind``, the level that remains after bursts have joined their neighbours.

    ``levels`` is read several times and should come from a stored table; ``level_ind`` is dense.  Every level counts
    one and every dropped border, put in just before the level it opened, takes one back, so the rows are moved once.
    """
    dropped = dropped_borders(settle(burst_directions(levels)))
    opened = levels.withColumns({"_at": F.col("level_ind") * 2 + 1, "_step": F.lit(1)})
    closed = dropped.select("particle", (F.col("level_ind") * 2).alias("_at"), F.lit(-1).alias("_step"))
    both = opened.unionByName(closed, allowMissingColumns=True)
    numbered = running_total(both, ["particle"], "_at", F.col("_step"), "merged_ind", 2 * BLOCK).where("_step = 1")
    return numbered.withColumn("merged_ind", F.col("merged_ind") - 1).drop("_at", "_step")
