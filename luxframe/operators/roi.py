"""Regions of interest on photons and levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPSILON_S = 0.1


def full_roi(photons: DataFrame) -> DataFrame:
    return photons.groupBy("particle").agg(
        F.lit(0.0).alias("roi_start_s"), (F.max("abs_ns") / 1e9).alias("roi_end_s")
    )


def set_roi(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """Take over a requested region where it moved an edge by more than the tolerance."""
    asked = wanted.select("particle", F.col("roi_start_s").alias("_start"), F.col("roi_end_s").alias("_end"))
    joined = current.join(asked, "particle", "left")
    moved = F.coalesce(
        (F.abs(F.col("_start") - F.col("roi_start_s")) > EPSILON_S)
        | (F.abs(F.col("_end") - F.col("roi_end_s")) > EPSILON_S),
        F.lit(False),
    )
    return joined.select(
        "particle",
        F.when(moved, F.col("_start")).otherwise(F.col("roi_start_s")).alias("roi_start_s"),
        F.when(moved, F.col("_end")).otherwise(F.col("roi_end_s")).alias("roi_end_s"),
        moved.alias("changed"),
    )


def photon_bounds(photons: DataFrame, roi: DataFrame) -> DataFrame:
    """First and last photon of the region; an end beyond the trace means the last photon.

    The region only counts when an edge is more than half the tolerance inside the trace.
    """
    time = F.col("abs_ns") / 1e9
    found = photons.join(roi, "particle").groupBy("particle").agg(
        F.min(F.when(time >= F.col("roi_start_s"), F.col("photon_ind"))).alias("_first"),
        F.min(F.when(time >= F.col("roi_end_s"), F.col("photon_ind"))).alias("_last"),
        F.count(F.lit(1)).alias("_n"),
        F.max(time).alias("_stop"),
        F.min("roi_start_s").alias("_start"),
        F.min("roi_end_s").alias("_end"),
    )
    whole = (F.col("_start") < EPSILON_S / 2) & (F.abs(F.col("_stop") - F.col("_end")) <= EPSILON_S / 2)
    return found.select(
        "particle",
        F.when(whole, F.lit(0)).otherwise(F.coalesce("_first", F.lit(0))).cast("bigint").alias("first_photon"),
        F.when(whole, F.col("_n") - 1).otherwise(F.coalesce("_last", F.col("_n") - 1)).alias("last_photon"),
    )


def photon_count(bounds: DataFrame) -> DataFrame:
    return bounds.select("particle", (F.col("last_photon") - F.col("first_photon")).alias("num_photons_roi"))


def microtimes(photons: DataFrame, roi: DataFrame) -> DataFrame:
    """Micro times from the first photon in the region through the first one at or past its end."""
    time = F.col("abs_ns") / 1e9
    edges = photons.join(roi, "particle").groupBy("particle").agg(
        F.min(F.when(time >= F.col("roi_start_s"), F.col("photon_ind"))).alias("_first"),
        F.min(F.when(time >= F.col("roi_end_s"), F.col("photon_ind"))).alias("_last"),
        F.count(F.lit(1)).alias("_n"),
    )
    edges = edges.select(
        "particle", F.coalesce("_first", F.lit(0)).alias("_first"), F.coalesce("_last", F.col("_n") - 1).alias("_last")
    )
    return (
        photons.join(edges, "particle")
        .where(F.col("photon_ind").between(F.col("_first"), F.col("_last")))
        .select("particle", "photon_ind", "micro_ns")
    )


def level_bounds(levels: DataFrame, roi: DataFrame, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """First level ending after the region starts, last level that reaches its end (to the ms)."""
    reaches = F.bround(F.col(end), 3) >= F.bround(F.col("roi_end_s"), 3)
    return levels.join(roi, "particle").groupBy("particle").agg(
        F.coalesce(F.min(F.when(F.col(end) > F.col("roi_start_s"), F.col("level_ind"))), F.lit(0)).alias("first_level"),
        F.coalesce(F.min(F.when(reaches, F.col("level_ind"))), F.lit(0)).alias("last_level"),
    )


def levels_in_roi(levels: DataFrame, roi: DataFrame, last_included: bool = True) -> DataFrame:
    """Levels of the region; ``last_included=False`` leaves out its final level."""
    upper = F.col("last_level") if last_included else F.col("last_level") - 1
    return (
        levels.join(level_bounds(levels, roi), "particle")
        .where(F.col("level_ind").between(F.col("first_level"), upper))
        .drop("first_level", "last_level")
    )


def dwell(levels: DataFrame, roi: DataFrame) -> DataFrame:
    return levels_in_roi(levels, roi).groupBy("particle").agg(
        (F.max("end_s") - F.min("start_s")).alias("dwell_roi_s"),
        F.count(F.lit(1)).alias("num_levels_roi"),
        F.sum("num_photons").alias("num_photons_roi"),
    )


def trim_trace(
    levels: DataFrame, min_dwell_s: float, min_int: float, roi: DataFrame | None = None
) -> DataFrame:
    """Cut the bleached tail off: levels after the last bright one.

    ``trimmed`` is null without a dim last level, false when the tail is too short or would leave
    fewer than two levels, and true when the region now ends with the last bright level.  With a
    ``roi`` its start is kept if at least half a second stays, and its end is never passed.
    """
    facts = levels.groupBy("particle").agg(
        F.max("level_ind").alias("_last"),
        F.max_by("int_p_s", "level_ind").alias("_last_int"),
        F.coalesce(F.max(F.when(F.col("int_p_s") > min_int, F.col("level_ind"))), F.lit(0)).alias("stop_level"),
    )
    dim_tail = (F.col("level_ind") > F.col("stop_level")) | (F.col("int_p_s") <= min_int)
    tails = levels.join(facts, "particle").groupBy("particle").agg(
        F.min("stop_level").alias("stop_level"),
        F.min("_last_int").alias("_last_int"),
        F.sum(F.when((F.col("level_ind") >= F.col("stop_level")) & dim_tail, F.col("dwell_s")).otherwise(0.0)).alias("tail_s"),
        F.max(F.when(F.col("level_ind") == F.col("stop_level"), F.col("end_s"))).alias("_active"),
    )
    start, end = F.lit(0.0), F.col("_active")
    if roi is not None:
        tails = tails.join(roi, "particle")
        keeps = (F.col("_active") - F.col("roi_start_s")) > 0.5
        start = F.when(keeps, F.col("roi_start_s")).otherwise(F.col("_active") - 0.5)
        end = F.least("_active", "roi_end_s")
    long_enough = (F.col("tail_s") >= min_dwell_s) & (F.col("stop_level") > 1) & (start >= 0)
    trimmed = F.when(F.col("_last_int") < min_int, long_enough)
    return tails.select(
        "particle",
        trimmed.alias("trimmed"),
        "tail_s",
        F.when(trimmed, start).alias("roi_start_s"),
        F.when(trimmed, end).alias("roi_end_s"),
        F.when(trimmed, F.col("stop_level")).alias("roi_last_level"),
    )
