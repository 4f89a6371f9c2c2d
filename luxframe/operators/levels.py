"""From change points to levels, and what is read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from luxframe.operators.ordered import following_position, index_rows, last_known, neighbours, ordinal, rows_in_intervals, running_total
from luxframe.session import settle


def define_levels(cpts: DataFrame, totals: DataFrame, overlapping: bool = False) -> DataFrame:
    """Index ranges of the levels: ``cpts(particle, cpt_ind)``, ``totals(particle, num_photons)``.

    Levels are disjoint.  ``overlapping=True`` also counts the boundary photon to the earlier of two
    interior levels, which makes an interior range end one photon later.
    """
    points = cpts.select("particle", F.col("cpt_ind").alias("first_ind"))
    starts = totals.select("particle", F.lit(0).cast("bigint").alias("first_ind")).unionByName(
        points.where("first_ind > 0").distinct()
    )
    chained = following_position(starts, ["particle"], "first_ind", "_next")
    numbered = ordinal(chained, ["particle"], "first_ind", "level_ind")
    last = F.coalesce(F.col("_next"), F.col("num_photons")) - 1
    if overlapping:
        following = neighbours(numbered, ["particle"], "level_ind", after={"_after": "_next"})
        interior = (F.col("level_ind") > 0) & F.col("_after").isNotNull() & F.col("_next").isNotNull()
        numbered, last = following, last + F.when(interior, 1).otherwise(0)
    return numbered.join(totals, "particle").select("particle", "level_ind", "first_ind", last.alias("last_ind"))


def photons_in_levels(photons: DataFrame, levels: DataFrame) -> DataFrame:
    """Every photon with the level that contains it."""
    bounds = levels.select("particle", "level_ind", "first_ind", "last_ind")
    stored = "block" if "block" in photons.columns else None  # rows of a photon store
    return rows_in_intervals(photons, bounds, ["particle"], "photon_ind", "first_ind", "last_ind", stored=stored)


def level_stats(photons: DataFrame, levels: DataFrame) -> DataFrame:
    """Start, end, photon number, dwell time and intensity of each level."""
    kept = [c for c in ("particle", "photon_ind", "abs_ns", "block") if c in photons.columns]
    inside = photons_in_levels(photons.select(*kept), levels)
    times = inside.groupBy("particle", "level_ind").agg(
        F.min("first_ind").alias("first_ind"),
        F.min("last_ind").alias("last_ind"),
        F.min("abs_ns").alias("start_ns"),
        F.max("abs_ns").alias("end_ns"),
    )
    return with_intensity(times.withColumn("num_photons", F.col("last_ind") - F.col("first_ind") + 1))


def with_intensity(levels: DataFrame) -> DataFrame:
    dwell = (F.col("end_ns") - F.col("start_ns")) / 1e9
    return levels.withColumn("dwell_s", dwell).withColumn("int_p_s", F.try_divide("num_photons", "dwell_s"))


def photon_totals(photons: DataFrame) -> DataFrame:
    return photons.groupBy("particle").agg(F.count(F.lit(1)).alias("num_photons"))


def particle_stats(photons: DataFrame, levels: DataFrame) -> DataFrame:
    whole = photons.groupBy("particle").agg(
        F.count(F.lit(1)).alias("num_photons"), ((F.max("abs_ns") - F.min("abs_ns")) / 1e9).alias("dwell_s")
    )
    counted = levels.groupBy("particle").agg(F.count(F.lit(1)).alias("num_levels"))
    return whole.join(counted, "particle", "left").select(
        "particle", "num_photons", "dwell_s", F.coalesce("num_levels", F.lit(0)).alias("num_levels")
    )


def weighted_mean_std(levels: DataFrame) -> DataFrame:
    """Dwell-weighted mean and population deviation of the level intensities."""
    mean = levels.groupBy("particle").agg(
        (F.sum(F.col("dwell_s") * F.col("int_p_s")) / F.sum("dwell_s")).alias("mean_int")
    )
    spread = F.sqrt(F.sum(F.col("dwell_s") * F.pow(F.col("int_p_s") - F.col("mean_int"), F.lit(2))) / F.sum("dwell_s"))
    return levels.join(settle(mean), "particle").groupBy("particle").agg(
        F.min("mean_int").alias("mean_int"), spread.alias("std_int")
    )


def level_at_time(levels: DataFrame, probes: DataFrame) -> DataFrame:
    """First level with start <= t <= end for probes(particle, t_ns).

    Level starts and probes are put in one order and the last start is carried forward, so the work
    is linear in both; where two levels share an instant the earlier one is taken.
    """
    found = neighbours(
        levels.select("particle", "level_ind", "start_ns", "end_ns"), ["particle"], "level_ind", before={"_before": "end_ns"}
    )
    starts = found.select(
        "particle",
        F.col("start_ns").alias("t_ns"),
        F.lit(0).alias("_kind"),
        F.struct("level_ind", "end_ns", "_before").alias("_level"),
    )
    asked = probes.select("particle", "t_ns").distinct().withColumn("_kind", F.lit(1))
    merged = index_rows(starts.unionByName(asked, allowMissingColumns=True), ["particle"], ["t_ns", "_kind"], "_at")
    carried = last_known(merged, ["particle"], "_at", F.col("_level"), "_hit").where("_kind = 1")
    earlier = F.col("_hit._before") >= F.col("t_ns")
    return carried.where(earlier | (F.col("_hit.end_ns") >= F.col("t_ns"))).select(
        "particle", "t_ns", (F.col("_hit.level_ind") - F.when(earlier, 1).otherwise(0)).alias("level_ind")
    )


def step_vertices(levels: DataFrame, value: str, start: str, end: str) -> DataFrame:
    """Two vertices per level, at its start and at its end, for a step curve."""
    ends = F.array(F.struct(F.lit(0).alias("vertex"), F.col(start).alias("t")), F.struct(F.lit(1).alias("vertex"), F.col(end).alias("t")))
    return levels.withColumn("_v", F.explode(ends)).select(
        "particle", "level_ind", F.col("_v.vertex").alias("vertex"), F.col("_v.t").alias("t"), F.col(value).alias("y")
    )


def lifetime_trace(levels: DataFrame) -> DataFrame:
    return step_vertices(levels.where("av_tau IS NOT NULL"), "av_tau", "start_s", "end_s")


def concatenated(levels: DataFrame, order: Column) -> DataFrame:
    """Levels of many particles on one shared time axis, one particle after the other.

    The offsets come from one row per particle; ``order`` fixes the sequence of particles.
    """
    spans = levels.groupBy("particle").agg(
        F.sum("dwell_ms").alias("_span"), F.count(F.lit(1)).alias("_levels")
    ).withColumn("_order", order)
    placed = index_rows(spans, [], ["_order"], "particle_ind")
    placed = running_total(placed, [], "particle_ind", F.col("_span"), "_until")
    placed = running_total(placed, [], "particle_ind", F.col("_levels"), "_numbered")
    offsets = placed.select(
        "particle", "particle_ind", (F.col("_until") - F.col("_span")).alias("offset_ms"),
        (F.col("_numbered") - F.col("_levels")).alias("first_level"),
    )
    return levels.join(offsets, "particle").select(
        "particle",
        "particle_ind",
        "level_ind",
        (F.col("first_level") + F.col("level_ind")).alias("global_ind"),
        ((F.col("offset_ms") + F.col("end_ms") - F.col("dwell_ms")) / 1000.0).alias("global_start_s"),
        ((F.col("offset_ms") + F.col("end_ms")) / 1000.0).alias("global_end_s"),
        "num_photons",
        "dwell_s",
    )
