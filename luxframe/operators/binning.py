"""Intensity traces, decay histograms and distributions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from luxframe.operators.ordered import dense_spine, index_rows, moving_frame, running_total, whole
from luxframe.session import settle

EDGE = 1e-9  # values that sit on a bin edge up to floating error belong to the bin that starts there


def bin_trace(photons: DataFrame, bin_ns: int) -> DataFrame:
    """Dense photon counts per time bin from 0; the last bin also takes its right edge."""
    counted = settle(  # the one pass over the photons; everything below reads this table
        photons.groupBy("particle", whole(F.col("abs_ns"), bin_ns).alias("bin")).agg(
            F.count(F.lit(1)).alias("counts"), F.max("abs_ns").alias("_last_ns")
        )
    )
    bounds = counted.groupBy("particle").agg(F.max("_last_ns").alias("_last_ns"))
    bins = F.greatest(whole(F.col("_last_ns") + (bin_ns - 1), bin_ns), F.lit(1))
    bounds = bounds.select("particle", bins.alias("bins"))
    closed = (
        counted.join(bounds, "particle")
        .groupBy("particle", F.least("bin", F.col("bins") - 1).alias("bin"))
        .agg(F.sum("counts").alias("counts"))
    )
    return (
        dense_spine(bounds, ["particle"], "bins", "bin")
        .join(closed, ["particle", "bin"], "left")
        .select(
            "particle",
            "bin",
            (F.col("bin") * F.lit(bin_ns) / 1e6).alias("t_ms"),
            F.coalesce("counts", F.lit(0)).alias("counts"),
        )
    )


def micro_counts(photons: DataFrame, scope: list[str]) -> DataFrame:
    """Photons per distinct micro time.

    A timing card has a few thousand channels, so this one pre-aggregated pass turns any number of
    photons into a small table that all decay operators share.  It is stored, so that none of them
    goes back to the photons.
    """
    return settle(photons.groupBy(*scope, "micro_ns").agg(F.count(F.lit(1)).alias("n")))


def channel_width(micro: DataFrame, scope: list[str], fallback_ns: float) -> DataFrame:
    """Smallest real spacing between the spacings of the distinct micro times."""
    order = W.partitionBy(*scope)
    spacing = (
        micro.select(*scope, "micro_ns")
        .distinct()
        .withColumn("_gap", F.col("micro_ns") - F.lag("micro_ns").over(order.orderBy("micro_ns")))
        .withColumn("_gap", F.round("_gap", 9))
        .select(*scope, "_gap")
        .distinct()
        .withColumn("_step", F.col("_gap") - F.lag("_gap").over(order.orderBy("_gap")))
        .withColumn("_step", F.round("_step", 9))
    )
    return spacing.groupBy(*scope).agg(
        F.coalesce(F.min(F.when(F.col("_step") > 1e-4, F.col("_step"))), F.lit(fallback_ns)).alias("channel_width_ns")
    )


def global_tmin(micro: DataFrame) -> DataFrame:
    return micro.agg(F.min("micro_ns").alias("tmin_ns"))


def decay_bounds(micro: DataFrame, scope: list[str], width: float, tmin: Column, tmax: float) -> DataFrame:
    """Lower edge, number of edges and first kept bin of each decay histogram."""
    limits = micro.groupBy(*scope).agg(F.min("micro_ns").alias("_lo"), F.max("micro_ns").alias("_hi"))
    upper = micro.join(limits, scope).groupBy(*scope).agg(
        F.min("_lo").alias("_lo"),
        F.max(F.when(F.col("micro_ns") < F.greatest(F.lit(tmax), F.col("_hi")), F.col("micro_ns"))).alias("_top"),
    )
    low = F.least(tmin, F.col("_lo"))
    edges = F.ceil((F.col("_top") - F.col("lo_ns")) / F.lit(width) - EDGE).cast("bigint")
    return (
        upper.withColumn("lo_ns", low)
        .withColumn("bins", edges - 1)
        .withColumn("skip", F.when(F.col("lo_ns") <= 0, F.floor(-F.col("lo_ns") / F.lit(width) + EDGE) + 1).otherwise(0))
        .select(*scope, "lo_ns", "bins", "skip")
    )


def decay_histogram(
    micro: DataFrame, scope: list[str], width: float, tmin: Column | None = None, tmax: float = 25.0
) -> DataFrame:
    """Dense micro-time histogram per scope: ``ch`` from 0, ``t_ns``, ``counts``.

    Edges run from the earliest time in steps of ``width`` below the largest time under ``tmax``
    (or under the maximum, if later); bins starting at or below zero are dropped, later photons are
    left out and the last bin includes its right edge.
    """
    bounds = decay_bounds(micro, scope, width, F.lit(0.0) if tmin is None else tmin, tmax)
    place = F.floor((F.col("micro_ns") - F.col("lo_ns")) / F.lit(width) + EDGE).cast("bigint")
    right = F.abs(F.col("micro_ns") - (F.col("lo_ns") + F.col("bins") * F.lit(width))) <= F.lit(EDGE) * F.lit(width)
    binned = (
        micro.join(bounds, scope)
        .withColumn("_bin", F.when(right, F.col("bins") - 1).otherwise(place))
        .where((F.col("_bin") >= F.col("skip")) & (F.col("_bin") < F.col("bins")))
        .groupBy(*scope, (F.col("_bin") - F.col("skip")).alias("ch"))
        .agg(F.sum("n").alias("counts"))
    )
    spine = dense_spine(bounds.withColumn("_kept", F.col("bins") - F.col("skip")), scope, "_kept", "ch")
    return spine.join(binned, [*scope, "ch"], "left").select(
        *scope,
        "ch",
        (F.col("ch") * F.lit(width)).alias("t_ns"),
        F.coalesce("counts", F.lit(0)).alias("counts"),
    )


def decay_arrays(decays: DataFrame, scope: list[str]) -> DataFrame:
    """One row per decay; the arrays have one entry per timing channel."""
    packed = decays.groupBy(*scope).agg(
        F.array_sort(F.collect_list(F.struct("ch", "t_ns", "counts"))).alias("_points")
    )
    return packed.select(
        *scope, F.col("_points.t_ns").alias("t_ns"), F.col("_points.counts").alias("counts")
    )


def decay_startpoint(decays: DataFrame, run: int = 10) -> DataFrame:
    """Mean over particles of the channel where the rise begins.

    Walking back from the maximum, the first run of more than ``run`` empty channels marks the
    start; without a run it is the empty channel nearest to the maximum, without any it is 0.
    """
    peak = decays.groupBy("particle").agg(F.max_by("ch", F.struct("counts", -F.col("ch"))).alias("peak"))
    back = (
        decays.join(peak, "particle")
        .where((F.col("ch") < F.col("peak")) & (F.col("counts") == 0))
        .select("particle", "peak", (F.col("peak") - 1 - F.col("ch")).alias("back"))
    )
    order = W.partitionBy("particle").orderBy("back")  # at most one row per timing channel
    runs = (
        back.withColumn("_new", F.when(F.col("back") - F.lag("back").over(order) == 1, 0).otherwise(1))
        .withColumn("_run", F.sum("_new").over(order))
        .withColumn("_rank", F.row_number().over(W.partitionBy("particle", "_run").orderBy("back")))
    )
    start = runs.groupBy("particle", "peak").agg(
        F.coalesce(F.min(F.when((F.col("_rank") == run + 1), F.col("back") - 1)), F.min("back")).alias("_back")
    )
    joined = peak.join(start.select("particle", "_back"), "particle", "left")
    index = F.when(F.col("_back").isNull(), 0).otherwise(F.col("peak") - F.col("_back"))
    return joined.agg(F.avg(index).alias("start_channel"), F.count(F.lit(1)).alias("particles"))


def trimmed_curve(curve: DataFrame, scope: list[str], width_s: Column) -> DataFrame:
    """Instrument response from raw counts: trailing empty channels dropped, time in ns."""
    last = curve.where("counts > 0").groupBy(*scope).agg(F.max("ch").alias("_last"))
    return (
        curve.join(last, scope)
        .where("ch <= _last")
        .select(*scope, "ch", (F.col("ch") * width_s * 1e9).alias("t_ns"), "counts")
    )


def intensity_hist(trace: DataFrame, bins: int = 100) -> DataFrame:
    """Histogram of the negated trace counts, scaled to a maximum of one."""
    values = trace.groupBy("particle", "counts").agg(F.count(F.lit(1)).alias("n"))
    edges = values.groupBy("particle").agg((-F.max("counts")).alias("lo"), (-F.min("counts")).alias("hi"))
    spot = _even_bin(-F.col("counts"), bins)
    hist = values.join(_never_flat(edges), "particle").groupBy("particle", spot.alias("bin")).agg(F.sum("n").alias("n"))
    return _scaled(hist, "n", bins)


def level_int_hist(levels: DataFrame, trace: DataFrame, bin_ms: float, bins: int = 100) -> DataFrame:
    """Dwell-weighted histogram of level intensities per trace bin, on the trace's own edges."""
    edges = trace.groupBy("particle").agg((-F.max("counts")).alias("lo"), (-F.min("counts")).alias("hi"))
    value = -(F.col("int_p_s") * F.lit(bin_ms / 1000.0))
    hist = (
        levels.join(_never_flat(edges), "particle")
        .where((value >= F.col("lo")) & (value <= F.col("hi")))
        .groupBy("particle", _even_bin(value, bins).alias("bin"))
        .agg(F.sum("dwell_s").alias("n"))
    )
    return _scaled(hist, "n", bins)


def _never_flat(edges: DataFrame) -> DataFrame:
    flat = F.col("lo") == F.col("hi")
    return edges.select(
        "particle",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )


def _even_bin(value: Column, bins: int) -> Column:
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return F.least(F.floor((value - F.col("lo")) / width + EDGE), F.lit(bins - 1)).cast("bigint")


def _scaled(hist: DataFrame, weight: str, bins: int) -> DataFrame:
    top = hist.groupBy("particle").agg(F.max(weight).alias("_top"))
    full = dense_spine(top.withColumn("_bins", F.lit(bins)), ["particle"], "_bins", "bin")
    return full.join(hist, ["particle", "bin"], "left").select(
        "particle", "bin", (F.coalesce(F.col(weight), F.lit(0)) / F.col("_top")).alias("frequency")
    )


def quantiles(values: DataFrame, column: str, shares: list[float]) -> list[float]:
    """Exact linearly interpolated quantiles of a whole column.

    Copies of a value are counted first; the distinct values are then ranked by a range sort, so no
    task holds the column, and only the rows around each quantile come back.
    """
    counted = values.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("_x")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    ranked = running_total(index_rows(counted, [], ["_x"], "_rank"), [], "_rank", F.col("_n"), "_upto")
    total = ranked.agg(F.sum("_n")).first()[0]
    places = [(total - 1) * share for share in shares]
    wanted = sorted({rank for place in places for rank in (math.floor(place), math.ceil(place))})
    holds = [
        F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank), F.col("_x"))) for rank in wanted
    ]
    found = dict(zip(wanted, ranked.agg(*holds).first()))
    return [
        found[math.floor(p)] + (found[math.ceil(p)] - found[math.floor(p)]) * (p - math.floor(p)) for p in places
    ]


def feature_hist(values: DataFrame, feature: str, bins: int | None = None) -> DataFrame:
    """Distribution of one level feature; ``bins=None`` picks the width from the data.

    The automatic width is the smaller of the Sturges and the Freedman-Diaconis widths.
    """
    clean = values.where(F.col(feature).isNotNull() & ~F.isnan(feature)).select(F.col(feature).cast("double").alias("x"))
    n, low, high = clean.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    if not n:
        return clean.sparkSession.createDataFrame([], "bin bigint, left_edge double, counts bigint")
    if bins is None:
        q1, q3 = quantiles(clean, "x", [0.25, 0.75])
        sturges = (high - low) / (math.log2(n) + 1)
        freedman = 2 * (q3 - q1) / n ** (1 / 3)
        width = sturges if freedman == 0 else min(sturges, freedman)
        bins = max(math.ceil((high - low) / width), 1) if width > 0 else 1
    width = (high - low) / bins
    place = F.floor((F.col("x") - F.lit(low)) / F.lit(width)) if width > 0 else F.lit(0)
    spot = F.least(place, F.lit(bins - 1)).cast("bigint")
    counted = clean.groupBy(spot.alias("bin")).agg(F.count(F.lit(1)).alias("counts"))
    return (
        clean.sparkSession.range(bins)
        .withColumnRenamed("id", "bin")
        .join(counted, "bin", "left")
        .select(
            "bin",
            (F.lit(low) + F.col("bin") * F.lit(width)).alias("left_edge"),
            F.coalesce("counts", F.lit(0)).alias("counts"),
        )
    )


def moving_average(series: DataFrame, scope: list[str], pos: str, value: str, window: int) -> DataFrame:
    """Mean over ``window`` rows with zeros beyond both ends."""
    lag, lead = window // 2, -(-window // 2) - 1
    summed = moving_frame(series, scope, pos, F.sum(value), "_sum", lead, lag)
    return summed.withColumn("smooth", F.col("_sum") / F.lit(float(window))).drop("_sum")


def max_zero_run(series: DataFrame, scope: list[str], pos: str, value: str) -> DataFrame:
    """Longest run of consecutive zeros per scope, 0 without zeros."""
    filled = running_total(series, scope, pos, F.when(F.col(value) != 0, 1).otherwise(0), "_seen")
    runs = filled.groupBy(*scope, "_seen").agg(F.count(F.when(F.col(value) == 0, 1)).alias("_zeros"))
    return runs.groupBy(*scope).agg(F.max("_zeros").alias("max_zeros"))
