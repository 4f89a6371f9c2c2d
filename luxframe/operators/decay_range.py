"""Background, rise and fit range of fluorescence decays, on the table of their timing channels.

A decay has as many rows as its timing card has channels, so windows over one decay are short.
``channels`` tables hold every channel of a decay, ``(keys, ch, counts)`` with ``ch`` from zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from luxframe.config import FitSettings

SECTION = 50  # channels looked at when judging the background before the rise
WIDE = SECTION // 2  # a gap of so many empty channels parts an island from the decay
RESPONSE_HEAD = 20  # channels that tell the level before a response


def channels_of(decays: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per channel of ``(keys, counts array)``."""
    return decays.select(*keys, F.posexplode("counts").alias("ch", "counts"))


def smoothed(counts: str, window: int) -> Column:
    """Moving mean of a counts array with zeros beyond both ends, at most a tenth of the decay wide."""
    size = F.size(counts)
    width = F.least(F.lit(window), F.floor(size / 10).cast("int"))
    back = F.floor(width / 2).cast("int")

    def mean(_: Column, at: Column) -> Column:
        first = F.greatest(at - back, F.lit(0))
        last = F.least(at - back + width - 1, size - 1)
        total = F.aggregate(F.slice(counts, first + 1, last - first + 1), F.lit(0.0), lambda s, x: s + x)
        return total / width

    return F.when(width < 1, F.transform(counts, lambda x: x.cast("double"))).otherwise(F.transform(counts, mean))


def _starts(channels: DataFrame, keys: list[str]) -> DataFrame:
    """Peak, largest count, number of channels and the first channel of the decay itself.

    Filled channels form islands.  The decay starts with the first island that no wide gap breaks
    within half a section and that leaves two sections behind it; failing that, with the first
    filled channel.
    """
    whole = channels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("size"),
        F.max("counts").alias("top"),
        F.max_by("ch", F.struct("counts", -F.col("ch"))).alias("peak"),
    )
    up, down = W.partitionBy(*keys).orderBy("ch"), W.partitionBy(*keys).orderBy(F.desc("ch"))
    filled = channels.where("counts > 0").join(whole.select(*keys, "size"), keys)
    after = F.coalesce(F.lead("ch").over(up), F.col("size"))
    gaps = filled.select(
        *keys,
        "ch",
        "size",
        (F.col("ch") - F.lag("ch").over(up) > 1).alias("apart"),
        F.when(after - F.col("ch") > WIDE, F.col("ch")).alias("broken"),
    ).withColumn("next_break", F.min("broken").over(down.rowsBetween(W.unboundedPreceding, 0)))
    head = F.coalesce("apart", F.lit(True))
    steady = F.coalesce(F.col("next_break") - F.col("ch") >= WIDE, F.lit(True))
    roomy = F.col("size") - F.col("ch") > 2 * SECTION
    first = gaps.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(head & steady & roomy, F.col("ch"))), F.min("ch")).alias("start")
    )
    return whole.join(first, keys, "left")


def background(channels: DataFrame, keys: list[str], bg_percent: float = 5.0) -> DataFrame:
    """``rise_ch`` and ``bg`` of each decay.

    The rise starts at the last channel before the peak that is not above the mean of the decay's
    first section; the background is the mean up to there, at most a share of the peak.
    """
    one = W.partitionBy(*keys)
    ch, counts = F.col("ch"), F.col("counts")
    placed = channels.join(_starts(channels, keys), keys)
    typical = F.avg(F.when(ch.between(F.col("start"), F.col("start") + SECTION - 1), counts)).over(one)
    quiet = (ch >= F.col("start")) & (ch < F.col("peak")) & (counts <= F.col("typical"))
    rise = F.coalesce(F.max(F.when(quiet, ch)).over(one), F.col("start") + SECTION, F.lit(0))
    risen = placed.withColumn("typical", typical).withColumn("rise_ch", rise)
    level = F.avg(F.when((ch >= F.col("start")) & (ch < F.col("rise_ch")), counts))
    return risen.groupBy(*keys).agg(
        F.first("rise_ch").cast("int").alias("rise_ch"),
        F.least(F.coalesce(level, F.lit(0.0)), bg_percent / 100 * F.first("top")).cast("double").alias("bg"),
    )


def response_background(channels: DataFrame, keys: list[str]) -> DataFrame:
    """``irf_bg``: mean before the last channel up to the peak that is at the level of the first ones."""
    one = W.partitionBy(*keys)
    ch, whole_counts = F.col("ch"), F.col("counts").cast("bigint")
    level = F.floor(F.avg(F.when(ch < RESPONSE_HEAD, F.col("counts"))).over(one))
    peak = F.max_by("ch", F.struct("counts", -ch)).over(one)
    marked = channels.withColumn("level", level).withColumn("peak", peak)
    like = (ch > 0) & (ch <= F.col("peak")) & (whole_counts == F.col("level"))
    ended = marked.withColumn("last", F.max(F.when(like, ch)).over(one))
    return ended.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(ch < F.col("last"), F.col("counts"))), F.lit(0.0)).alias("irf_bg")
    )


def fit_ranges(
    decays: DataFrame,
    keys: list[str],
    width_ns: float,
    bg: float | None = None,
    start_mode: str = "(Close to) max",
    start: int | None = None,
    end: int | None = None,
    auto_end: bool = True,
    settings: FitSettings = FitSettings(),
    method: str = "ls",
) -> DataFrame:
    """``estimated_bg, bg, first_ch, last_ch`` of each ``(keys, counts array)`` row.

    ``start_mode`` is one of Manual, (Close to) max, Rise middle, Rise start, Safe rise start; ``bg``
    replaces the estimated background.
    """
    s = settings
    slim = decays.select(*keys, "counts")
    estimated = background(channels_of(slim, keys), keys, s.bg_percent).select(*keys, F.col("bg").alias("estimated_bg"))
    if s.use_moving_avg:
        slim = slim.withColumn("counts", smoothed("counts", s.moving_avg_window))
    series = channels_of(slim, keys)
    rise = background(series, keys).select(*keys, "rise_ch")
    one, ch, counts = W.partitionBy(*keys), F.col("ch"), F.col("counts")
    least = int(round(s.minimum_decay_window_ns / width_ns))

    near = F.min(F.when(counts > s.start_percent / 100 * F.col("top"), ch)).over(one)
    faced = (
        series.join(rise, keys)
        .join(estimated, keys)
        .withColumn("bg", F.col("estimated_bg") if bg is None else F.lit(float(bg)))
        .withColumn("top", F.max("counts").over(one))
        .withColumn("size", F.count(F.lit(1)).over(one))
        .withColumn("near", near)
    )
    risen, close = F.col("rise_ch"), F.col("near")
    begins = {
        "Manual": F.lit(start or 0),
        "(Close to) max": close,
        "Rise middle": F.floor((risen + close) / 2),
        "Rise start": risen,
        "Safe rise start": risen - F.least(close - risen, F.lit(10)),
    }[start_mode]
    anchor = F.col("begin") if start_mode == "Manual" else close
    floor = F.greatest(s.end_multiple * F.col("bg"), s.end_percent / 100 * F.col("top"))
    bright = (ch >= F.col("begin")) & (counts > floor) & (ch < F.col("size") - 1)
    found = faced.withColumn("begin", begins.cast("int")).groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("estimated_bg", "bg", "size", "near", "begin")],
        F.max(F.when(bright, ch)).alias("bright"),
    )
    if auto_end:
        stop = F.coalesce("bright", F.col("begin") + least)
        if s.use_moving_avg:
            stop = stop + int(round(s.moving_avg_window / 2))
    elif end is not None:
        stop = F.least(F.lit(end), F.col("size") - 1)
    else:
        stop = F.col("size") - (1 if method == "ls" else 0)
    short = width_ns * (F.col("stop") - F.col("begin")) < s.minimum_decay_window_ns
    earlier = int(round(0.3 * s.minimum_decay_window_ns / width_ns)) if start_mode == "Safe rise start" else 0
    return found.withColumn("stop", stop).select(
        *keys,
        "estimated_bg",
        "bg",
        F.when(short, F.col("begin") - earlier).otherwise(F.col("begin")).cast("int").alias("first_ch"),
        F.when(short, anchor + least).otherwise(F.col("stop")).cast("int").alias("last_ch"),
    )


def convolved_curves(
    decays: DataFrame, keys: list[str], tau: list[float], amp: list[float], irf: list[float], shift: float = 0.0
) -> DataFrame:
    """``model array``: exponentials convolved with the shifted response, one value per channel of ``t_ns``.

    Only the response's filled channels take part.  A response shifted beyond an end comes in at the
    other, linearly shared between two channels.
    """
    whole = int(shift // 1)
    part = shift - whole
    places = [(k + d, v * w) for k, v in enumerate(irf) if v for d, w in ((whole, 1 - part), (whole + 1, part)) if w]
    size, step = F.size("t_ns"), F.col("t_ns")[1] - F.col("t_ns")[0]
    response = F.array(
        *[F.struct(F.pmod(F.lit(k), size).alias("at"), F.lit(float(v)).alias("weight")) for k, v in places]
    )

    def value(_: Column, at: Column) -> Column:
        def add(total: Column, peak: Column) -> Column:
            age = (at - peak["at"]) * step
            grown = sum((F.lit(float(a)) * F.exp(-age / float(t)) for t, a in zip(tau, amp, strict=True)), F.lit(0.0))
            return total + F.when(peak["at"] <= at, peak["weight"] * grown).otherwise(0.0)

        return F.aggregate(response, F.lit(0.0), add)

    return decays.withColumn("model", F.transform("t_ns", value))
