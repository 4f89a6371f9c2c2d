"""Lifetime fits: one row per decay in, one row per decay out."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from luxframe.functions.decay import DW_TERMS, FitModel, Limits, fit_decay
from luxframe.operators.decay_range import convolved_curves, fit_ranges, response_background
from luxframe.session import shuffle_width

_KINDS = {
    T.IntegerType(): ("numexp", "num_points", "start_ch"),
    T.StringType(): ("method", "error"),
    T.ArrayType(T.DoubleType()): ("tau", "amp", "tau_std", "amp_std", "model", "residual"),
    T.DoubleType(): (
        *("avtau", "avtau_std", "shift_ns", "shift_std_ns", "bg", "bg_std", "irf_bg", "fwhm", "chisq"),
        *("dw", "dw_5", "dw_1", "dw_03", "dw_01", "start_ns", "end_ns", "photons_used"),
    ),
}
RESULT = T.StructType([T.StructField(name, kind) for kind, names in _KINDS.items() for name in names])
MIN_PHOTONS = 10


def fit_lifetimes(
    decays: DataFrame, keys: list[str], width_ns: float, model: FitModel = FitModel(), irf: list[float] | None = None
) -> DataFrame:
    """Fit each ``(keys, t_ns array, counts array)`` row holding more than ten photons.

    Background and fit range come from the channel table; the task only searches parameters.  A fit
    that fails leaves its row with ``error`` set and no results.  Rows are spread by key first,
    because a fit costs far more than its bytes suggest.
    """
    irf_bg = 0.0 if irf is None else _level_of(decays.sparkSession, irf)
    names = [f.name for f in RESULT.fields]
    key_fields = [f for f in decays.schema.fields if f.name in keys]
    schema = T.StructType([*key_fields, *RESULT.fields])

    def fit(frames):
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                try:
                    limits = Limits(row.first_ch, row.last_ch, row.bg, row.estimated_bg, irf_bg)
                    result = fit_decay(row.counts, row.t_ns, width_ns, model, limits, irf)
                except (ValueError, IndexError, ZeroDivisionError) as problem:
                    result = {**dict.fromkeys(names), "numexp": model.numexp, "method": model.method, "error": str(problem)}
                rows.append([getattr(row, f.name) for f in key_fields] + [result[n] for n in names])
            yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    enough = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c) > MIN_PHOTONS
    filled = decays.where(enough)
    m = model
    ranges = fit_ranges(filled, keys, width_ns, m.bg, m.start_mode, m.start, m.end, m.auto_end, m.settings, m.method)
    bounded = filled.select(*keys, "t_ns", "counts").join(ranges, keys)
    return bounded.repartition(shuffle_width(decays.sparkSession), *keys).mapInPandas(fit, schema)


def _level_of(spark: SparkSession, irf: list[float]) -> float:
    """Background of one response, a list of its timing channels."""
    rows = spark.createDataFrame([(0, k, float(v)) for k, v in enumerate(irf)], "one int, ch int, counts double")
    return response_background(rows, ["one"]).first()["irf_bg"]


def preview(decays: DataFrame, keys: list[str], tau: list[float], amp: list[float], irf: list[float], shift: float) -> DataFrame:
    """Model curve over each decay without fitting it, scaled to the decay's counts."""
    drawn = convolved_curves(decays, keys, tau, amp, irf, shift)
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    factor = F.try_divide(add("counts"), add("model"))
    return drawn.withColumn("_f", factor).select(*keys, F.transform("model", lambda x: x * F.col("_f")).alias("model"))


def dw_bound(points: Column, numexp: int, level: int) -> Column:
    """Lower Durbin-Watson bound at 5 or 1 % as a Spark expression."""
    root = F.sqrt(points)
    b1, b2, b3, b4 = DW_TERMS[level][numexp - 1]
    return F.bround(2 + b1 / root + b2 / points + b3 / (root * root * root) + b4 / (points * points), 3)


def dw_normal_bound(points: Column, deviations: float) -> Column:
    """Bound from the normal approximation (3 deviations: 0.3 %, 3.28: 0.1 %)."""
    variance = 4 * points * points * (points - 2) / ((points + 1) * F.pow(points - 1, F.lit(3)))
    return F.bround(2 - deviations * F.sqrt(variance), 3)


def average_lifetime(tau: str, amp: str) -> Column:
    """Amplitude-weighted mean of the lifetimes."""
    weighted = F.aggregate(F.zip_with(tau, amp, lambda t, a: t * a), F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(weighted, F.aggregate(amp, F.lit(0.0), lambda s, x: s + x))


def average_lifetime_std(tau: str, amp: str, tau_std: str, amp_std: str) -> Column:
    """Propagated deviation of the amplitude-weighted lifetime."""
    parts = F.transform(
        F.arrays_zip(tau, amp, tau_std, amp_std),
        lambda p: F.pow(p[tau] * p[amp], F.lit(2))
        * (F.pow(p[tau_std] / p[tau], F.lit(2)) + F.pow(p[amp_std] / p[amp], F.lit(2))),
    )
    return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))


def fit_statistics(curves: DataFrame, keys: list[str], pos: str, numexp: int) -> DataFrame:
    """χ² and Durbin-Watson from rows ``(keys, pos, counts, model)``.

    ``pos`` counts the timing channels of one decay, so the window below is as short as the decay.
    """
    from pyspark.sql import Window as W

    order = W.partitionBy(*keys).orderBy(pos)
    residual = (F.col("model") - F.col("counts")) / F.sqrt(F.abs("model"))
    rows = curves.where("model <> 0").withColumn("_r", residual).withColumn("_d", F.col("_r") - F.lag("_r").over(order))
    return rows.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("_r") * F.col("_r")), (F.count(F.lit(1)) - 2 * numexp - 1).cast("double")).alias("chisq"),
        F.try_divide(F.sum(F.col("_d") * F.col("_d")), F.sum(F.col("_r") * F.col("_r"))).alias("dw"),
        F.count(F.lit(1)).alias("num_points"),
    )


def colour_shift(curve: DataFrame, keys: list[str], size: str, shift: float) -> DataFrame:
    """Circular shift of ``(keys, ch, size, counts)`` curves by a fractional number of channels.

    Each channel gives its two shares to its targets, so the shift is one aggregation.
    """
    whole = math.floor(shift)
    part = shift - whole
    moves = F.array(
        F.struct(F.lit(whole).alias("by"), F.lit(1 - part).alias("share")),
        F.struct(F.lit(whole + 1).alias("by"), F.lit(part).alias("share")),
    )
    return (
        curve.withColumn("_m", F.explode(moves))
        .groupBy(*keys, F.pmod(F.col("ch") + F.col("_m.by"), F.col(size)).alias("ch"))
        .agg(F.sum(F.col("counts") * F.col("_m.share")).alias("shifted"))
    )
