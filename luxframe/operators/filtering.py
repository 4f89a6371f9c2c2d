"""Level filters, intensity-lifetime regression and normalisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from luxframe.config import Bound, LevelFilter

DW_COLUMNS = {"5%": "dw_5", "1%": "dw_1", "0.3%": "dw_03", "0.1%": "dw_01"}
FEATURES = ("num_photons", "int_p_s", "av_tau", "dw", "irf_shift", "chisq")


def _known(column: Column) -> Column:
    value = column.cast("double")
    return value.isNotNull() & ~F.isnan(F.coalesce(value, F.lit(0.0)))


def _within(column: Column, bound: Bound) -> Column:
    tests = [_known(column)]
    if bound.minimum is not None:
        tests.append(column >= bound.minimum)
    if bound.maximum is not None:
        tests.append(column <= bound.maximum)
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def feature_tests(rules: LevelFilter) -> dict[str, Column]:
    """Whether each feature is known and inside its bounds."""
    dw = _known(F.col("dw"))
    if rules.dw_test:
        dw = dw & F.coalesce(F.col("dw") >= F.col(DW_COLUMNS[rules.dw_test]), F.lit(False))
    return {
        "num_photons": _within(F.col("num_photons"), rules.photons),
        "int_p_s": _within(F.col("int_p_s"), rules.intensity),
        "av_tau": _within(F.col("av_tau"), rules.lifetime),
        "dw": dw,
        "irf_shift": _within(F.col("irf_shift"), rules.irf_shift),
        "chisq": _within(F.col("chisq"), rules.chi_squared),
    }


def masked_features(levels: DataFrame, rules: LevelFilter) -> DataFrame:
    """Each feature where it passes its own test, null elsewhere."""
    tests = feature_tests(rules)
    return levels.withColumns({name: F.when(tests[name], F.col(name)) for name in FEATURES})


def filter_all(levels: DataFrame, rules: LevelFilter) -> DataFrame:
    """Add ``is_filtered_out``: any of the six features unknown or out of bounds."""
    passed = reduce(lambda a, b: a & b, feature_tests(rules).values())
    return levels.withColumn("is_filtered_out", ~passed)


def export_tests(rules: LevelFilter) -> dict[str, Column]:
    tests: dict[str, Column] = {}

    def add(name: str, column: str, bound: Bound) -> None:
        if bound.maximum is not None:
            tests[f"failed_{name}_max"] = F.col(column) > bound.maximum
        if bound.minimum is not None:
            tests[f"failed_{name}_min"] = F.col(column) < bound.minimum

    add("photon", "num_photons", Bound(minimum=rules.photons.minimum))
    add("int", "int_p_s", rules.intensity)
    add("tau", "av_tau", rules.lifetime)
    if rules.dw_test:
        bound = DW_COLUMNS[rules.dw_test]
        tests[f"failed_{bound}"] = F.col("dw") < F.col(bound)
    add("irf", "irf_shift", rules.irf_shift)
    add("chisq", "chisq", rules.chi_squared)
    return tests


def filter_export(levels: DataFrame, rules: LevelFilter, null_policy: str = "pass") -> DataFrame:
    """Add a ``failed_*`` column per enabled test and ``is_filtered_out``.

    An unknown value passes a test under ``null_policy="pass"`` and fails it under ``"fail"``.
    """
    unknown = F.lit(null_policy == "fail")
    tests = {name: F.coalesce(test, unknown) for name, test in export_tests(rules).items()}
    failed = reduce(lambda a, b: a | b, tests.values(), F.lit(False))
    return levels.withColumns({**tests, "is_filtered_out": failed})


def count_datapoints(levels: DataFrame, feature: str, rules: LevelFilter) -> DataFrame:
    """Levels where the feature is known, with and without its filter, in one pass."""
    return levels.agg(
        F.count_if(_known(F.col(feature))).alias("unfiltered"), F.count_if(feature_tests(rules)[feature]).alias("filtered")
    )


def feature_pairs(levels: DataFrame, x: str, y: str, all_filter: LevelFilter | None = None) -> DataFrame:
    """Points of a two-feature scatter: both features known, optionally all filters passed."""
    source = levels if all_filter is None else filter_all(levels, all_filter).where(~F.col("is_filtered_out"))
    return source.where(_known(F.col(x)) & _known(F.col(y)))


def regression(points: DataFrame, keys: list[str], x: str, y: str, through_origin: bool = False) -> DataFrame:
    """Ordinary least squares of ``y`` on ``x`` with standard errors.

    Only sums are needed, so the fit is one partial aggregation.  Through the origin R² is the
    uncentred one.
    """
    known = points.where(_known(F.col(x)) & _known(F.col(y)))
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    if through_origin:
        sums = known.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.sum(xs * xs).alias("sxx"), F.sum(xs * ys).alias("sxy"), F.sum(ys * ys).alias("syy")
        )
        slope, freedom = F.try_divide("sxy", "sxx"), F.col("n") - 1
    else:
        sums = known.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"),
            F.regr_sxx(ys, xs).alias("sxx"),
            F.regr_sxy(ys, xs).alias("sxy"),
            F.regr_syy(ys, xs).alias("syy"),
            F.avg(xs).alias("mx"),
            F.avg(ys).alias("my"),
        )
        slope, freedom = F.try_divide("sxy", "sxx"), F.col("n") - 2
    fitted = sums.withColumn("slope", slope).withColumn(
        "_sse", F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    )
    variance = F.try_divide(F.col("_sse"), F.when(freedom > 0, freedom).cast("double"))
    fitted = fitted.withColumn("_var", variance)
    intercept = F.lit(None).cast("double") if through_origin else F.col("my") - F.col("slope") * F.col("mx")
    intercept_err = (
        F.lit(None).cast("double")
        if through_origin
        else F.sqrt(F.col("_var") * (1 / F.col("n") + F.try_divide(F.col("mx") * F.col("mx"), F.col("sxx"))))
    )
    return fitted.select(
        *keys,
        "n",
        "slope",
        F.sqrt(F.try_divide("_var", "sxx")).alias("slope_err"),
        intercept.alias("intercept"),
        intercept_err.alias("intercept_err"),
        (1 - F.try_divide("_sse", "syy")).alias("r2"),
    )


def regression_curve(fit: DataFrame, points: DataFrame, keys: list[str], x: str, steps: int = 100) -> DataFrame:
    """The fitted line at ``steps`` even places from 0 to the largest ``x``."""
    top = points.groupBy(*keys).agg(F.max(x).cast("double").alias("_top"))
    place = F.col("_top") * F.col("step") / F.lit(steps - 1)
    return (
        fit.join(top, keys)
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
        .select(
            *keys,
            "step",
            place.alias("x"),
            (F.coalesce("intercept", F.lit(0.0)) + F.col("slope") * place).alias("y"),
        )
    )


def normalise(levels: DataFrame, slope: Column, intercept: Column, only_drift: bool = False) -> DataFrame:
    """Rescale intensities to what the lifetime predicts, keeping the originals.

    Filtered-out levels and levels without lifetime stay as they are; with ``only_drift`` so do
    levels that are not brighter than predicted.
    """
    predicted = (F.col("av_tau") - intercept) / slope
    applies = ~F.col("is_filtered_out") & F.col("av_tau").isNotNull()
    changes = applies & (predicted < F.col("int_p_s")) if only_drift else applies
    photons = F.bround(predicted * F.col("dwell_s"), 0).cast("bigint")
    return (
        levels.withColumn("unnorm_num_photons", F.col("num_photons"))
        .withColumn("unnorm_int_p_s", F.col("int_p_s"))
        .withColumn("num_photons", F.when(changes, photons).otherwise(F.col("num_photons")))
        .withColumn(
            "int_p_s", F.when(changes, F.try_divide(F.col("num_photons"), F.col("dwell_s"))).otherwise(F.col("int_p_s"))
        )
        .withColumn("is_normalized", applies)
    )


def undo_normalise(levels: DataFrame) -> DataFrame:
    return (
        levels.withColumn("num_photons", F.col("unnorm_num_photons"))
        .withColumn("int_p_s", F.col("unnorm_int_p_s"))
        .withColumn("is_normalized", F.lit(False))
        .drop("unnorm_num_photons", "unnorm_int_p_s")
    )
