"""Raster scans and spectral series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from luxframe.operators.ordered import index_rows, neighbours, running_total


def raster_runs(particles: DataFrame, scan: str, pos: str) -> DataFrame:
    """Number the runs of consecutive particles that carry the same scan; ``pos`` may have gaps."""
    ranked = index_rows(particles.withColumn("_file", F.lit(0)), ["_file"], [pos], "_rank")
    seen = neighbours(ranked, ["_file"], "_rank", before={"_before": scan})
    starts = F.when((F.col("_rank") > 0) & F.col("_before").eqNullSafe(F.col(scan)), 0).otherwise(1)
    runs = running_total(seen, ["_file"], "_rank", starts, "raster_ind")
    return runs.withColumn("raster_ind", F.col("raster_ind") - 1).drop("_before", "_file", "_rank")


def scan_hash(pixels: DataFrame) -> DataFrame:
    """Order-free fingerprint of each particle's scan, to compare images without moving them."""
    return pixels.groupBy("particle_ind").agg(F.sum(F.xxhash64("x", "y", "counts").cast("decimal(38,0)")).alias("scan"))


def pixel_axis(index: Column, start: Column, span: Column, pixels: Column) -> Column:
    """Position of a pixel when ``pixels`` of them cover ``[start, start + span]`` evenly."""
    return start + index * span / F.greatest(pixels - 1, F.lit(1))


def spectra_background(spectra: DataFrame, first: int = 1, last: int = 5) -> DataFrame:
    """Subtract the mean of wavelength rows ``first..last-1``, counted from the long end."""
    top = spectra.groupBy("particle").agg(F.max("wl_ind").alias("_top"))
    flipped = spectra.join(top, "particle").withColumn("_row", F.col("_top") - F.col("wl_ind"))
    level = flipped.where(F.col("_row").between(first, last - 1)).groupBy("particle").agg(F.avg("counts").alias("_bg"))
    return flipped.join(level, "particle", "left").select(
        "particle", "t_ind", "wl_ind", (F.col("counts") - F.coalesce("_bg", F.lit(0.0))).alias("counts")
    )


def normalise_image(spectra: DataFrame) -> DataFrame:
    """Scale each image to 0..1."""
    span = spectra.groupBy("particle").agg(F.min("counts").alias("_lo"), F.max("counts").alias("_hi"))
    return spectra.join(span, "particle").select(
        "particle",
        "t_ind",
        "wl_ind",
        F.coalesce(F.try_divide(F.col("counts") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)).alias("counts"),
    )


def spectra_roi_mean(spectra: DataFrame, over: str, t_range: tuple[int, int], wl_range: tuple[int, int]) -> DataFrame:
    """Mean in a rectangle, one value per wavelength (``over="time"``) or per time."""
    kept = "wl_ind" if over == "time" else "t_ind"
    return (
        spectra.where(F.col("t_ind").between(*t_range) & F.col("wl_ind").between(*wl_range))
        .groupBy("particle", kept)
        .agg(F.avg("counts").alias("mean_counts"))
    )


def matrix(cells: DataFrame, row: str, column: str, value: str, columns: list | None = None) -> DataFrame:
    """Wide table with one row per ``row`` and one column per ``column`` value, all that occur unless named."""
    return cells.groupBy(row).pivot(column, columns).agg(F.sum(value))
