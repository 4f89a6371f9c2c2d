"""Photon, spectra and response sources other than time-tag records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CSV_SCHEMA = "macro_ns double, micro_ns double"
TIMESTAMP_UNIT_NS = 0.16461  # fixed value: time unit of the A/B/R timestamp files


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Photons from text files with one header row: macro and micro time in ns."""
    return spark.read.schema(CSV_SCHEMA).option("header", True).csv(path)


def scale_photon_hdf5(raw: DataFrame, timestamp_unit_s: Column, tcspc_unit_s: Column) -> DataFrame:
    """Timestamps and nanotimes of the photon-HDF5 layout, from their units to ns."""
    return raw.select(
        *[c for c in raw.columns if c not in ("timestamp", "nanotime")],
        (F.col("timestamp") * timestamp_unit_s * 1e9).alias("macro_ns"),
        (F.col("nanotime") * tcspc_unit_s * 1e9).alias("micro_ns"),
    )


def scale_mat(raw: DataFrame) -> DataFrame:
    """MATLAB arrays: ``tt1`` in ms and ``kin1`` in 10 ps, to ns."""
    return raw.select(
        *[c for c in raw.columns if c not in ("tt1", "kin1")],
        (F.col("tt1") * 1e6).alias("macro_ns"),
        (F.col("kin1") / 1e2).alias("micro_ns"),
    )


def parse_spectra(lines: DataFrame, exposure_s: float) -> DataFrame:
    """Spectral text ``(particle, wl_ind, line)``: wavelength, then one column per exposure."""
    parts = F.split(F.trim("line"), r"\s+")
    return lines.select(
        "particle",
        "wl_ind",
        F.element_at(parts, 1).cast("double").alias("wavelength_nm"),
        F.posexplode(F.slice(parts, F.lit(2), F.size(parts) - 1)).alias("t_ind", "_v"),
    ).select(
        "particle",
        "wl_ind",
        "wavelength_nm",
        "t_ind",
        ((F.col("t_ind") + 1) * exposure_s).alias("t_s"),
        F.col("_v").cast("double").alias("counts"),
    )


def read_spectra(spark: SparkSession, path: str, exposure_s: float) -> DataFrame:
    """Spectral text files; the wavelength orders the rows of a file."""
    from luxframe.operators.ordered import index_rows

    lines = spark.read.text(path).select(
        F.col("_metadata.file_name").alias("particle"), F.col("value").alias("line")
    ).where(F.length(F.trim("line")) > 0)
    keyed = lines.withColumn("_wl", F.split(F.trim("line"), r"\s+")[0].cast("double"))
    return parse_spectra(index_rows(keyed, ["particle"], ["_wl"], "wl_ind").drop("_wl"), exposure_s)


def raster_rows(images: DataFrame) -> DataFrame:
    """Scan arrays ``(particle, image array<array<double>>, ...)`` as one row per pixel."""
    other = [c for c in images.columns if c != "image"]
    rows = images.select(*other, F.posexplode("image").alias("y", "_row"))
    return rows.select(*other, "y", F.posexplode("_row").alias("x", "counts"))


def timestamp_channels(tables: dict[str, DataFrame], unit_ns: float = TIMESTAMP_UNIT_NS) -> DataFrame:
    """Timestamp tables per channel (A, B, R) as ``(channel, ticks, t_ns)``."""
    parts = [
        table.select(F.lit(name).alias("channel"), F.col(table.columns[0]).cast("bigint").alias("ticks"))
        for name, table in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("t_ns", F.col("ticks") * unit_ns)


def matching_files(names: DataFrame, prefix: str, suffix: str) -> DataFrame:
    """Files with the prefix and extension, with the number that orders them."""
    number = F.regexp_extract("file", r"(\d+)\D*$", 1)
    return names.where(F.col("file").startswith(prefix) & F.col("file").endswith(suffix)).select(
        "file", F.when(number != "", number.cast("bigint")).alias("number")
    )


def unpaired(photon_files: DataFrame, spectra_files: DataFrame) -> DataFrame:
    """Numbers that appear on one side only."""
    left = photon_files.select("number", F.lit("spectra").alias("missing")).join(
        spectra_files.select("number"), "number", "left_anti"
    )
    right = spectra_files.select("number", F.lit("photons").alias("missing")).join(
        photon_files.select("number"), "number", "left_anti"
    )
    return left.unionByName(right)


def read_hdf5(spark: SparkSession, paths: list[str], slice_photons: int = 2_000_000) -> DataFrame:
    """Photons of native measurement files, one task per slice of a particle's arrays.

    Needs the optional ``h5py`` package.  The driver reads only group names and array lengths.
    """
    import h5py

    plan = []
    for path in paths:
        with h5py.File(path, "r") as handle:
            version = str(handle.attrs.get("Version", "1.0"))
            names = sorted(
                (n for n in handle if n.startswith("Particle ")), key=lambda n: int(n.rsplit(" ", 1)[1])
            )
            if len(names) != int(handle.attrs["# Particles"]):
                raise ValueError(f"{path}: particle count does not match")
            for name in names:
                for channel, suffix in ((1, ""), (2, " 2")):
                    if f"Absolute Times{suffix} (ns)" not in handle[name]:
                        continue
                    if channel == 2 and version in SINGLE_CHANNEL_VERSIONS:
                        continue
                    size = handle[name][f"Absolute Times{suffix} (ns)"].shape[0]
                    plan += [(path, name, channel, first, min(slice_photons, size - first)) for first in range(0, size, slice_photons)]
    jobs = spark.createDataFrame(plan, "path string, particle string, channel int, first bigint, size bigint")

    def load(frames):
        import pandas as pd

        for frame in frames:
            for job in frame.itertuples(index=False):
                suffix = "" if job.channel == 1 else " 2"
                with h5py.File(job.path, "r") as handle:
                    group = handle[job.particle]
                    unit = "ns" if f"Micro Times{suffix} (ns)" in group else "s"
                    part = slice(job.first, job.first + job.size)
                    yield pd.DataFrame(
                        {
                            "particle": job.particle,
                            "channel": job.channel,
                            "photon_ind": range(job.first, job.first + job.size),
                            "abs_ns": group[f"Absolute Times{suffix} (ns)"][part].astype("int64"),
                            "micro_ns": group[f"Micro Times{suffix} ({unit})"][part].astype("float64"),
                        }
                    )

    from luxframe.schema import PHOTONS

    return jobs.repartition(max(len(plan), 1)).mapInPandas(load, PHOTONS)


# File versions without a second channel.
SINGLE_CHANNEL_VERSIONS = ("1.0", "1.01", "1.02", "1.03", "1.04", "1.05", "1.06")


def listed_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """``path, length, modificationTime`` of the files below ``folder`` whose names match; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", "modificationTime")
