"""The intensity trace of a measurement that is still being written.

Photon files land in a folder; the trace is the same one ``bin_trace`` gives on the finished
measurement.  Bins are whole nanoseconds, so no precision is lost to microsecond event times; the
watermark only decides when a bin is final.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from luxframe.operators.ordered import whole

PHOTON_FILES = "particle string, channel int, abs_ns bigint, micro_ns double"


def photon_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(PHOTON_FILES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def live_trace(photons: DataFrame, bin_ns: int, late_s: float = 10.0) -> DataFrame:
    """Counts per bin, emitted once photons ``late_s`` seconds later have arrived.

    State is one counter per open bin and particle, whatever the photon rate.
    """
    # The event time is the start of the bin, so the bin and its time are one key.  A bin stays open
    # for its own length and for ``late_s`` more.
    binned = photons.withColumn("bin", whole(F.col("abs_ns"), bin_ns))
    timed = binned.withColumn("opened", F.timestamp_micros(whole(F.col("bin") * bin_ns, 1000)))
    wait_us = -(-bin_ns // 1000) + round(late_s * 1e6)
    return (
        timed.withWatermark("opened", f"{wait_us} microseconds")
        .groupBy("particle", "opened", "bin")
        .agg(F.count(F.lit(1)).alias("counts"))
        .select("particle", "bin", "counts")
    )
