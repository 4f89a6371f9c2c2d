"""Bursts of photons in a measurement that is still being written.

A run is a stretch of photons, each closer to the one before than ``gap_ns``.  State is one open session per particle, and
a run is given out once no later photon can join it.  Event times are whole microseconds, as are the gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from luxframe.operators.ordered import whole


def photon_runs(photons: DataFrame, gap_us: int, late_s: float = 10.0) -> DataFrame:
    """``particle, start_ns, end_ns, num_photons`` of every run; works on streams and on finished tables alike."""
    timed = photons.withColumn("seen", F.timestamp_micros(whole(F.col("abs_ns"), 1000)))
    return (
        timed.withWatermark("seen", f"{round(late_s * 1e6)} microseconds")
        .groupBy("particle", F.session_window("seen", f"{gap_us} microseconds"))
        .agg(F.min("abs_ns").alias("start_ns"), F.max("abs_ns").alias("end_ns"), F.count(F.lit(1)).alias("num_photons"))
        .select("particle", "start_ns", "end_ns", "num_photons")
    )


def bursts(runs: DataFrame, least_photons: int, longest_ns: int) -> DataFrame:
    """Runs of at least so many photons that are no longer than the minimum dwell time."""
    return runs.where((F.col("num_photons") >= least_photons) & (F.col("end_ns") - F.col("start_ns") < longest_ns))


def replayed(spark: SparkSession, rows: DataFrame, target: str, state: str) -> DataFrame:
    """Everything a stream has to say about the files there are now: run until they are used up, then read the result."""
    running = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", state)
    running.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(target)
