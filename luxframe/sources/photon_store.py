"""Photons written once, in order, with their positions.

The table is bucketed and sorted by particle and position block (65 536 photons), so whatever works by position block
(levels, slices, regions) reads it without exchanging or sorting photons: only the other side of a join moves.  A
particle of any size spreads over as many buckets as it has blocks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from luxframe.operators.ordered import index_rows, whole
from luxframe.session import checkpoint_folder, shuffle_width

POSITION_BLOCK = 65_536
_STORES: dict[tuple, str] = {}


def write_store(photons: DataFrame, name: str, order: tuple[str, ...] = ("abs_ns", "photon_id"), buckets: int | None = None) -> DataFrame:
    """Table ``name``: the photons with ``photon_ind`` (dense per particle) and ``block``.

    ``particle`` and ``order`` must identify a photon.  Photons without a particle are a particle of their own.
    """
    spark = photons.sparkSession
    width = buckets or shuffle_width(spark)
    indexed = index_rows(photons, ["particle"], list(order), "photon_ind")
    rows = indexed.withColumn("block", whole(F.col("photon_ind"), POSITION_BLOCK))
    path = f"{checkpoint_folder(spark)}/{name}"
    keys = ["particle", "block"]
    # One exchange by the bucket key leaves one sorted file per bucket.
    rows.repartition(width, *keys).write.bucketBy(width, *keys).sortBy(*keys, "photon_ind").option("path", path).option(
        "compression", "zstd"
    ).saveAsTable(name)
    return spark.table(name)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def opened(photons: DataFrame, source: DataFrame) -> DataFrame:
    """The store of ``photons``, written at first use and opened again as long as the files of ``source`` are the same."""
    spark = photons.sparkSession
    files = source.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    seen = files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*files.columns))).first()
    key = (spark.sparkContext.applicationId, checkpoint_folder(spark), *seen)
    name = _STORES.get(key)
    if name and spark.catalog.tableExists(name) and _exists(spark, f"{checkpoint_folder(spark)}/{name}"):
        return spark.table(name)
    _STORES[key] = f"photons_{uuid.uuid4().hex}"
    return write_store(photons, _STORES[key])
