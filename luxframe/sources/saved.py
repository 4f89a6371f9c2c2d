"""A saved analysis: one Parquet table per result kind, with the version it was written in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from luxframe.schema import VERSION

CURRENT = VERSION


def save_analysis(tables: dict[str, DataFrame], folder: str, version: str = CURRENT) -> None:
    for name, table in tables.items():
        table.withColumn("saved_version", F.lit(version)).write.mode("overwrite").parquet(f"{folder}/{name}")


def load_analysis(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: migrate(spark.read.parquet(f"{folder}/{name}")) for name in names}


def migrate(table: DataFrame) -> DataFrame:
    """Bring an older table up to date: versions before 1.07 knew one channel and no normalisation."""
    older = F.col("saved_version") < "1.07"
    if "channel" not in table.columns:
        table = table.withColumn("channel", F.when(older, F.lit(1)).cast("int"))
    if "is_normalized" not in table.columns and "int_p_s" in table.columns:
        table = table.withColumn("is_normalized", F.lit(False))
    return table.withColumn("saved_version", F.lit(CURRENT))
