"""Time-tag records of T3 measurements (.pt3): splittable reading and decoding."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from luxframe.operators.ordered import running_total

RECORDS = "file string, record bigint, word bigint, resolution_ns double, sync_rate bigint"
RECORDS_PER_SPLIT = 4_000_000
OVERFLOW = 65_536

# Byte offsets in the .pt3 header (all fields little-endian, four bytes each).
ROUTING_CHANNELS_AT = 336
RESOLUTION_AT = 584
ROUTERS_AT = 596
ROUTER_BYTES = 24
AFTER_ROUTERS = {"sync_rate": 12, "records": 28, "image_words": 32, "end": 36}


def _open(path: str):
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return open(path, "rb")


def _list(path: str) -> list[str]:
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        info = system.get_file_info(inner)
        if info.type != fs.FileType.Directory:
            return [path]
        scheme = path.split("://")[0]
        found = system.get_file_info(fs.FileSelector(inner, recursive=True))
        return sorted(f"{scheme}://{f.path}" for f in found if f.path.endswith(".pt3"))
    import glob
    import os

    return sorted(glob.glob(os.path.join(path, "**", "*.pt3"), recursive=True)) if os.path.isdir(path) else [path]


def read_header(path: str) -> dict:
    with _open(path) as source:
        head = source.read(4096)
    number = lambda at, kind="<i": struct.unpack_from(kind, head, at)[0]
    base = ROUTERS_AT + ROUTER_BYTES * number(ROUTING_CHANNELS_AT)
    return {
        "resolution_ns": float(number(RESOLUTION_AT, "<f")),
        "sync_rate": number(base + AFTER_ROUTERS["sync_rate"]),
        "records": number(base + AFTER_ROUTERS["records"], "<I"),
        "data_at": base + AFTER_ROUTERS["end"] + 4 * number(base + AFTER_ROUTERS["image_words"]),
    }


class Span(InputPartition):
    def __init__(self, path: str, first: int, count: int, header: dict):
        self.path, self.first, self.count, self.header = path, first, count, header


class RecordReader(DataSourceReader):
    def __init__(self, path: str, per_split: int):
        self.path, self.per_split = path, per_split

    def partitions(self):
        spans = []
        for path in _list(self.path):
            header = read_header(path)
            for first in range(0, header["records"], self.per_split):
                spans.append(Span(path, first, min(self.per_split, header["records"] - first), header))
        return spans

    def read(self, partition):
        import numpy as np
        import pyarrow as pa

        step = 100_000
        with _open(partition.path) as source:
            source.seek(partition.header["data_at"] + 4 * partition.first)
            for done in range(0, partition.count, step):
                words = np.frombuffer(source.read(4 * min(step, partition.count - done)), dtype="<u4")
                size = len(words)
                first = partition.first + done
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([partition.path] * size),
                        pa.array(np.arange(first, first + size, dtype=np.int64)),
                        pa.array(words.astype(np.int64)),
                        pa.array(np.full(size, partition.header["resolution_ns"])),
                        pa.array(np.full(size, partition.header["sync_rate"], dtype=np.int64)),
                    ],
                    names=["file", "record", "word", "resolution_ns", "sync_rate"],
                )


class Pt3Source(DataSource):
    """``spark.read.format("pt3").load(path)``: raw records, split by byte ranges."""

    @classmethod
    def name(cls):
        return "pt3"

    def schema(self):
        return RECORDS

    def reader(self, schema):
        return RecordReader(self.options["path"], int(self.options.get("records_per_split", RECORDS_PER_SPLIT)))


def read_pt3(spark: SparkSession, path: str, records_per_split: int = RECORDS_PER_SPLIT) -> DataFrame:
    """Photons ``(file, channel, photon_ind, macro_ns, micro_ns)`` of .pt3 files."""
    spark.dataSource.register(Pt3Source)
    raw = spark.read.format("pt3").option("records_per_split", records_per_split).load(path)
    return decode_t3(raw)


def decode_t3(records: DataFrame, block: int = 1_000_000) -> DataFrame:
    """Decode 32-bit T3 words: 4 bits channel, 12 bits micro time, 16 bits laser pulse number.

    Channel 15 with marker 0 says that the pulse number wrapped around; the wraps before a record
    are a running total over its position in the file.
    """
    word = F.col("word")
    channel = F.shiftrightunsigned(word, 28).bitwiseAND(F.lit(15))
    middle = F.shiftrightunsigned(word, 16)
    wraps = F.when((channel == 15) & (middle.bitwiseAND(F.lit(15)) == 0), F.lit(OVERFLOW)).otherwise(0)
    counted = running_total(records, ["file"], "record", wraps.cast("bigint"), "_wrapped", block)
    micro = middle.bitwiseAND(F.lit(4095)) * F.col("resolution_ns")
    pulse = F.col("_wrapped") + word.bitwiseAND(F.lit(65_535))
    return counted.where(channel != 15).select(
        "file",
        "record",
        channel.cast("int").alias("channel"),
        (pulse * (F.lit(1e9) / F.col("sync_rate")) + micro).alias("macro_ns"),
        micro.alias("micro_ns"),
    )
