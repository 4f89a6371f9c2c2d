"""A whole analysis saved as one: either all of its tables or none.

Every save writes its tables into a folder of its own and counts and hashes their rows in the same pass.  A manifest with
these figures and the sizes of the files is renamed into place last, under the next number; loading takes the highest
number and compares the files with it.  What a broken save leaves behind is never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from luxframe.schema import VERSION

MANIFEST = "manifest-"


def _figures(table: DataFrame) -> list:
    """Rows, and a sum of row hashes that does not depend on their order and counts repeated rows as often as they come."""
    hashed = F.xxhash64(*[F.col(f"`{name}`") for name in table.columns]).cast("decimal(38,0)")
    return [F.count(F.lit(1)).alias("rows"), F.sum(hashed).cast("string").alias("hash")]


class _Files:
    """The file system of a folder, as Spark resolves it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.paths = spark, spark._jvm.org.apache.hadoop.fs.Path
        self.system = self.paths(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def sizes(self, folder: str) -> dict[str, int]:
        place = self.paths(folder)
        if not self.system.exists(place):
            return {}
        return {s.getPath().getName(): s.getLen() for s in self.system.listStatus(place) if s.isFile() and s.getPath().getName()[0] not in "_."}

    def read(self, path: str) -> str:
        stream = self.system.open(self.paths(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> None:
        """Written beside its place and renamed into it; an existing file is not replaced."""
        draft = self.paths(f"{path}.{uuid.uuid4().hex}.draft")
        stream = self.system.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        target = self.paths(path)
        if self.system.exists(target) or not self.system.rename(draft, target):
            self.system.delete(draft, False)
            raise RuntimeError(f"{path} was saved by someone else meanwhile")


def _numbers(files: _Files, folder: str) -> list[int]:
    names = [name.removesuffix(".json") for name in files.sizes(folder) if name.startswith(MANIFEST) and name.endswith(".json")]
    return sorted(int(name.removeprefix(MANIFEST)) for name in names)


def save_snapshot(tables: dict[str, DataFrame], folder: str) -> int:
    """Save ``tables`` together; gives the number of the snapshot.  Columns of map type are refused by the hash."""
    spark = next(iter(tables.values())).sparkSession
    files = _Files(spark, folder)
    number = max(_numbers(files, folder), default=0) + 1
    place = f"tables-{uuid.uuid4().hex}"
    kept = {}
    for name, table in tables.items():
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        table.observe(seen, *_figures(table)).write.option("compression", "zstd").parquet(f"{folder}/{place}/{name}")
        figures = seen.get  # none where the planner knows that there are no rows
        sizes = files.sizes(f"{folder}/{place}/{name}")
        kept[name] = {
            "rows": figures.get("rows", 0),
            "hash": figures.get("hash"),
            "files": len(sizes),
            "bytes": sum(sizes.values()),
            "schema": table.schema.jsonValue(),
        }
    files.publish(f"{folder}/{MANIFEST}{number:08d}.json", json.dumps({"version": VERSION, "place": place, "tables": kept}))
    return number


def _manifest(spark: SparkSession, folder: str, number: int | None) -> dict:
    files = _Files(spark, folder)
    known = _numbers(files, folder)
    if not known or (number is not None and number not in known):
        raise FileNotFoundError(f"no finished snapshot {'' if number is None else number} in {folder}")
    return json.loads(files.read(f"{folder}/{MANIFEST}{number or known[-1]:08d}.json"))


def load_snapshot(spark: SparkSession, folder: str, number: int | None = None) -> dict[str, DataFrame]:
    """The tables of the newest finished snapshot, or of a given one; missing, added or cut files are refused without reading rows."""
    manifest, files = _manifest(spark, folder, number), _Files(spark, folder)
    loaded = {}
    for name, kept in manifest["tables"].items():
        path = f"{folder}/{manifest['place']}/{name}"
        sizes = files.sizes(path)
        if (len(sizes), sum(sizes.values())) != (kept["files"], kept["bytes"]):
            raise ValueError(f"table {name} in {folder} is not as it was saved")
        loaded[name] = spark.read.schema(StructType.fromJson(kept["schema"])).parquet(path)
    return loaded


def verified(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    """``saved, n, verified``: every table read once, its rows counted and hashed again."""
    manifest = _manifest(spark, folder, number)
    parts = []
    for name, table in load_snapshot(spark, folder, number).items():
        kept = manifest["tables"][name]
        same = (F.col("rows") == kept["rows"]) & F.col("hash").eqNullSafe(F.lit(kept["hash"]))
        parts.append(table.agg(*_figures(table)).select(F.lit(name).alias("saved"), F.col("rows").alias("n"), same.alias("verified")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
