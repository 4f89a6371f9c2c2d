"""Change points from SQL text: a table function over photons partitioned by particle and chunk.

``SELECT * FROM change_points(TABLE(photon_chunks) PARTITION BY (particle, chunk) ORDER BY (photon_ind))``
"""

from __future__ import annotations

from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from luxframe.config import ChangePointSettings
from luxframe.operators.change_points import CHUNK, ENDED, Chain, settled_runs
from luxframe.session import settle, ship_package

RETURNS = "particle string, cpt_ind bigint, region_lo bigint, region_hi bigint, wlr double"
POINT_COLUMNS = ("cpt_ind", "region_lo", "region_hi", "wlr")


def photon_chunks(photons: DataFrame, settings: ChangePointSettings = ChangePointSettings(), chunk: int = CHUNK) -> DataFrame:
    """The photons of every chunk with where the chain enters it: one row per photon, those behind a border twice.

    ``photons(particle, photon_ind, abs_ns)`` with dense positions.  ``held`` are the points of the chunk before that the
    chunk's first segment may find again.  Photons without a particle have no change points.
    """
    if chunk < 2 * settings.segment:
        raise ValueError("a chunk holds at least two segments")
    chunks, runs = settled_runs(photons, settings, chunk)
    handed = F.filter("points", lambda p: (F.col("exit_start") != ENDED) & (p["cpt_ind"] >= F.col("exit_start")))
    before = runs.select("particle", (F.col("chunk") + 1).alias("chunk"), handed.alias("held"))
    entries = settle(runs.select("particle", "chunk", "entry_start", "entry_seen").join(before, ["particle", "chunk"], "left"))
    return chunks.join(entries, ["particle", "chunk"]).select(
        "particle",
        "chunk",
        "total",
        "entry_start",
        "entry_seen",
        F.coalesce("held", F.expr("CAST(array() AS array<struct<cpt_ind:bigint,region_lo:bigint,region_hi:bigint,wlr:double>>)")).alias("held"),
        F.posexplode("times").alias("place", "abs_ns"),
    ).withColumn("photon_ind", F.col("chunk") * chunk + F.col("place")).drop("place")


def chunk_function(settings: ChangePointSettings, chunk: int):
    """Table function that gives each change point in the chunk behind which no segment can find it again."""
    raw = asdict(settings)

    class ChunkChangePoints:
        def __init__(self):
            self.head, self.times = None, []

        def eval(self, photons: pa.RecordBatch):
            if photons.num_rows:
                named = {name: photons.column(place) for place, name in enumerate(photons.schema.names)}
                if self.head is None:
                    self.head = {name: named[name][0].as_py() for name in ("particle", "chunk", "total", "entry_start", "entry_seen", "held")}
                self.times.append(named["abs_ns"].to_numpy(zero_copy_only=False))
            return iter(())

        def terminate(self):
            if self.head is None:
                return
            head = self.head
            chain = Chain(np.concatenate(self.times), head["chunk"] * chunk, head["total"], ChangePointSettings(**raw))
            leave, _ = chain.run(head["entry_start"], head["entry_seen"], (head["chunk"] + 1) * chunk)
            best = {p["cpt_ind"]: tuple(p[name] for name in POINT_COLUMNS) for p in head["held"]}
            for point in chain.points:
                if point[0] not in best or point[3] > best[point[0]][3]:
                    best[point[0]] = point
            final = [best[at] for at in sorted(best) if leave == ENDED or at < leave]
            columns = list(zip(*final)) or [()] * len(POINT_COLUMNS)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
            found = {name: pa.array(column, kind) for name, column, kind in zip(POINT_COLUMNS, columns, kinds)}
            yield pa.table({"particle": pa.array([head["particle"]] * len(final), pa.string()), **found})

    return F.arrow_udtf(ChunkChangePoints, returnType=RETURNS)


def register(
    spark: SparkSession,
    photons: DataFrame,
    settings: ChangePointSettings = ChangePointSettings(),
    chunk: int = CHUNK,
    view: str = "photon_chunks",
    name: str = "change_points",
) -> None:
    """Make ``photons`` visible as ``view`` and the table function as ``name``; calling again replaces both."""
    ship_package(spark)
    photon_chunks(photons, settings, chunk).createOrReplaceTempView(view)
    spark.udtf.register(name, chunk_function(settings, chunk))
