"""Change points of the photon rate.

One segment is at most 1000 photons and each next one depends on what the previous one held, so a
particle is in principle a single chain.  The chain only carries where the next segment starts.
``find_change_points`` therefore cuts a particle into chunks of photons, lets every chunk follow the
chain from an assumed start, and repeats only the chunks whose assumed start turns out wrong.  The
result is the one of the unbroken chain, and no task ever holds more than a chunk.
"""

from __future__ import annotations

from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from luxframe.config import ChangePointSettings
from luxframe.functions.critical_values import accept_value, region_value
from luxframe.functions.wlr import series
from luxframe.operators.ordered import whole
from luxframe.session import settle, shuffle_width

CHUNK = 200_000
ENDED = -1
RUN_SCHEMA = (
    "particle string, chunk bigint, entry_start bigint, entry_seen boolean, exit_start bigint, "
    "snapped boolean, points array<struct<cpt_ind:bigint,region_lo:bigint,region_hi:bigint,wlr:double>>"
)


def best_point(times: np.ndarray, settings: ChangePointSettings) -> tuple[int, int, int, float] | None:
    """Accepted change point of one segment with its confidence region, as offsets."""
    n = len(times)
    if n < settings.min_photons:
        return None
    ratio = series(times)
    peak = int(ratio.argmax())
    if min(peak, n - peak) < settings.edge_offset or ratio[peak] < accept_value(n, settings.confidence):
        return None
    inside = np.flatnonzero(ratio >= ratio[peak] - region_value(n, settings.confidence))
    return peak, int(inside[0]), int(inside[-1]), float(ratio[peak])


class Chain:
    """Follows the segments through the photons ``[base, base + len(times))`` of one particle."""

    def __init__(self, times: np.ndarray, base: int, total: int, settings: ChangePointSettings):
        self.times, self.base, self.settings = times, base, settings
        self.last = total - 1
        self.total = total
        self.points: list[tuple[int, int, int, float]] = []

    def search(self, start: int, end: int) -> list[int]:
        """Points of one segment, in the order found: a point, then all left of it, then all right."""
        found, waiting = [], [(start, end)]
        while waiting:
            low, high = waiting.pop()
            hit = best_point(self.times[low - self.base : high - self.base], self.settings)
            if hit is None:
                continue
            at = low + hit[0]
            self.points.append((at, low + hit[1], low + hit[2], hit[3]))
            found.append(at)
            waiting += [(at, high), (low, at - 1)]
        return found

    def first_segment(self) -> tuple[int, int] | None:
        if self.total < self.settings.min_trace:
            return None
        return (0, self.settings.segment) if self.total > self.settings.segment else (0, self.last)

    def following(self, end: int, found: list[int], seen: bool) -> tuple[int, int] | None:
        s = self.settings
        step = s.segment - s.overlap
        fresh = bool(found) and end - s.overlap < found[-1] < end
        if self.last >= end + step:
            start = found[-1] if fresh else end - s.overlap
            return start, min(start + s.segment, self.last) if fresh else end + step
        if self.last - end >= (10 if seen else s.min_photons):
            return (max(found) if fresh else end - s.overlap), self.last
        return None

    def run(self, start: int, seen: bool, stop: int) -> tuple[int, bool]:
        """Follow the chain from a segment start until one starts at or past ``stop``.

        Returns the next start (``ENDED`` after the last segment) and whether a point has moved the
        chain off its regular steps.
        """
        if start == ENDED:
            return ENDED, False
        segment = self.first_segment() if start == 0 else (start, min(start + self.settings.segment, self.last))
        snapped = False
        while segment is not None:
            if segment[0] >= stop:
                return segment[0], snapped
            found = self.search(*segment)
            seen = seen or bool(found)
            nxt = self.following(segment[1], found, seen)
            if nxt is not None and nxt[0] != segment[1] - self.settings.overlap:
                snapped = True
            segment = nxt
        return ENDED, snapped


def chunked(photons: DataFrame, totals: DataFrame, settings: ChangePointSettings, chunk: int) -> DataFrame:
    """One row per chunk: its arrival times plus the photons a segment may reach beyond it."""
    own = whole(F.col("photon_ind"), chunk)
    spill = F.when((F.col("photon_ind") - own * chunk <= settings.segment) & (own > 0), own - 1)
    placed = photons.withColumn("chunk", F.explode(F.filter(F.array(own, spill), lambda c: c.isNotNull())))
    # Few bytes but much work per chunk: the partitions are fixed here and not merged by size.
    spread = placed.repartition(shuffle_width(photons.sparkSession), "particle", "chunk")
    packed = spread.groupBy("particle", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("photon_ind", "abs_ns"))).alias("_p")
    )
    return packed.join(totals, "particle").select(
        "particle", "chunk", F.col("num_photons").alias("total"), F.col("_p.abs_ns").alias("times")
    )


def _runner(settings: ChangePointSettings, chunk: int):
    raw = asdict(settings)

    def follow(frames):
        rules = ChangePointSettings(**raw)
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                chain = Chain(np.asarray(row.times, dtype=np.int64), row.chunk * chunk, row.total, rules)
                leave, snapped = chain.run(row.entry_start, row.entry_seen, (row.chunk + 1) * chunk)
                points = [dict(zip(("cpt_ind", "region_lo", "region_hi", "wlr"), p)) for p in chain.points]
                rows.append((row.particle, row.chunk, row.entry_start, row.entry_seen, leave, snapped, points))
            columns = ["particle", "chunk", "entry_start", "entry_seen", "exit_start", "snapped", "points"]
            yield pd.DataFrame(rows, columns=columns)

    return follow


def find_change_points(
    photons: DataFrame, settings: ChangePointSettings = ChangePointSettings(), chunk: int = CHUNK
) -> DataFrame:
    """All change points with confidence regions.

    ``photons(particle, photon_ind, abs_ns)``.  A round only reads chunks whose start changed; the
    first wrong chunk of a particle is always right after its round, so the rounds end.
    """
    found = settled_runs(photons, settings, chunk)[1].select("particle", F.explode("points").alias("p"))
    return (
        found.select("particle", "p.*")
        .groupBy("particle", "cpt_ind")
        .agg(F.max_by(F.struct("region_lo", "region_hi", "wlr"), "wlr").alias("p"))
        .select("particle", "cpt_ind", "p.*")
    )


def settled_runs(photons: DataFrame, settings: ChangePointSettings, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Chunks with their photons, and the run of every chunk from the start its predecessors lead to."""
    photons = photons.select("particle", "photon_ind", "abs_ns")
    totals = photons.groupBy("particle").agg(F.count(F.lit(1)).alias("num_photons"))
    chunks = settle(chunked(photons, totals, settings, chunk))
    step = settings.segment - settings.overlap
    regular = F.ceil(F.col("chunk") * chunk / F.lit(step)).cast("bigint") * step
    todo = chunks.withColumn("entry_start", regular).withColumn("entry_seen", F.lit(False))
    runs = settle(todo.mapInPandas(_runner(settings, chunk), RUN_SCHEMA))
    sizes = chunks.select("particle", "chunk", "total")
    while True:
        wrong = settle(_wrong_entries(runs, sizes, step, chunk))
        if wrong.isEmpty():
            return chunks, runs
        again = chunks.join(wrong, ["particle", "chunk"]).mapInPandas(_runner(settings, chunk), RUN_SCHEMA)
        runs = settle(runs.join(wrong.select("particle", "chunk"), ["particle", "chunk"], "left_anti").unionByName(again))


def _wrong_entries(runs: DataFrame, sizes: DataFrame, step: int, chunk: int) -> DataFrame:
    """Chunks that ran from another start than the one their predecessors lead to.

    A chunk whose run kept the regular steps hands its own start phase on, so a shift travels
    through any number of quiet chunks in one round.
    """
    order = W.partitionBy("particle").orderBy("chunk")  # one row per chunk of photons
    before = order.rowsBetween(W.unboundedPreceding, -1)
    decides = (F.col("chunk") == 0) | F.col("snapped") | (F.col("exit_start") == ENDED)
    led = (
        runs.withColumn("_found", F.size("points") > 0)
        .drop("points")
        .join(sizes, ["particle", "chunk"])
        .withColumn("_from", F.last(F.when(decides, F.col("exit_start")), ignorenulls=True).over(before))
        .withColumn("_seen", F.coalesce(F.max("_found").over(before), F.lit(False)))
    )
    ahead = F.greatest(F.col("chunk") * chunk - F.col("_from"), F.lit(0))
    due = (
        F.when(F.col("chunk") == 0, F.lit(0))
        .when(F.col("_from") == ENDED, F.lit(ENDED))
        .otherwise(F.col("_from") + F.ceil(ahead / F.lit(step)).cast("bigint") * step)
    )
    final = F.col("total") <= (F.col("chunk") + 1) * chunk + 2 * step
    wrong = (due != F.col("entry_start")) | (final & (F.col("_seen") != F.col("entry_seen")))
    return led.withColumn("_due", due).where(wrong).select(
        "particle", "chunk", F.col("_due").alias("entry_start"), F.col("_seen").alias("entry_seen")
    )


def segment_sums(photons: DataFrame, segment: int = 1000, min_photons: int = 20) -> DataFrame:
    """Place ``k`` of each photon in consecutive fixed segments, with the harmonic sums it needs.

    ``u``: expectation and ``v2``: variance terms of both sides, ``sig_e`` their covariance.  The
    sums come from a table of one row per place in a segment, whatever the number of photons.
    """
    part = whole(F.col("photon_ind"), segment)
    inside = W.partitionBy("particle", "segment")  # at most `segment` rows
    k, n = F.col("k"), F.col("n")
    placed = (
        photons.withColumn("segment", part)
        .withColumn("k", F.col("photon_ind") - F.col("segment") * segment)
        .withColumn("n", F.count(F.lit(1)).over(inside))
        .withColumn("t0", F.min("abs_ns").over(inside))
        .withColumn("t1", F.max("abs_ns").over(inside))
        .where((n >= min_photons) & k.between(2, n - 2))
    )
    sums = harmonic_sums(photons.sparkSession, segment)
    for key, suffix in ((n - 1, "_n"), (k - 1, "_k"), (n - k - 1, "_r")):
        lookup = sums.select(*[F.col(c).alias(c + suffix) for c in ("j", "h1", "h2")])
        placed = placed.join(F.broadcast(lookup), key == F.col("j" + suffix)).drop("j" + suffix)
    return placed.select(
        "particle",
        "segment",
        "photon_ind",
        "abs_ns",
        "k",
        "n",
        "t0",
        "t1",
        (F.col("h1_k") - F.col("h1_n")).alias("u_k"),
        (F.col("h1_r") - F.col("h1_n")).alias("u_nk"),
        (F.col("h2_n") - F.col("h2_k")).alias("v2_k"),
        (F.col("h2_n") - F.col("h2_r")).alias("v2_nk"),
        (F.lit(np.pi**2 / 6) - F.col("h2_n")).alias("sig_e"),
    )


def segment_series(photons: DataFrame, segment: int = 1000, min_photons: int = 20) -> DataFrame:
    """The likelihood ratio of every photon in consecutive fixed segments, in Spark expressions."""
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    share = (F.col("abs_ns") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    raw = -2 * k * F.ln(share) - 2 * (n - k) * F.ln(1 - share) + 2 * k * F.col("u_k") + 2 * (n - k) * F.col("u_nk")
    deviation = F.sqrt(
        4 * k * k * F.col("v2_k") + 4 * (n - k) * (n - k) * F.col("v2_nk") - 8 * k * (n - k) * F.col("sig_e")
    )
    weight = 0.5 * F.ln(4 * k * (n - k) / (n * n))
    return segment_sums(photons, segment, min_photons).select(
        "particle", "segment", "k", (raw / deviation + weight).alias("wlr")
    )


def harmonic_sums(spark, top: int = 1000) -> DataFrame:
    """Running sums of 1/j and 1/j² for j = 1..top."""
    order = W.orderBy("j").rowsBetween(W.unboundedPreceding, 0)  # a table of `top` rows
    j = F.col("j").cast("double")
    return spark.range(1, top + 1).withColumnRenamed("id", "j").select(
        "j", F.sum(1 / j).over(order).alias("h1"), F.sum(1 / (j * j)).over(order).alias("h2")
    )


def until(photons: DataFrame, end_time_s: float) -> DataFrame:
    """Photons before the first one later than ``end_time_s``; all of them if there is none."""
    return photons.where(F.col("abs_ns") <= F.lit(end_time_s) * 1e9)
