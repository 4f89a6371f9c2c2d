"""Correlation histograms from differences of ranks instead of pairs.

The number of second-channel photons in ``[t + a, t + b)`` is the rank of ``t + b`` among their times minus the rank of
``t + a``.  So a first-channel photon needs one probe per bin edge, however many photons its window holds; no pair is
formed and no delay is stored.

Both channels are range-partitioned and sorted together, so partitions are even and a crowded window is cut at partition
borders like any other stretch of time.  A probe that falls inside its photon's own partition is ranked there by a binary
search.  Only probes beyond a border become rows; they are sorted among the second channel's times and ranked in a second
pass.  Ranks inside a partition are completed by a summary of one row per partition, particle and edge.

Where a window holds fewer photons than there are edges, its pairs are fewer than its probes; those first-channel
photons are paired directly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from luxframe.operators.binning import EDGE
from luxframe.operators.ordered import whole
from luxframe.session import settle, shuffle_width

PROBES = 1 << 20  # ranked in one step
RANKS = "part int, particle string, edge int, ranks decimal(38,0), probes decimal(38,0), photons long, at long"
KINDS = [pa.int32(), pa.string(), pa.int32(), pa.decimal128(38, 0), pa.decimal128(38, 0), pa.int64(), pa.int64()]
EXTENT = "part int, particle string, lo long, hi long, later long, earlier long, head long, tail long"


def least_delays(lo: np.ndarray, hi: np.ndarray, bins: int) -> np.ndarray:
    """Smallest whole delay of each bin, and the one behind the last bin: ``len(lo) x (bins + 1)``.

    A delay ``d`` lies in bin ``floor((d - lo) / width + EDGE)``, which never falls as ``d`` grows, so the smallest
    delay of a bin is found by halving, with the same floating-point steps.
    """
    lo, hi = np.asarray(lo, np.float64)[:, None], np.asarray(hi, np.float64)[:, None]
    width = (hi - lo) / float(bins)
    wanted = np.arange(1, bins)[None, :]
    below = np.repeat(np.floor(lo).astype(np.int64) - 1, bins - 1, axis=1)
    above = np.repeat(np.ceil(hi).astype(np.int64) + 1, bins - 1, axis=1)
    while (above - below > 1).any():
        middle = below + (above - below) // 2
        inside = np.floor((middle.astype(np.float64) - lo) / width + EDGE) >= wanted
        above, below = np.where(inside, middle, above), np.where(inside, below, middle)
    ends = np.ceil(lo).astype(np.int64), np.floor(hi).astype(np.int64) + 1
    return np.concatenate([ends[0], above, ends[1]], axis=1)


def _runs(particles: pa.Array) -> Iterator[tuple[str | None, slice]]:
    """Stretches of equal particles in a sorted column."""
    codes = particles.dictionary_encode()
    numbers = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    starts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
    for at, end in zip(starts, starts[1:], strict=False):
        if at < end:
            yield particles[at].as_py(), slice(at, end)


def _in_order(second: DataFrame, probes: DataFrame) -> DataFrame:
    """Second-channel times and probes by time; at equal times the probe comes first, so ranks count earlier photons."""
    times = second.select(
        "particle", F.col("t_ps").alias("at"), F.lit(True).alias("second"), F.lit(-1).alias("edge"), "w", F.lit(0).cast("bigint").alias("origin")
    )
    rows = times.unionByName(probes.select("particle", "at", F.lit(False).alias("second"), "edge", "w", "origin"))
    keys = ["particle", "at", "second", "origin"]
    return rows.repartitionByRange(shuffle_width(rows.sparkSession), *keys).sortWithinPartitions(*keys)


def _probes(first: DataFrame, edges: Column) -> DataFrame:
    """One row per photon of the first channel and place in ``edges``."""
    return first.select("particle", F.col("t_ps").alias("origin"), "w", F.posexplode(edges).alias("edge", "delay")).withColumn(
        "at", F.col("origin") + F.col("delay")
    )


def _rank_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(KINDS)
    names = [part.split()[0] for part in RANKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, KINDS, strict=True)], names=names)


def _local_ranks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per particle and edge of one sorted partition of probes: ranks times weights, and the weights alone."""
    part = TaskContext.get().partitionId()
    current, started, seen = None, False, 0
    sums: dict[int, list[int]] = {}

    def out() -> pa.RecordBatch:
        rows = [(part, current, edge, s, p, 0, None) for edge, (s, p) in sorted(sums.items())]
        return _rank_rows([*rows, (part, current, -1, 0, 0, seen, None)])

    for batch in batches:
        second = batch.column("second").to_numpy(zero_copy_only=False)
        weight = batch.column("w").to_numpy()
        edge = batch.column("edge").to_numpy()
        for particle, rows in _runs(batch.column("particle")):
            if started and particle != current:
                yield out()
                sums, seen = {}, 0
            current, started = particle, True
            counted = seen + np.cumsum(np.where(second[rows], weight[rows], 0))
            probe = ~second[rows]
            size = int(edge[rows].max()) + 1
            for values, place in ((counted * weight[rows], 0), (weight[rows], 1)):
                total = np.zeros(size, np.int64)
                np.add.at(total, edge[rows][probe], values[probe])
                for k in np.flatnonzero(total).tolist():
                    sums.setdefault(k, [0, 0])[place] += int(total[k])
            seen = int(counted[-1])
    if started:
        yield out()


def _own_ranks(bins: int):
    """Ranks of the probes that fall inside their photon's partition; the others come out as rows with their place.

    A partition holds every time of a particle between its first and last row, so it can rank places behind the first and
    up to the last.  It is read whole: a few numbers for each of its rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        at, weight, lo, hi = (table.column(name).combine_chunks().to_numpy(zero_copy_only=False) for name in ("at", "w", "lo", "hi"))
        second = table.column("second").combine_chunks().to_numpy(zero_copy_only=False)
        for particle, rows in _runs(table.column("particle").combine_chunks()):
            times, counted = at[rows][second[rows]], np.concatenate([[0], np.cumsum(weight[rows][second[rows]])])
            origin, w = at[rows][~second[rows]], weight[rows][~second[rows]]
            yield _rank_rows([(part, particle, -1, 0, 0, int(counted[-1]), None)])
            if not len(origin):
                continue
            edges = least_delays(lo[rows][~second[rows]][:1], hi[rows][~second[rows]][:1], bins)[0]
            first, last = int(at[rows][0]), int(at[rows][-1])
            ranks, probes = [0] * len(edges), [0] * len(edges)
            step = max(1, PROBES // len(edges))
            for start in range(0, len(origin), step):
                places = origin[start : start + step, None] + edges[None, :]
                heavy = np.broadcast_to(w[start : start + step, None], places.shape)
                inside = (places > first) & (places <= last)
                found = np.where(inside, counted[np.searchsorted(times, places)] * heavy, 0).sum(0)
                number = np.where(inside, heavy, 0).sum(0)
                ranks = [a + b for a, b in zip(ranks, found.tolist(), strict=True)]
                probes = [a + b for a, b in zip(probes, number.tolist(), strict=True)]
                i, k = np.nonzero(~inside)
                if len(i):
                    zero, owner = [0] * len(i), [particle] * len(i)
                    columns = [[part] * len(i), owner, k, zero, zero, heavy[i, k], places[i, k]]
                    names = [column.split()[0] for column in RANKS.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS, strict=True)], names=names)
            yield _rank_rows([(part, particle, k, s, p, 0, None) for k, (s, p) in enumerate(zip(ranks, probes, strict=True)) if p])

    return run


def _completed(local: DataFrame) -> DataFrame:
    """``particle, edge, rank``: local ranks plus the photons of earlier partitions, added up."""
    earlier = W.partitionBy("particle").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = local.where("edge < 0").select(
        F.col("particle").alias("_owner"),
        F.col("part").alias("_part"),
        F.coalesce(F.sum("photons").over(earlier), F.lit(0)).cast("decimal(20,0)").alias("before"),
    )
    same = F.col("particle").eqNullSafe(F.col("_owner")) & (F.col("part") == F.col("_part"))
    total = F.sum(F.col("ranks") + (F.col("probes").cast("decimal(18,0)") * F.col("before")).cast("decimal(38,0)"))
    known = local.where("edge >= 0 AND at IS NULL").join(before, same)
    return known.groupBy("particle", "edge").agg(total.alias("rank"))


def rank_counts(first: DataFrame, second: DataFrame, bins: int) -> DataFrame:
    """``particle, bin, counts`` of the pairs whose delay lies in each bin, without forming them.

    Both sides are distinct times ``particle, t_ps`` with multiplicity ``w``; ``first`` has the bounds ``lo, hi``
    (double) of its particle's histogram.  Bins without pairs have no row.
    """
    keys = ["particle", "at", "second"]
    ones = first.select("particle", F.col("t_ps").alias("at"), F.lit(False).alias("second"), "w", "lo", "hi")
    nowhere = F.lit(None).cast("double")
    twos = second.select("particle", F.col("t_ps").alias("at"), F.lit(True).alias("second"), "w", nowhere.alias("lo"), nowhere.alias("hi"))
    rows = ones.unionByName(twos)
    ordered = rows.repartitionByRange(shuffle_width(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    own = settle(ordered.mapInArrow(_own_ranks(bins), RANKS))
    left = own.where("at IS NOT NULL").select("particle", "at", "edge", F.col("photons").alias("w"), F.col("at").alias("origin"))
    beyond = settle(_in_order(second, left).mapInArrow(_local_ranks, RANKS))
    ranks = _completed(own).unionByName(_completed(beyond)).groupBy("particle", "edge").agg(F.sum("rank").alias("rank"))
    following = F.lead("rank").over(W.partitionBy("particle").orderBy("edge"))
    counted = ranks.select("particle", F.col("edge").cast("bigint").alias("bin"), (following - F.col("rank")).cast("bigint").alias("counts"))
    return counted.where("counts > 0")


def _neighbourhood(first: DataFrame, second: DataFrame, window_ps: int) -> DataFrame:
    """First-channel photons with partners in reach, and ``_near``, the times in their and both neighbouring buckets."""
    spot = whole(F.col("t_ps"), window_ps)
    filled = second.groupBy("particle", spot.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    reach = F.explode(F.array(F.col("_bucket") - 1, F.col("_bucket"), F.col("_bucket") + 1))
    near = filled.select("particle", reach.alias("_bucket"), "_n").groupBy("particle", "_bucket").agg(F.sum("_n").alias("_near"))
    return first.withColumn("_bucket", spot).join(near, ["particle", "_bucket"]).drop("_bucket")


def binned_pairs(
    first: DataFrame, second: DataFrame, window_ps: int, bins: int, pairs: Callable[[DataFrame, DataFrame], DataFrame], spot: Column
) -> DataFrame:
    """``particle, bin, counts`` by pairs where windows are sparse and by ranks where they are crowded.

    ``first`` has the bounds ``lo, hi`` of its particle.  ``pairs`` joins two sides within the window (``particle, dt_ps, _w1, _w2`` and further columns of the first);
    ``spot`` is the bin of ``dt_ps``.
    """
    known = settle(_neighbourhood(first, second, window_ps))
    crowded = F.col("_near") > bins + 1
    few = pairs(known.where(~crowded), second)
    by_pairs = few.groupBy("particle", spot.cast("bigint").alias("bin")).agg(F.sum(F.col("_w1") * F.col("_w2")).alias("counts"))
    by_ranks = rank_counts(known.where(crowded), second, bins)
    both = by_pairs.unionByName(by_ranks)
    return both.groupBy("particle", "bin").agg(F.sum("counts").alias("counts"))


def _local_extent(window_ps: int):
    """Smallest and largest delay inside the window in one sorted partition, and what border photons still need.

    Edge 0 probes look for the next photon at or after ``origin - window``, edge 1 probes for the last photon before
    ``origin + window + 1``.  Of the probes whose photon lies in another partition only the latest (earliest) origin
    can give the smallest (largest) delay.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        current, started = None, False
        lo = hi = later = earlier = head = tail = None

        def out() -> pa.RecordBatch:
            row = [part, current, lo, hi, later, earlier, head, tail]
            kinds = [pa.int32(), pa.string(), *[pa.int64()] * 6]
            names = ["part", "particle", "lo", "hi", "later", "earlier", "head", "tail"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            second = batch.column("second").to_numpy(zero_copy_only=False)
            at, origin, edge = (batch.column(name).to_numpy() for name in ("at", "origin", "edge"))
            for particle, rows in _runs(batch.column("particle")):
                if started and particle != current:
                    yield out()
                    lo = hi = later = earlier = head = tail = None
                current, started = particle, True
                times = at[rows][second[rows]]
                met = np.cumsum(second[rows])
                ahead = (edge[rows] == 0) & ~second[rows]
                start, place = origin[rows][ahead], met[ahead]
                if len(times) and later is not None and times[0] - later <= window_ps:
                    lo = int(times[0] - later) if lo is None else min(lo, int(times[0] - later))
                if len(times):
                    later = None
                inside = place < len(times)
                delays = times[place[inside]] - start[inside]
                delays = delays[delays <= window_ps]
                if len(delays):
                    lo = int(delays.min()) if lo is None else min(lo, int(delays.min()))
                if (~inside).any():
                    latest = int(start[~inside].max())
                    later = latest if later is None else max(later, latest)
                behind = (edge[rows] == 1) & ~second[rows]
                start, place = origin[rows][behind], met[behind]
                known = place > 0
                last = np.where(known, times[np.maximum(place - 1, 0)] if len(times) else 0, tail if tail is not None else 0)
                found = known if tail is None else np.ones(len(start), bool)
                delays = (last - start)[found]
                delays = delays[delays >= -window_ps]
                if len(delays):
                    hi = int(delays.max()) if hi is None else max(hi, int(delays.max()))
                if (~found).any():
                    first_one = int(start[~found].min())
                    earlier = first_one if earlier is None else min(earlier, first_one)
                if len(times):
                    head, tail = int(times[0]) if head is None else head, int(times[-1])
        if started:
            yield out()

    return run


def observed_extent(first: DataFrame, second: DataFrame, window_ps: int) -> DataFrame:
    """``particle, lo, hi``: smallest and largest delay within the window; particles without a pair are left out."""
    edges = F.array(F.lit(-window_ps).cast("bigint"), F.lit(window_ps + 1).cast("bigint"))
    local = settle(_in_order(second, _probes(first, edges)).mapInArrow(_local_extent(window_ps), EXTENT))
    here = W.partitionBy("particle").orderBy("part")
    following = F.first("head", ignorenulls=True).over(here.rowsBetween(1, W.unboundedFollowing))
    previous = F.last("tail", ignorenulls=True).over(here.rowsBetween(W.unboundedPreceding, -1))
    joined = local.withColumns({"_next": following - F.col("later"), "_last": previous - F.col("earlier")})
    ahead = F.when(F.col("_next") <= window_ps, F.col("_next"))
    behind = F.when(F.col("_last") >= -window_ps, F.col("_last"))
    found = joined.groupBy("particle").agg(F.min(F.least("lo", ahead)).alias("lo"), F.max(F.greatest("hi", behind)).alias("hi"))
    return found.where("lo IS NOT NULL")
