"""Change points of a measurement that is still being written.

The chain of ``operators/change_points.py`` with an unknown end: a segment is searched as soon as no later photon can change
where it ends.  State of a particle is the photons from the next possible segment start on (at most a segment and an overlap),
the points a later segment may still find again, and the photons of the last ``late_s`` seconds, whose order is still open.
A timer closes the last segment.
"""

from __future__ import annotations

from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from luxframe.config import ChangePointSettings
from luxframe.operators.change_points import Chain
from luxframe.operators.ordered import whole

POINTS = "particle string, recording int, cpt_ind bigint, region_lo bigint, region_hi bigint, wlr double"
STATE = (
    "recording int, base bigint, end bigint, latest bigint, highest bigint, seen boolean, taken bigint, due bigint, "
    "times array<bigint>, pending array<bigint>, held_ind array<bigint>, held_lo array<bigint>, held_hi array<bigint>, "
    "held_wlr array<double>"
)
STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NONE = -1


class OpenChain:
    """Segments of one particle while photons still arrive; ``times`` starts at photon ``base``."""

    def __init__(self, settings, base=0, end=NONE, latest=NONE, highest=NONE, seen=False, times=(), held=()):
        self.settings = settings
        self.base, self.end, self.latest, self.highest, self.seen = base, end, latest, highest, seen
        self.times = np.asarray(times, dtype=np.int64)
        self.held = {point[0]: tuple(point) for point in held}

    def _due(self, chain: Chain, closed: bool) -> tuple[int, int] | None:
        """Next segment, unless later photons could still change it."""
        sure = chain.last >= max(self.end, 0) + self.settings.segment
        if not (closed or sure):
            return None
        if self.end == NONE:
            return chain.first_segment()
        found = [] if self.latest == NONE else [self.highest, self.latest]
        return chain.following(self.end, found, self.seen)

    def advance(self, times: np.ndarray, closed: bool = False) -> list[tuple[int, int, int, float]]:
        """Take later photons; give the points that are final now, in order."""
        self.times = np.concatenate([self.times, times])
        chain = Chain(self.times, self.base, self.base + len(self.times), self.settings)
        while (segment := self._due(chain, closed)) is not None:
            found = chain.search(*segment)
            self.seen = self.seen or bool(found)
            self.end = segment[1]
            self.latest, self.highest = (found[-1], max(found)) if found else (NONE, NONE)
        for point in chain.points:
            known = self.held.get(point[0])
            if known is None or point[3] > known[3]:
                self.held[point[0]] = point
        return self._settled(closed)

    def _settled(self, closed: bool) -> list[tuple[int, int, int, float]]:
        """Forget photons and points in front of every possible next segment."""
        start = max(self.base, self.end - self.settings.overlap)
        done = sorted(at for at in self.held if closed or at < start)
        self.times, self.base = self.times[start - self.base :], start
        return [self.held.pop(at) for at in done]


class Tracker(StatefulProcessor):
    def __init__(self, settings: ChangePointSettings, late_ms: int, idle_ms: int):
        self.raw, self.late_ms, self.idle_ms = asdict(settings), late_ms, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("chain", STATE)

    def _load(self) -> tuple[OpenChain, dict]:
        settings = ChangePointSettings(**self.raw)
        if not self.kept.exists():
            return OpenChain(settings), {"recording": 0, "taken": NONE, "due": NONE, "pending": []}
        row = self.kept.get()
        names = [field.strip().split(" ")[0] for field in STATE.split(",")]
        state = dict(zip(names, row))
        held = zip(*(state[name] for name in ("held_ind", "held_lo", "held_hi", "held_wlr")))
        chain = OpenChain(settings, *row[1:6], state["times"], held)
        return chain, {name: state[name] for name in ("recording", "taken", "due", "pending")}

    def _save(self, chain: OpenChain, rest: dict) -> None:
        columns = list(zip(*chain.held.values())) or [(), (), (), ()]
        held = [[int(value) for value in column] for column in columns[:3]] + [[float(value) for value in columns[3]]]
        numbers = [int(value) for value in (chain.base, chain.end, chain.latest, chain.highest)]
        times, pending = chain.times.tolist(), [int(t) for t in rest["pending"]]
        self.kept.update((rest["recording"], *numbers, bool(chain.seen), rest["taken"], rest["due"], times, pending, *held))

    def _follow(self, key, chain: OpenChain, rest: dict, times: np.ndarray, closed: bool) -> tuple[OpenChain, pd.DataFrame]:
        """Take photons in order, a recording after the other; the last one ends here if ``closed``."""
        rows = []
        pauses = np.flatnonzero(np.diff(times, prepend=rest["taken"] if rest["taken"] != NONE else times[:1]) > self.idle_ms * 1_000_000)
        parts = np.split(times, pauses)
        for place, part in enumerate(parts):
            ends = closed or place < len(parts) - 1
            points = chain.advance(part, closed=ends)
            rows += [(key[0], rest["recording"], int(at), int(low), int(high), float(wlr)) for at, low, high, wlr in points]
            if ends:
                chain = OpenChain(chain.settings)
                rest["recording"] += 1
        if len(times):
            rest["taken"] = int(times[-1])
        return chain, pd.DataFrame(rows, columns=["particle", "recording", "cpt_ind", "region_lo", "region_hi", "wlr"])

    def handleInputRows(self, key, rows, timerValues):
        chain, rest = self._load()
        arrived = [frame["abs_ns"].to_numpy(dtype=np.int64) for frame in rows]
        times = np.sort(np.concatenate([np.asarray(rest["pending"], dtype=np.int64), *arrived]))
        newest = max(rest["taken"], int(times[-1]))
        ready = np.searchsorted(times, (newest // 1_000_000 - self.late_ms) * 1_000_000, "right")
        rest["pending"] = times[ready:]
        chain, found = self._follow(key, chain, rest, times[:ready], closed=False)
        if rest["due"] != NONE:
            self.handle.deleteTimer(rest["due"])
        rest["due"] = newest // 1_000_000 + self.idle_ms + 1  # whatever still belongs to this recording is late by then
        self.handle.registerTimer(rest["due"])
        self._save(chain, rest)
        yield found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        chain, rest = self._load()
        chain, found = self._follow(key, chain, rest, np.asarray(rest["pending"], dtype=np.int64), closed=True)
        rest.update(taken=NONE, due=NONE, pending=[])
        self._save(chain, rest)
        yield found

    def close(self) -> None:
        pass


def track_change_points(
    photons: DataFrame,
    settings: ChangePointSettings = ChangePointSettings(),
    late_s: float = 1.0,
    idle_s: float = 60.0,
    clock: str | None = None,
) -> DataFrame:
    """``particle, recording, cpt_ind, region_lo, region_hi, wlr``, each point once and as soon as it is final.

    ``photons(particle, abs_ns)`` may arrive up to ``late_s`` seconds out of order; what is later than that is dropped by the
    stream's watermark.  A pause of more than ``idle_s`` seconds ends a recording: its last segment is searched, and the photons
    behind it are the particle's next recording, whose positions start at 0.  Batches have no influence on that.  ``clock`` names a timestamp column for
    particles that are not on one clock; ``abs_ns`` is the clock otherwise.  Equal times count as often as they come; photons
    without a particle are a particle of their own.  One batch's photons of a particle meet in one task, so files per
    batch bound the task.
    """
    photons.sparkSession.conf.set(STORE_SETTING, STORE)  # this kind of state needs column families
    seen = F.col(clock) if clock else F.timestamp_micros(whole(F.col("abs_ns"), 1000))
    timed = photons.withColumn("seen", seen).select("particle", "abs_ns", "seen")
    tracker = Tracker(settings, round(late_s * 1000), round(max(idle_s, late_s) * 1000))
    return (
        timed.withWatermark("seen", f"{round(late_s * 1000)} milliseconds")
        .groupBy("particle")
        .transformWithStateInPandas(tracker, outputStructType=POINTS, outputMode="append", timeMode="eventTime")
    )
