"""Choosing particles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = ("only", "add", "remove", "invert")


def parse_ranges(text: str) -> list[tuple[int, int | None]]:
    """``"1-3,7,9-"`` as inclusive ranges; an open end is ``None``."""
    ranges = []
    for part in text.replace(" ", "").split(","):
        if not part:
            continue
        match = re.fullmatch(r"(\d+)(-(\d*))?", part)
        if not match:
            raise ValueError(f"not a range: {part}")
        low = int(match[1])
        high = low if match[2] is None else int(match[3]) if match[3] else None
        ranges.append((low, high))
    return ranges


def select_particles(particles: DataFrame, text: str, mode: str = "only") -> DataFrame:
    """Update ``selected`` from 1-based ``particle_number`` ranges.

    Ranges stay ranges: the choice is one predicate, however many particles it covers, and an open
    range reaches the last of them.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    named = F.lit(False)
    number = F.col("particle_number")
    for low, high in parse_ranges(text):
        named = named | ((number >= low) if high is None else number.between(low, high))
    current = F.col("selected")
    outcome = {
        "only": named,
        "add": current | named,
        "remove": current & ~named,
        "invert": F.when(named, ~current).otherwise(current),
    }[mode]
    return particles.withColumn("selected", outcome)


def scoped(rows: DataFrame, selected: DataFrame | None, keys: list[str] = ["particle"]) -> DataFrame:
    """Rows of the selected particles, or all rows without a selection."""
    return rows if selected is None else rows.join(selected.select(*keys).distinct(), keys, "left_semi")


def card_filter(rows: DataFrame, channel: int) -> DataFrame:
    return rows.where(F.col("channel") == channel)
