"""Order-dependent building blocks that never put one key into one task.

A window over ``PARTITION BY particle`` sends a whole particle to a single task, which fails as
soon as one particle holds a large share of all photons.  Everything here therefore works in two
levels: a window over fixed-size position blocks, plus one summary row per block that carries the
state across block borders.  With a block of a million positions the summary of a key of 10^12 rows
is 10^6 rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from luxframe.session import settle, shuffle_width

BLOCK = 1_000_000


def _local_totals(keys: list[str], value: str):
    """Add ``__sum``: running sum of the integers in ``value`` over the rows of a key in one sorted partition.

    Null until the key's first known value.  Only the last key and its sum pass from one batch to the next.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry, known = None, 0, False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fresh = np.zeros(n, bool)
            for key in keys:
                column = batch.column(key)
                same = pc.equal(column.slice(1), column.slice(0, n - 1)).fill_null(False)
                empty = pc.is_null(column).to_numpy(zero_copy_only=False)
                fresh[1:] |= ~same.to_numpy(zero_copy_only=False) & ~(empty[1:] & empty[:-1])
            fresh[0] = last != [batch.column(key)[0].as_py() for key in keys]
            values = batch.column(value)
            met = pc.is_valid(values).to_numpy(zero_copy_only=False)
            sums = np.cumsum(values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            seen = np.cumsum(met)
            start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
            before, unmet = np.append(0, sums)[start], np.append(0, seen)[start]
            ongoing = np.cumsum(fresh) == 0
            total = sums - before + np.where(ongoing, carry, 0)
            some = (seen > unmet) | (ongoing & known)
            last, carry, known = [batch.column(key)[n - 1].as_py() for key in keys], int(total[-1]), bool(some[-1])
            added = pa.array(total, pa.int64(), mask=~some)
            yield pa.RecordBatch.from_arrays([*batch.columns, added], names=[*batch.schema.names, "__sum"])

    return run


def index_rows(
    df: DataFrame, keys: list[str], order: list[str], out: str, totals: dict[str, str] | None = None
) -> DataFrame:
    """Add the dense 0-based position of every row inside its key, in ``order``.

    ``keys + order`` must identify a row.  Rows are range-partitioned on the full ordering, so the
    partitions stay even whatever the key distribution; the sorted rows are written once, because
    the partition borders come from a sample and must not be drawn twice.  The summary of one row per
    partition and key is written too: the planner then knows how small it is, and as long as it can
    be sent to the tasks, the rows themselves are not moved again.

    ``totals``, ``{new name: column}`` with one bigint column, adds its inclusive running sum in the same
    pass; it is null until a key's first known value.
    """
    columns = [*keys, *order]
    name, value = next(iter(totals.items())) if totals else (None, None)
    ranged = df.repartitionByRange(shuffle_width(df.sparkSession), *columns).sortWithinPartitions(*columns)
    if totals:
        schema = StructType([*df.schema.fields, StructField("__sum", LongType())])
        ranged = ranged.mapInArrow(_local_totals(keys, value), schema)
    staged = settle(
        ranged.withColumn("__part", F.spark_partition_id()).withColumn("__pos", F.monotonically_increasing_id())
    )
    earlier = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    facts = [F.min("__pos").alias("__first"), F.count(F.lit(1)).alias("__n")]
    added = {"__before": F.coalesce(F.sum("__n").over(earlier), F.lit(0))}
    if totals:
        facts.append(F.sum(value).alias("__own"))
        added["__carry"] = F.sum("__own").over(earlier)
    runs = settle(staged.groupBy("__part", *keys).agg(*facts).withColumns(added).drop("__n", "__own"))
    placed = {out: F.col("__pos") - F.col("__first") + F.col("__before")}
    if totals:
        known = F.col("__sum").isNotNull() | F.col("__carry").isNotNull()
        placed[name] = F.when(known, F.coalesce("__sum", F.lit(0)) + F.coalesce("__carry", F.lit(0)))
    return (
        staged.join(runs, ["__part", *keys])
        .withColumns(placed)
        .drop("__part", "__pos", "__first", "__before", "__sum", "__carry")
    )


def whole(value: Column, width: int) -> Column:
    """``floor(value / width)`` of integers, exact where a double is not."""
    return F.call_function("div", value - F.pmod(value, F.lit(width)), F.lit(width))


def _block(pos: str, block: int) -> Column:
    return whole(F.col(pos), block)


def _inside(keys: list[str], pos: str) -> W:
    return W.partitionBy(*keys, "__block").orderBy(pos)


def _across(keys: list[str]) -> W:
    return W.partitionBy(*keys).orderBy("__block")


def ordinal(df: DataFrame, keys: list[str], pos: str, out: str, block: int = BLOCK) -> DataFrame:
    """Dense 0-based rank by a unique integer position."""
    return running_total(df, keys, pos, F.lit(1), out, block).withColumn(out, F.col(out) - 1)


def running_total(
    df: DataFrame, keys: list[str], pos: str, value: Column, out: str, block: int = BLOCK
) -> DataFrame:
    """Inclusive running sum of ``value`` by a unique integer position."""
    blocked = df.withColumn("__block", _block(pos, block)).withColumn("__value", value)
    earlier = _across(keys).rowsBetween(W.unboundedPreceding, -1)
    carried = (
        blocked.groupBy(*keys, "__block")
        .agg(F.sum("__value").alias("__sum"))
        .withColumn("__carry", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)))
        .drop("__sum")
    )
    upto = _inside(keys, pos).rowsBetween(W.unboundedPreceding, 0)
    return (
        blocked.join(carried, [*keys, "__block"])
        .withColumn(out, F.col("__carry") + F.sum("__value").over(upto))
        .drop("__block", "__value", "__carry")
    )


def _with_halo(df: DataFrame, pos: str, lag: int, lead: int, block: int) -> DataFrame:
    """Copy the rows next to a block border into the neighbouring block (``__copy.own`` is false)."""
    own = _block(pos, block)
    offset = F.col(pos) - own * block
    copies = [F.struct(own.alias("b"), F.lit(True).alias("own"))]
    if lag:
        copies.append(F.struct(F.when(offset >= block - lag, own + 1).alias("b"), F.lit(False).alias("own")))
    if lead:
        copies.append(F.struct(F.when(offset < lead, own - 1).alias("b"), F.lit(False).alias("own")))
    return df.withColumn("__copy", F.explode(F.filter(F.array(*copies), lambda c: c["b"].isNotNull())))


def neighbours(
    df: DataFrame,
    keys: list[str],
    pos: str,
    before: dict[str, str] | None = None,
    after: dict[str, str] | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Columns of the previous (``before``) and next (``after``) row: ``{new name: column}``.

    ``pos`` must be dense, so a row's neighbours are in its block or just across its border.
    """
    before, after = before or {}, after or {}
    order = W.partitionBy(*keys, "__copy.b").orderBy(pos)
    added = {name: F.lag(column).over(order) for name, column in before.items()}
    added |= {name: F.lead(column).over(order) for name, column in after.items()}
    halo = _with_halo(df, pos, int(bool(before)), int(bool(after)), block)
    return halo.withColumns(added).where("__copy.own").drop("__copy")


def following_position(df: DataFrame, keys: list[str], pos: str, out: str, block: int = BLOCK) -> DataFrame:
    """The next position of the same key, however far away it is; null for the last row."""
    blocked = df.withColumn("__block", _block(pos, block))
    heads = (
        blocked.groupBy(*keys, "__block")
        .agg(F.min(pos).alias("__head"))
        .withColumn("__right", F.lead("__head").over(_across(keys)))
        .drop("__head")
    )
    return (
        blocked.join(heads, [*keys, "__block"])
        .withColumn(out, F.coalesce(F.lead(pos).over(_inside(keys, pos)), F.col("__right")))
        .drop("__block", "__right")
    )


def last_known(
    df: DataFrame,
    keys: list[str],
    pos: str,
    value: Column,
    out: str,
    forward: bool = True,
    block: int = BLOCK,
) -> DataFrame:
    """Nearest non-null ``value`` at or before (``forward``) or at or after each row."""
    known = F.when(value.isNotNull(), F.struct(F.col(pos).alias("at"), value.alias("value")))
    blocked = df.withColumn("__block", _block(pos, block)).withColumn("__known", known)
    # Looking ahead is looking back in reverse order.  The nearest known row is then a running
    # minimum, which costs one step per row; a frame that shrinks from the far end would be
    # recomputed for every row.
    direction, nearest = (F.asc, F.max) if forward else (F.desc, F.min)
    outer = W.partitionBy(*keys).orderBy(direction("__block")).rowsBetween(W.unboundedPreceding, -1)
    inner = W.partitionBy(*keys, "__block").orderBy(direction(pos)).rowsBetween(W.unboundedPreceding, 0)
    carried = (
        blocked.groupBy(*keys, "__block")
        .agg(nearest("__known").alias("__best"))
        .withColumn("__carry", nearest("__best").over(outer))
        .drop("__best")
    )
    return (
        blocked.join(carried, [*keys, "__block"])
        .withColumn(out, F.coalesce(nearest("__known").over(inner), F.col("__carry"))["value"])
        .drop("__block", "__known", "__carry")
    )


def moving_frame(
    df: DataFrame, keys: list[str], pos: str, agg: Column, out: str, lead: int, lag: int, block: int = BLOCK
) -> DataFrame:
    """``agg`` over rows ``-lag..lead`` of a dense position."""
    frame = W.partitionBy(*keys, "__copy.b").orderBy(pos).rowsBetween(-lag, lead)
    return _with_halo(df, pos, lag, lead, block).withColumn(out, agg.over(frame)).where("__copy.own").drop("__copy")


def dense_spine(bounds: DataFrame, keys: list[str], count: str, out: str, step: int = 4096) -> DataFrame:
    """Rows ``0..count-1`` per key, spread over the cluster before the long expansion."""
    width = shuffle_width(bounds.sparkSession)
    last = F.floor((F.col(count) - 1) / step).cast("bigint")
    pages = bounds.where(F.col(count) > 0).withColumn("__page", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    first = F.col("__page") * step
    final = F.least(first + step, F.col(count).cast("bigint")) - 1
    return (
        pages.repartition(width, *keys, "__page")
        .withColumn(out, F.explode(F.sequence(first, final)))
        .drop("__page")
    )


def rows_in_intervals(
    rows: DataFrame,
    intervals: DataFrame,
    keys: list[str],
    pos: str,
    first: str,
    last: str,
    block: int = 65_536,
    stored: str | None = None,
) -> DataFrame:
    """Join every row to the inclusive position intervals that contain it.

    Intervals are repeated once per block they touch, so the join is an equi-join on key and block
    and a key of any size spreads over as many tasks as it has blocks.  Rows that are stored by key and block name the
    column that holds the block (``stored``); they stay where they are.
    """
    if stored:
        spread = intervals.withColumn(stored, F.explode(F.sequence(_block(first, block), _block(last, block))))
        return rows.join(spread, [*keys, stored]).where(F.col(pos).between(F.col(first), F.col(last))).drop(stored)
    spread = intervals.withColumn(
        "__block", F.explode(F.sequence(_block(first, block), _block(last, block)))
    )
    return (
        rows.withColumn("__block", _block(pos, block))
        .join(spread, [*keys, "__block"])
        .where(F.col(pos).between(F.col(first), F.col(last)))
        .drop("__block")
    )
