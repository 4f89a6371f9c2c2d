"""The given tables seen as photon streams and level tables.

``events`` becomes five emitters (``event_type``) recorded by two detectors.  Its clock is stretched
by 1, 4 and 2 in turn for every two days, so that each emitter steps between three intensities while
every row is kept.  ``lineitem`` becomes a level table: the supplier is the emitter and the ordered
lines are its levels, some of them with a fitted lifetime.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from luxframe.operators.ordered import index_rows, whole
from luxframe.sources import photon_store

PERIOD_US = 2 * 86_400_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def photons(spark: SparkSession, folder: str) -> DataFrame:
    """particle, channel, photon_id, period, abs_ns, micro_ns"""
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    period = whole(F.col("us"), PERIOD_US)
    phase = F.pmod("period", F.lit(3))
    slow = F.when(phase == 0, 1).when(phase == 1, 4).otherwise(2)
    head = F.when(phase == 0, 0).when(phase == 1, 1).otherwise(5)
    start = (whole(F.col("period"), 3) * 7 + head) * PERIOD_US
    return (
        table(spark, folder, "events")
        .withColumn("us", us)
        .withColumn("period", period)
        .select(
            F.col("event_type").alias("particle"),
            (F.pmod("user_id", F.lit(2)) + 1).cast("int").alias("channel"),
            F.col("event_id").alias("photon_id"),
            "period",
            ((start + (F.col("us") - F.col("period") * PERIOD_US) * slow) * 1000).alias("abs_ns"),
            (F.col("value") / 10).alias("micro_ns"),
        )
    )


def stored_photons(spark: SparkSession, folder: str) -> DataFrame:
    """``photons`` with ``photon_ind`` and ``block`` from the photon store of this folder."""
    return photon_store.opened(photons(spark, folder), table(spark, folder, "events"))


def indexed_photons(spark: SparkSession, folder: str) -> DataFrame:
    """``photons`` with their dense position ``photon_ind`` in arrival order."""
    return stored_photons(spark, folder).drop("block")


def true_change_points(indexed: DataFrame) -> DataFrame:
    """First photon of every period: the places where the clock changes speed."""
    starts = indexed.groupBy("particle", "period").agg(F.min("photon_ind").alias("cpt_ind"))
    return starts.where("cpt_ind > 0").select("particle", "cpt_ind")


def line_levels(spark: SparkSession, folder: str, ordered: bool = True) -> DataFrame:
    """``lineitem`` as levels with fit results; ``ordered`` adds ``level_ind`` and times."""
    dwell_ms = 1 + F.round(F.col("l_discount") * 100) * 10 + F.round(F.col("l_tax") * 100)
    fitted = F.col("l_linenumber") < 6
    lines = with_rates(
        table(spark, folder, "lineitem").select(
            F.concat(F.lit("meas"), F.col("l_suppkey")).alias("particle"),
            F.col("l_shipdate").alias("shipped"),
            F.col("l_orderkey").alias("line_order"),
            F.col("l_linenumber").alias("line_no"),
            F.col("l_partkey").alias("part_key"),
            F.col("l_returnflag").alias("flag"),
            (F.col("l_quantity") * 20).cast("bigint").alias("num_photons"),
            dwell_ms.cast("bigint").alias("dwell_ms"),
            F.when(fitted, 1 + F.col("l_extendedprice") / 10000).alias("av_tau"),
            F.when(fitted, 0.5 + F.col("l_discount") * 10).alias("chisq"),
            F.when(fitted, 1.5 + F.col("l_tax") * 8).alias("dw"),
            F.when(fitted, F.col("l_quantity") / 10 - 2.5).alias("irf_shift"),
        )
    )
    return lines if not ordered else ordered_lines(lines)


def ordered_lines(lines: DataFrame) -> DataFrame:
    """Positions and end times in one pass; what follows from other columns is worked out where it is read."""
    order = ["shipped", "line_order", "line_no", "part_key", "num_photons"]
    slim = lines.drop("dwell_s", "int_p_s")
    timed = with_rates(index_rows(slim, ["particle"], order, "level_ind", totals={"end_ms": "dwell_ms"}))
    start = (F.col("end_ms") - F.col("dwell_ms")) / 1000.0
    timed = timed.withColumns({"start_s": start, "end_s": F.col("end_ms") / 1000.0})
    return timed.select(*lines.columns, "level_ind", "end_ms", "start_s", "end_s")


def with_rates(lines: DataFrame) -> DataFrame:
    dwell = F.col("dwell_ms") / 1000.0
    return lines.withColumns({"dwell_s": dwell, "int_p_s": F.col("num_photons") / dwell})


PHOTONS_SQL = """
ev AS (SELECT *, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) AS us FROM events),
pe AS (SELECT *, us // 172800000000 AS period FROM ev),
raw AS (SELECT event_type AS particle, CAST(user_id % 2 + 1 AS INTEGER) AS channel, event_id AS photon_id, period,
  (((period // 3) * 7 + CASE period % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 5 END) * 172800000000
   + (us - period * 172800000000) * CASE period % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 2 END) * 1000 AS abs_ns,
  value / 10 AS micro_ns FROM pe),
ph AS (SELECT *, row_number() OVER (PARTITION BY particle ORDER BY abs_ns, photon_id) - 1 AS photon_ind FROM raw)"""

LEVELS_SQL = (
    PHOTONS_SQL
    + """,
cp AS (SELECT particle, period, min(photon_ind) AS first_ind FROM ph GROUP BY ALL),
lv0 AS (SELECT particle, row_number() OVER w - 1 AS level_ind, first_ind,
  lead(first_ind) OVER w - 1 AS nxt FROM cp WINDOW w AS (PARTITION BY particle ORDER BY first_ind)),
lv1 AS (SELECT l.particle, level_ind, first_ind, coalesce(nxt, n - 1) AS last_ind FROM lv0 l
  JOIN (SELECT particle, count(*) AS n FROM ph GROUP BY ALL) c ON c.particle = l.particle),
lv AS (SELECT l.*, a.abs_ns AS start_ns, b.abs_ns AS end_ns, last_ind - first_ind + 1 AS num_photons,
  (b.abs_ns - a.abs_ns) / 1e9 AS dwell_s,
  (last_ind - first_ind + 1) / nullif((b.abs_ns - a.abs_ns) / 1e9, 0) AS int_p_s
  FROM lv1 l JOIN ph a ON a.particle = l.particle AND a.photon_ind = first_ind
  JOIN ph b ON b.particle = l.particle AND b.photon_ind = last_ind)"""
)

LINES_SQL = """
ln0 AS (SELECT 'meas' || l_suppkey AS particle, l_shipdate AS shipped, l_orderkey AS line_order,
  l_linenumber AS line_no, l_partkey AS part_key, l_returnflag AS flag,
  CAST(l_quantity * 20 AS BIGINT) AS num_photons,
  CAST(1 + round(l_discount * 100) * 10 + round(l_tax * 100) AS BIGINT) AS dwell_ms,
  CASE WHEN l_linenumber < 6 THEN 1 + l_extendedprice / 10000 END AS av_tau,
  CASE WHEN l_linenumber < 6 THEN 0.5e0 + l_discount * 10 END AS chisq,
  CASE WHEN l_linenumber < 6 THEN 1.5e0 + l_tax * 8 END AS dw,
  CASE WHEN l_linenumber < 6 THEN l_quantity / 10 - 2.5e0 END AS irf_shift FROM lineitem),
ln1 AS (SELECT *, dwell_ms / 1000e0 AS dwell_s, num_photons / (dwell_ms / 1000e0) AS int_p_s FROM ln0),
ln AS (SELECT *, row_number() OVER w - 1 AS level_ind, CAST(sum(dwell_ms) OVER w AS BIGINT) AS end_ms,
  (sum(dwell_ms) OVER w - dwell_ms) / 1000e0 AS start_s, sum(dwell_ms) OVER w / 1000e0 AS end_s FROM ln1
  WINDOW w AS (PARTITION BY particle ORDER BY shipped, line_order, line_no, part_key, num_photons
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
