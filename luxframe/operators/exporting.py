"""Export tables and the formats they are written in."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from luxframe.session import shuffle_width

SPARK_FORMATS = {"parquet": "parquet", "csv": "csv", "orc": "orc", "json": "json"}


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> DataFrame | None:
    """Write an export of any size.

    Feather files are written by the tasks, one per partition; the returned table ``file, rows`` lists those of
    the tasks that finished.  Single-file formats (pickle, Excel, HDF) would pass through one machine and are refused.
    """
    if fmt in SPARK_FORMATS:
        writer = df.write.mode(mode)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.format(SPARK_FORMATS[fmt]).save(path)
        return
    if fmt == "feather":
        return _write_feather(df, path)
    raise ValueError(f"unknown format {fmt}; one of {', '.join([*SPARK_FORMATS, 'feather'])}")


def csv_round_trip(df: DataFrame, path: str, headers: dict[str, str] | None = None) -> DataFrame:
    """Write a CSV export, with other column headers if named, and give the rows as they were written."""
    write_table(df.withColumnsRenamed(headers or {}), path, "csv")
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)


def _write_feather(df: DataFrame, path: str) -> DataFrame:
    """One Arrow file per partition under a name of its own; Spark commits the list of files."""
    folder = path if "://" in path else f"file://{os.path.abspath(path)}"

    def run(batches):
        system, inner = pafs.FileSystem.from_uri(folder)
        system.create_dir(inner, recursive=True)
        name, writer, rows = f"part-{uuid.uuid4().hex}.feather", None, 0
        for batch in batches:
            if writer is None:
                sink = system.open_output_stream(f"{inner}/{name}")
                writer = pa.ipc.new_file(sink, batch.schema)
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "rows": [rows]})

    files = f"{folder}/_files"
    df.mapInArrow(run, "file string, rows long").write.mode("overwrite").parquet(files)
    return df.sparkSession.read.parquet(files)


def padded(array: str, size: int, prefix: str) -> list[Column]:
    """Array elements as columns ``prefix1..prefixN``, null beyond the end."""
    return [F.try_element_at(F.col(array), F.lit(k)).alias(f"{prefix}{k}") for k in range(1, size + 1)]


def max_exponents(fits: DataFrame) -> DataFrame:
    return fits.agg(F.coalesce(F.max("numexp"), F.lit(0)).alias("max_exp_num"))


def levels_table(levels: DataFrame, roi_levels: DataFrame | None = None, max_exp: int = 1, grouped: bool = False) -> DataFrame:
    """The unified level table; ``roi_levels(particle, first_level, last_level)`` marks the region."""
    totals = levels.groupBy("particle").agg((F.max("end_s") - F.min("start_s")).alias("_whole_s"))
    table = levels.join(totals, "particle")
    in_roi = F.lit(True)
    if roi_levels is not None:
        table = table.join(roi_levels, "particle", "left")
        in_roi = F.coalesce(F.col("level_ind").between(F.col("first_level"), F.col("last_level")), F.lit(True))
    present = set(levels.columns)
    fit_columns = [
        c for c in ("num_photons_in_lifetime_fit", "av_tau", "av_tau_std") if c in present
    ]
    arrays = [
        piece
        for array, prefix in (("tau", "tau_"), ("tau_std", "tau_std_"), ("amp", "amp_"), ("amp_std", "amp_std_"))
        if array in present
        for piece in padded(array, max_exp, prefix)
    ]
    rest = [c for c in ("irf_shift", "decay_bg", "irf_bg", "chisq", "dw", "dw_5", "dw_1", "dw_03", "dw_01") if c in present]
    return table.select(
        "particle",
        (F.col("level_ind") + 1).alias("level"),
        *([(F.col("group_ind") + 1).alias("group_index")] if "group_ind" in present else []),
        F.col("start_s").alias("start"),
        F.col("end_s").alias("end"),
        F.col("dwell_s").alias("dwell"),
        F.try_divide("dwell_s", "_whole_s").alias("dwell_frac"),
        F.col("int_p_s").alias("int"),
        "num_photons",
        *fit_columns,
        *arrays,
        *rest,
        in_roi.alias("is_in_roi"),
        F.lit(grouped).alias("is_grouped"),
    )


def groups_table(groups: DataFrame, num_steps: Column, is_best_step: Column) -> DataFrame:
    return groups.select(
        "particle",
        (F.col("group_ind") + 1).alias("group"),
        F.col("dwell_s").alias("total_dwell_time"),
        F.col("int_p_s").alias("int"),
        "num_levels",
        "num_photons",
        num_steps.alias("num_steps"),
        is_best_step.alias("is_best_step"),
        F.lit(True).alias("is_primary_particle"),
        F.lit("1").alias("tcspc_card"),
    )


def trace_table(trace: DataFrame, roi: DataFrame | None = None, whole: bool = True) -> DataFrame:
    """Trace rows; with a region, its rows only (``whole=False``)."""
    table = trace.withColumn("t_s", F.col("t_ms") / 1000)
    if roi is not None and not whole:
        table = table.join(roi, "particle").where(F.col("t_s").between(F.col("roi_start_s"), F.col("roi_end_s")))
    return table.select("particle", (F.col("bin") + 1).alias("bin_number"), "t_s", "counts")


def hist_table(decays: DataFrame, fits: DataFrame | None = None) -> DataFrame:
    """Decay rows, with fit and residual columns inside the fitted range."""
    if fits is None:
        return decays.select("particle", "ch", "t_ns", "counts")
    curve = fits.select("particle", F.posexplode(F.arrays_zip("model", "residual")).alias("_i", "_p"), "start_ch").select(
        "particle", (F.col("_i") + F.col("start_ch")).alias("ch"), F.col("_p.model").alias("fit"), F.col("_p.residual").alias("residual")
    )
    return decays.join(curve, ["particle", "ch"], "left").select("particle", "ch", "t_ns", "counts", "fit", "residual")


def renumber(existing: DataFrame, added: DataFrame) -> DataFrame:
    """Append particles after the existing ones, numbered on from the highest number."""
    from luxframe.operators.ordered import index_rows

    top = existing.agg(F.coalesce(F.max("particle_number"), F.lit(0))).first()[0]
    numbered = index_rows(added.drop("particle_number"), [], ["name"], "_pos").withColumn(
        "particle_number", (F.col("_pos") + F.lit(top) + 1).cast("bigint")
    )
    return existing.unionByName(numbered.select(existing.columns))


def write_per_particle(df: DataFrame, path: str, headers: dict[str, str] | None = None) -> None:
    """CSV export with one folder per particle.

    Rows are dealt by particle and a hash first, so a particle has at most a quarter as many files as there
    are tasks, and a very large one is still written by many of them.
    """
    for column, header in (headers or {}).items():
        df = df.withColumnRenamed(column, header)
    tasks = shuffle_width(df.sparkSession)
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(max(tasks // 4, 1)))
    clustered = df.repartition(tasks, "particle", spread)
    clustered.write.mode("overwrite").partitionBy("particle").option("header", True).csv(path)


# Headers of the exported CSV tables.
TRACE_HEADERS = {"bin_number": "Bin #", "t_s": "Bin Time (s)", "counts": "Bin Int (counts)"}
LEVEL_HEADERS = {
    "level": "Level #",
    "start": "Start Time (s)",
    "end": "End Time (s)",
    "dwell": "Dwell Time (/s)",
    "int": "Int (counts/s)",
    "num_photons": "Num of Photons",
}


def level_rows(levels: DataFrame) -> DataFrame:
    return levels.select(
        "particle",
        (F.col("level_ind") + 1).alias("level"),
        F.col("start_s").alias("start"),
        F.col("end_s").alias("end"),
        F.col("dwell_s").alias("dwell"),
        F.col("int_p_s").alias("int"),
        "num_photons",
    )


def grouping_results(steps: DataFrame) -> DataFrame:
    """Steps of each particle with the number of steps, the best criterion and the selected step."""
    facts = steps.groupBy("particle").agg(
        F.count(F.lit(1)).alias("num_steps"),
        F.max(F.when(F.col("is_best"), F.col("bic"))).alias("best_bic"),
        F.max(F.when(F.col("is_best"), F.col("step"))).alias("selected_step"),
    )
    return steps.join(facts, "particle").select(
        "particle", "num_steps", "best_bic", "selected_step", (F.col("step") + 1).alias("step"), "num_groups", "bic"
    )


def group_info(groups: DataFrame) -> DataFrame:
    return groups.select(
        "particle", (F.col("group_ind") + 1).alias("group"), "int_p_s", "dwell_s", "num_levels", "num_photons"
    )


def correlation_rows(hist: DataFrame, per_thousand: bool = False) -> DataFrame:
    """Correlation export; ``per_thousand`` divides counts by 1000 like older exports."""
    counts = F.col("counts") / 1e3 if per_thousand else F.col("counts")
    return hist.select("particle", (F.col("bin") + 1).alias("bin_number"), "left_ns", counts.alias("counts"))
