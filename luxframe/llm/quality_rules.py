"""Quality rules: fixed limits first, then robust multivariate outliers.

The statistic vectors of the documents that pass the limits are transformed (``VECTOR``) and compared with
the minimum-covariance-determinant estimate of their language and source.  Concentration steps run for all
groups at once as aggregations: squared distances from the present centre, their exact rank by a histogram
(equal bins however the rows are partitioned), then mean and covariance of the nearest ``SHARE``.  Partial sums
leave the tasks, and rows meet the estimate of their group in ``SALTS`` parts, so a source that holds a third of
all documents is spread.  A document also counts for
its language and for the whole table; groups below ``LEAST`` documents are judged by the next larger one.
The ridge keeps a statistic that never varies from rejecting its first small change.

Null texts have no words and fail the limits.  Null language or source is a group of its own.  Repeated rows
count each time and get equal verdicts.  An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from luxframe.llm.statistics import statistics
from luxframe.llm.textual import scratch

MIN_WORDS = 50
REPEAT_SHARE = (100, 50)  # fails above 50 in 100 repeated words
SHARE = 0.75
STEPS = 4
LEAST = 60
SALTS = 32  # parts of a group where rows meet the estimate of their group
GRID = 64  # steps of the exact medians, bins per doubling of a distance
CUT = 5.6  # normal quantile of the rejection level, about one in 10^8

VECTOR = {
    "long": "ln(n_words)",
    "word": "3 * ln(word_chars / n_words)",
    "symbols": "asinh(20D * n_symbols / n_words)",
    "lines": "asinh(30D * n_dup_lines / n_words)",
    "repeats": "asinh(5D * n_repeat_words / n_words)",
    "capitals": "asinh(10D * n_upper / word_chars)",
}
RIDGE = {"long": 0.5, "word": 0.2, "symbols": 0.25, "lines": 0.3, "repeats": 0.3, "capitals": 0.2}
NAMES = list(VECTOR)
PAIRS = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[i:]]
MODEL = "key string, n long, centre array<double>, whitening array<double>"


def chi_square(z: float, dof: int = len(NAMES)) -> float:
    """Quantile of the chi-square distribution at the normal quantile ``z`` (Wilson-Hilferty)."""
    part = 2 / (9 * dof)
    return dof * (1 - part + z * part**0.5) ** 3


def distance(centre: str = "centre", whitening: str = "whitening") -> Column:
    """Squared Mahalanobis distance with the inverse Cholesky factor stored row by row."""
    p = len(NAMES)
    gaps = [F.col(name) - F.col(centre)[i] for i, name in enumerate(NAMES)]
    turned = [reduce(Column.__add__, [F.col(whitening)[i * p + j] * gaps[j] for j in range(i + 1)]) for i in range(p)]
    return reduce(Column.__add__, [t * t for t in turned])


def _bin(squared: Column) -> Column:
    return F.floor(F.log2(F.greatest(squared, F.lit(2.0**-20))) * GRID)


def _levels(rows: DataFrame) -> DataFrame:
    """One row per document and level: language and source, language, everything."""
    levels = [("2", ["lang", "source"]), ("1", ["lang"]), ("0", [])]
    keys = [F.to_json(F.struct(F.lit(level).alias("level"), *columns)) for level, columns in levels]
    return rows.withColumn("keys", F.array(*keys))


def _whiten(covariance: np.ndarray) -> np.ndarray:
    ridged = covariance + np.diag([RIDGE[name] ** 2 for name in NAMES])
    return np.linalg.inv(np.linalg.cholesky(ridged))


def _solve(sums: DataFrame) -> DataFrame:
    """Centre and whitening of each group from its sums; one small row per group."""

    def run(batches):
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                n, p = row["n"], len(NAMES)
                centre = np.array([row[f"s_{name}"] for name in NAMES]) / n
                cov = np.zeros((p, p))
                for a, b in PAIRS:
                    i, j = NAMES.index(a), NAMES.index(b)
                    cov[i, j] = cov[j, i] = row[f"q_{a}_{b}"] / n - centre[i] * centre[j]
                low, vectors = np.linalg.eigh(cov)
                cov = (vectors * np.maximum(low, 0)) @ vectors.T * row.get("scale", 1.0)
                found.append((row["key"], n, centre.tolist(), _whiten(cov).ravel().tolist()))
            columns = [pa.array([f[i] for f in found]) for i in range(4)]
            if found:
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "centre", "whitening"])

    return sums.mapInArrow(run, MODEL)


def _start(members: DataFrame) -> DataFrame:
    """Medians and quartile ranges on a fixed grid, so that they are exact and few values are held."""
    quarters = [F.percentile(F.round(F.col(n) * GRID) / GRID, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias(n) for n in NAMES]
    rows = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *quarters)
    p = len(NAMES)
    inverse = [1 / F.sqrt(F.pow((F.col(n)[2] - F.col(n)[0]) / 1.349, 2) + RIDGE[n] ** 2) for n in NAMES]
    return rows.select(
        "key",
        "n",
        F.array(*[F.col(n)[1] for n in NAMES]).alias("centre"),
        F.array(*[inverse[i] if i == j else F.lit(0.0) for i in range(p) for j in range(p)]).alias("whitening"),
    )


def _salt() -> Column:
    """Part of its group that a row belongs to: even for any group, and written down with the row."""
    return F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")


def _spread(groups: DataFrame) -> DataFrame:
    """A copy of each group's row for each part of the group."""
    return groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _ranked(members: DataFrame, model: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """Rows with the bin of their distance, and the bin that holds the ``share`` quantile of each group."""
    met = members.join(_spread(model.drop("n")), ["key", "salt"])
    binned = met.withColumn("bin", _bin(distance())).drop("centre", "whitening")
    counts = binned.groupBy("key", "bin").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(W.partitionBy("key").orderBy("bin"))
    whole = F.sum("c").over(W.partitionBy("key"))
    reached = counts.withColumn("upto", upto).withColumn("whole", whole).where(F.col("upto") >= F.col("whole") * share)
    return binned, reached.groupBy("key").agg(F.min("bin").alias("last"))


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(name).alias(f"s_{name}") for name in NAMES],
        *[F.sum(F.col(a) * F.col(b)).alias(f"q_{a}_{b}") for a, b in PAIRS],
    )


def fit(passed: DataFrame, steps: int = STEPS, share: float = SHARE) -> DataFrame:
    """``key, n, centre, whitening`` of every group of the vectors in ``passed`` (with ``keys``)."""
    members = scratch(passed.select(F.explode("keys").alias("key"), "salt", *NAMES))
    sizes = scratch(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    model = scratch(_start(members))
    for _ in range(steps):
        binned, last = _ranked(members, model, share)
        model = scratch(_solve(_sums(binned.join(_spread(last), ["key", "salt"]).where(F.col("bin") <= F.col("last")))))
    # The nearest half of a normal sample ends at the chi-square median: that calibrates the covariance,
    # and all documents inside the 97.5 % ellipsoid give the final estimate.
    binned, half = _ranked(members, model, 0.5)
    scale = F.greatest(F.lit(1.0), F.pow(2.0, (F.col("last") + 0.5) / GRID) / chi_square(0.0))
    inside = binned.join(_spread(half), ["key", "salt"]).where(F.pow(2.0, F.col("bin") / GRID) <= scale * chi_square(1.96))
    calibrated = _sums(inside).join(half.select("key", scale.alias("scale")), "key")
    return scratch(_solve(calibrated).drop("n").join(sizes, "key").select("key", "n", "centre", "whitening"))


def judge(docs: DataFrame, cut: float = CUT, least: int = LEAST, carry: dict[str, str] | None = None) -> DataFrame:
    """``carry`` (columns and their types), counts, ``base_failed``, ``distance`` (squared, null where the limits failed) and ``kept`` of every document."""
    keep = {"doc_id": "long", "lang": "string", "source": "string"} | (carry or {})
    per, limit = REPEAT_SHARE
    failed = (F.col("n_words") < MIN_WORDS) | (per * F.col("n_repeat_words") > limit * F.col("n_words"))
    # ``long`` ids may repeat, so verdicts travel with their rows and are never joined by id.
    counted = scratch(_levels(statistics(docs, keep=keep).withColumn("base_failed", failed)).withColumn("salt", _salt()))
    vectors = counted.withColumns(
        {name: F.when(~F.col("base_failed"), F.expr(rule)) for name, rule in VECTOR.items()}
    )
    model = fit(vectors.where(~F.col("base_failed")), STEPS, SHARE)
    large = model.where(F.col("n") >= least)
    judged = vectors
    for i in range(3):
        part = large.select(
            F.col("key").alias(f"key{i}"), F.col("centre").alias(f"centre{i}"), F.col("whitening").alias(f"whitening{i}")
        )
        judged = judged.withColumn(f"key{i}", F.col("keys")[i]).join(_spread(part), [f"key{i}", "salt"], "left")
    chosen = F.coalesce(*[distance(f"centre{i}", f"whitening{i}") for i in range(3)])
    judged = judged.withColumn("distance", F.when(~F.col("base_failed"), chosen))
    # A table too small for any estimate keeps what passed the limits.
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi_square(cut), F.lit(True))
    return judged.withColumn("kept", kept).select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept"
    )
