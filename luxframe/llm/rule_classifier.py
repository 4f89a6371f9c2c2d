"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on a bounded sample of labelled rows (``SAMPLE`` rows at most, chosen by a hash of
the id, numbers only).  Every path from a root becomes a conjunction of threshold tests; lasso logistic
regression keeps few of them.  The kept rules are compiled into one Spark column expression, so scoring is a
projection over the statistics of all documents.

Null and empty texts are scored from zero counts like any other text.  Null labels and labels without a
document are not learned from; several labels of one id are all learned from.  Repeated documents get equal
scores.  Without any usable label every score is one half; with one class only, the share of that class.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from luxframe.llm.statistics import statistics
from luxframe.llm.textual import held_out, pick, scratch

SAMPLE = 20_000
TREES = 24
DEPTH = 3
LEAST_LEAF = 20
PENALTY = 2e-3
THRESHOLD = 0.3

_N = "greatest(n_words, 1)"
FEATURES = {
    "log_words": "ln(n_words + 1)",
    "word_size": f"word_chars / {_N}",
    "size_spread": "size_spread",
    "symbols": f"n_symbols / {_N}",
    "capitals": "n_upper / greatest(word_chars, 1)",
    "bangs": f"n_bangs / {_N}",
    "stops": f"n_stops / {_N}",
    "quotes": f"n_quotes / {_N}",
    "marks": f"n_marks / {_N}",
    "digits": f"n_digits / {_N}",
    "bars": f"n_bars / {_N}",
    "distinct": f"n_distinct / {_N}",
    "repeats": f"n_repeat_words / {_N}",
    "same_pairs": f"n_same_pairs / {_N}",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
}
Test = tuple[str, bool, float]  # feature, whether at or below, border


@dataclass
class Ensemble:
    """Intercept and weighted conjunctions."""

    intercept: float
    rules: list[tuple[tuple[Test, ...], float]]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for tests, weight in self.rules:
            met = F.lit(True)
            for name, below, border in tests:
                met = met & ((F.col(name) <= border) if below else (F.col(name) > border))
            total = total + F.when(met, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def features(docs: DataFrame) -> DataFrame:
    return statistics(docs, more=True).select("doc_id", *[F.expr(f"double({e})").alias(n) for n, e in FEATURES.items()])


def labelled_sample(table: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """At most ``limit`` labelled rows outside the held-out fold, those with the smallest hash of the id."""
    known = pick(labels, doc_id="long", quality="int").where("quality in (0, 1)").where(~held_out())
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(limit)
    return table.join(chosen, "doc_id").orderBy(F.xxhash64("doc_id"), "quality", *FEATURES).limit(limit)


def _best_split(x: np.ndarray, y: np.ndarray, columns: np.ndarray) -> tuple[int, float] | None:
    """Column and border with the largest drop of the Gini impurity, both sides large enough."""
    best, found = 1e-9, None
    n, total = len(y), y.sum()
    for j in columns:
        order = np.argsort(x[:, j], kind="stable")
        values, hits = x[order, j], np.cumsum(y[order])[:-1]
        left = np.arange(1, n)
        allowed = (values[1:] > values[:-1]) & (left >= LEAST_LEAF) & (n - left >= LEAST_LEAF)
        if not allowed.any():
            continue
        gain = hits**2 / left + (total - hits) ** 2 / (n - left) - total**2 / n
        gain[~allowed] = -1
        at = int(gain.argmax())
        if gain[at] / n > best:
            best, found = gain[at] / n, (int(j), float((values[at] + values[at + 1]) / 2))
    return found


def _paths(x: np.ndarray, y: np.ndarray, random: np.random.Generator, tests: tuple = (), depth: int = DEPTH) -> list:
    """Conjunctions of every node below the root of one tree."""
    if depth == 0 or len(y) < 2 * LEAST_LEAF or y.min() == y.max():
        return []
    names = list(FEATURES)
    columns = random.choice(len(names), max(2, len(names) // 3), replace=False)
    split = _best_split(x, y, columns)
    if split is None:
        return []
    j, border = split
    found = []
    for below in (True, False):
        side = (x[:, j] <= border) == below
        path = (*tests, (names[j], below, border))
        found += [path, *_paths(x[side], y[side], random, path, depth - 1)]
    return found


def _met(tests: tuple[Test, ...], x: np.ndarray) -> np.ndarray:
    names = list(FEATURES)
    met = np.ones(len(x), bool)
    for name, below, border in tests:
        met &= (x[:, names.index(name)] <= border) == below
    return met


def _lasso(rules: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for logistic loss with an unpenalised intercept."""
    n = len(y)
    design = np.column_stack([np.ones(n), rules])
    probe = np.ones(design.shape[1])
    for _ in range(30):
        probe = design.T @ (design @ probe)
        probe /= np.linalg.norm(probe)
    step = 4 * n / np.linalg.norm(design.T @ (design @ probe))
    weights = np.zeros(design.shape[1])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weights[0] = math.log(share / (1 - share))
    ahead, t = weights, 1.0
    for _ in range(steps):
        slope = design.T @ (1 / (1 + np.exp(-design @ ahead)) - y) / n
        moved = ahead - step * slope
        shrunk = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        shrunk[0] = moved[0]
        faster = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead = shrunk + (t - 1) / faster * (shrunk - weights)
        weights, t = shrunk, faster
    return float(weights[0]), weights[1:]


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, penalty: float = PENALTY, seed: int = 7) -> Ensemble:
    if len(y) == 0:
        return Ensemble(0.0, [])
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    if y.min() == y.max():
        return Ensemble(math.log(share / (1 - share)), [])
    random = np.random.default_rng(seed)
    paths: dict[bytes, tuple] = {}
    for _ in range(trees):
        drawn = random.integers(0, len(y), min(len(y), 4000))
        for tests in _paths(x[drawn], y[drawn], random):
            met = _met(tests, x)
            if 0 < met.sum() < len(y):  # of rules that agree on every row the shortest is enough
                paths.setdefault(np.packbits(met).tobytes(), tests)
    if not paths:
        return Ensemble(math.log(share / (1 - share)), [])
    rules = list(paths.values())
    intercept, weights = _lasso(np.column_stack([_met(r, x) for r in rules]).astype(float), y, penalty)
    return Ensemble(intercept, [(r, float(w)) for r, w in zip(rules, weights, strict=True) if w])


def learn(table: DataFrame, labels: DataFrame) -> Ensemble:
    rows = labelled_sample(table, labels).select("quality", *FEATURES).toPandas()
    return fit(rows[list(FEATURES)].to_numpy(float), rows["quality"].to_numpy(float))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    table = scratch(features(docs))
    score = learn(table, labels).score()
    return table.select("doc_id", held_out().alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )
