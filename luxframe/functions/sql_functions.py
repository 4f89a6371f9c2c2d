"""Functions of the engine for SQL text, defined in SQL so that they stay inside the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

from luxframe.functions.decay import DW_TERMS


def _bound_cases() -> str:
    cases = []
    for level, rows in DW_TERMS.items():
        for numexp, (b1, b2, b3, b4) in enumerate(rows, 1):
            terms = f"2 + {b1}D / sqrt(n) + {b2}D / n + {b3}D / (sqrt(n) * sqrt(n) * sqrt(n)) + {b4}D / (n * n)"
            cases.append(f"WHEN level = {level} AND numexp = {numexp} THEN bround({terms}, 3)")
    return "\n".join(cases)


def register(spark: SparkSession) -> None:
    """Make the functions visible to SQL text of this session; calling again changes nothing."""
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION dw_bound(n DOUBLE, numexp INT, level INT) RETURNS DOUBLE
COMMENT 'Lower Durbin-Watson bound at 5 or 1 percent for a decay of n channels and numexp lifetimes; null otherwise'
RETURN CASE {_bound_cases()} END""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION dw_normal_bound(n DOUBLE, deviations DOUBLE) RETURNS DOUBLE
COMMENT 'Durbin-Watson bound from the normal approximation: 3 deviations are 0.3 percent, 3.28 are 0.1 percent'
RETURN bround(2 - deviations * sqrt(4 * n * n * (n - 2) / ((n + 1) * power(n - 1, 3))), 3)""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION weighted_residual(counts DOUBLE, model DOUBLE) RETURNS DOUBLE
COMMENT 'Difference of model and counts in standard deviations of the model'
RETURN (model - counts) / sqrt(abs(model))""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION average_lifetime(tau ARRAY<DOUBLE>, amp ARRAY<DOUBLE>) RETURNS DOUBLE
COMMENT 'Mean of the lifetimes weighted by their amplitudes'
RETURN try_divide(aggregate(zip_with(tau, amp, (t, a) -> t * a), 0D, (s, x) -> s + x), aggregate(amp, 0D, (s, x) -> s + x))""")
