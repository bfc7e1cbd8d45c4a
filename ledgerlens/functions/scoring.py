"""Agreement, error classes and intervals, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tolerances, powers of ten that count as a wrong scale, statuses.
RELATIVE, ABSOLUTE = 0.005, 0.005
POWERS = (-9, -6, -3, -2, -1, 1, 2, 3, 6, 9)
UNPARSED = ("no_value_in_row", "unparseable_response")
UNRESOLVED = ("statement_not_found", "row_not_found", "column_unresolved", "no_value_in_row", "not_attempted")
OUTCOMES = ("correct", "scaling_error", "wrong_period", "wrong_row", "not_found", "parse_error")


def values_agree(predicted: Column, truth: Column, unit: Column) -> Column:
    apart = F.abs(predicted - truth)
    near = F.when(truth == 0, F.abs(predicted) <= ABSOLUTE).otherwise(F.try_divide(apart, F.abs(truth)) <= RELATIVE)
    return ((unit == "USD/shares") & (apart <= ABSOLUTE)) | near


def scaling_error(predicted: Column, truth: Column) -> Column:
    ratio = F.try_divide(predicted, truth)
    close = None
    for k in POWERS:
        p = F.lit(10.0**k)
        one = F.abs(ratio - p) <= RELATIVE * F.greatest(F.abs(ratio), p)
        close = one if close is None else close | one
    return (predicted != 0) & (truth != 0) & close


def classify(predicted: Column, status: Column, truth: Column, unit: Column, other_period: Column) -> Column:
    """The outcome of a cell; other_period: whether the company reported the predicted value for another period."""
    return (
        F.when(predicted.isNull(), F.when(status.isin(*UNPARSED), "parse_error").otherwise("not_found"))
        .when(values_agree(predicted, truth, unit), "correct")
        .when(scaling_error(predicted, truth), "scaling_error")
        .when(other_period, "wrong_period")
        .otherwise("wrong_row")
    )


def wilson(successes: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The score interval's ends, within 0 and 1; null without a case."""
    n = F.when(total > 0, total.cast("double"))
    p = successes / n
    whole = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / whole
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / whole
    return F.when(n.isNotNull(), F.greatest(F.lit(0.0), centre - margin)), F.when(n.isNotNull(), F.least(F.lit(1.0), centre + margin))
