"""Predictions against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import classify
from .nearby import with_other_period


def score(predictions: DataFrame, truth: DataFrame, all_periods: DataFrame, method: str | None = None, methods: tuple[str, ...] = ()) -> DataFrame:
    """Every label with each prediction for it (one null one if there is none), its outcome and whether it is correct.

    methods: for predictions of several methods at once; then every label meets each of them.
    """
    keys = ["doc_id", "field", *["method"] * bool(methods)]
    carried = [c for c in predictions.columns if c not in truth.columns or c in keys]
    if methods:
        truth = truth.crossJoin(F.broadcast(truth.sparkSession.createDataFrame([(m,) for m in methods], "method string")))
    cells = truth.join(predictions.select(*carried), keys, "left")
    cells = cells.withColumn("status", F.coalesce("status", F.lit("not_attempted")))
    if method:
        cells = cells.withColumn("method", F.coalesce("method", F.lit(method)))
    cells = with_other_period(cells, all_periods, ["cik", "field"], "report_date", "predicted", F.col("unit"), "_past", "period_end", "value")
    out = cells.withColumn("outcome", classify(F.col("predicted"), F.col("status"), F.col("true_value"), F.col("unit"), F.col("_past"))).drop("_past")
    return out.withColumn("correct", F.col("outcome") == "correct")


def attach_costs(scored: DataFrame, costs: DataFrame, per_run: bool = True) -> DataFrame:
    """Adds seconds, tokens and money. per_run=False joins without the run label, which repeats a cell's total in each run."""
    keys = ["doc_id", "field", "method"] + ["run_label"] * per_run
    names = ("seconds", "input_tokens", "output_tokens", "usd")
    total = costs.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in names])
    left = scored.drop(*names)
    on = None
    for k in keys:
        one = left[k].eqNullSafe(total[k])
        on = one if on is None else on & one
    return left.join(total, on, "left").select(*[left[c] for c in left.columns], *[total[c] for c in names])
