"""The report: every table of one evaluation, for all cells and for each split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import failures, hybrid, score, split, stats


def evaluate(rules: DataFrame, model: DataFrame | None, truth: DataFrame, all_periods: DataFrame, splits: DataFrame, whole_runs: bool = True) -> DataFrame:
    """Scored cells of the rules, the model and their combination, with split and costs."""
    each = [rules] if model is None else [rules, model, hybrid.combine(rules, model, whole_runs)]
    names = stats.METHODS[: len(each)]
    named = [p.withColumn("method", F.coalesce("method", F.lit(n))) for p, n in zip(each, names, strict=True)]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
    return split.attach_split(score.score(together, truth, all_periods, methods=names), splits, "cik")


def tables(scored: DataFrame, latency: DataFrame, suffix: str = "") -> dict[str, DataFrame]:
    return {
        f"accuracy_by_field{suffix}": stats.accuracy(scored, "method", "field").orderBy("method", "field"),
        f"failure_breakdown{suffix}": stats.failure_breakdown(scored).orderBy("method", "field", "outcome"),
        f"accuracy_overall{suffix}": stats.accuracy(scored, "method", n="cells").orderBy("method"),
        f"comparison{suffix}": stats.cost_summary(scored, latency),
        f"outcome_mix{suffix}": stats.outcome_mix(scored),
    }


def build_report(scored: DataFrame, latency: DataFrame, prepared: DataFrame | None = None) -> dict[str, DataFrame]:
    out = tables(scored, latency)
    for part in ("dev", "test"):
        cells = scored.where(f"split = '{part}'")
        out |= tables(cells, latency.join(cells.select("doc_id", "field").distinct(), ["doc_id", "field"], "left_semi"), f"_{part}")
    out["split_summary"] = stats.split_summary(scored)
    if "run_label" in scored.columns:
        out["run_variation"] = stats.run_variation(scored)
    if prepared is not None:
        out["failure_sample"] = failures.annotate(failures.sample_failures(scored), prepared)
    return out
