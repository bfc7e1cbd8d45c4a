"""Routing: rules' answers stay, a model's fill the cells that the rules left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import UNRESOLVED

COSTS = ("seconds", "input_tokens", "output_tokens", "usd")


def abstained() -> Column:
    return F.col("predicted").isNull() | F.coalesce(F.col("status").isin(*UNRESOLVED), F.lit(False))


def gaps(rules: DataFrame) -> DataFrame:
    """(doc_id, fields): the cells a run left, by document, sorted."""
    return rules.where(abstained()).groupBy("doc_id").agg(F.sort_array(F.collect_list("field")).alias("fields"))


def combine(rules: DataFrame, model: DataFrame, whole_runs: bool = True) -> DataFrame:
    """Resolved rules cells, model cells for the gaps (with the rules attempt's cost added), and gaps that neither filled.

    whole_runs: every run of the model gives a complete set of cells, rules cells being repeated for
    each; without it rules cells appear once with no run, so that gaps weigh as often as there are runs.
    """
    keys = ["doc_id", "field"]
    left = rules.where(abstained())
    resolved = rules.where(~abstained())
    if whole_runs:
        runs = F.broadcast(model.select("run_label").distinct())  # one row for each run
        resolved, left = (x.drop("run_label").crossJoin(runs) for x in (resolved, left))
        keys.append("run_label")
    cost = left.select(*keys, *[F.coalesce(F.col(c), F.lit(0.0)).alias(f"_{c}") for c in COSTS])
    filled = model.join(cost, keys).withColumns({c: F.col(c) + F.col(f"_{c}") for c in COSTS}).drop(*[f"_{c}" for c in COSTS])
    missing = left.join(filled.select(*keys).distinct(), keys, "left_anti")
    out = resolved.unionByName(filled, allowMissingColumns=True).unionByName(missing, allowMissingColumns=True)
    return out.withColumn("method", F.lit("hybrid"))
