"""Grouped statistics of scored cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import OUTCOMES, wilson

METHODS = ("rules", "llm", "hybrid")


def with_share(counts: DataFrame, n: str, by: list[str], half_even: bool = True) -> DataFrame:
    """Each count's share of its group's total, to four places."""
    share = F.col(n) / F.sum(n).over(Window.partitionBy(*by))
    return counts.withColumn("share", (F.bround if half_even else F.round)(share, 4))


def accuracy(scored: DataFrame, *by: str, n: str = "n") -> DataFrame:
    """Cells, correct ones, accuracy and its interval, by any columns."""
    out = scored.groupBy(*by).agg(F.count("*").alias(n), F.count_if("correct").alias("correct"))
    low, high = wilson(F.col("correct"), F.col(n))
    return out.withColumn("accuracy", F.col("correct") / F.col(n)).withColumn("ci_low", low).withColumn("ci_high", high)


def failure_breakdown(scored: DataFrame) -> DataFrame:
    return with_share(scored.groupBy("method", "field", "outcome").agg(F.count("*").alias("cells")), "cells", ["method", "field"])


def method_rank(method: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, METHODS)), method)
    return F.when(at > 0, at - 1).otherwise(99)


def cost_summary(scored: DataFrame, latency: DataFrame) -> DataFrame:
    """Accuracy, answers, money, time and tokens by method. latency: method, seconds."""
    usd = F.sum("usd")
    low, high = wilson(F.col("correct"), F.col("cells"))
    base = scored.groupBy("method").agg(
        F.count_distinct("doc_id").alias("filings"), F.count("*").alias("cells"), F.count_if("correct").alias("correct"),
        F.count_if(F.col("outcome") != "not_found").alias("answered"), F.when(usd > 0, usd).alias("usd"), F.coalesce(F.sum("input_tokens"), F.lit(0.0)).alias("tokens"),
    )
    seconds = latency.groupBy("method").agg(F.sum("seconds").alias("seconds"))
    out = base.join(seconds, "method", "left").select(
        "method", "filings", "cells", "correct", (F.col("correct") / F.col("cells")).alias("accuracy"), low.alias("ci_low"), high.alias("ci_high"),
        (F.col("answered") / F.col("cells")).alias("answer_rate"), F.try_divide("correct", "answered").alias("precision_when_answering"),
        (F.col("seconds") / F.col("filings")).alias("seconds_per_filing"), (F.col("usd") / F.col("filings")).alias("usd_per_filing"),
        F.try_divide("usd", "correct").alias("usd_per_correct_field"), (F.col("tokens") / F.col("filings")).alias("input_tokens_per_filing"),
    )
    return out.orderBy(method_rank(F.col("method")), "method")


def run_variation(scored: DataFrame) -> DataFrame:
    """Accuracy of each labelled run beside its method's least, greatest, mean, deviation and spread."""
    runs = scored.where("run_label is not null").groupBy("method", "run_label").agg(F.count("*").alias("cells"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    w = Window.partitionBy("method")
    a = F.col("accuracy")
    out = runs.withColumn("min", F.min(a).over(w)).withColumn("max", F.max(a).over(w)).withColumn("mean", F.avg(a).over(w)).withColumn("std", F.stddev_samp(a).over(w))
    return out.withColumn("spread", F.col("max") - F.col("min"))


def split_summary(scored: DataFrame) -> DataFrame:
    """Mean accuracy by method and split, and by method (split is null) alone."""
    return scored.groupingSets([["method", "split"], ["method"]], "method", "split").agg(F.count("*").alias("cells"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def outcome_mix(scored: DataFrame) -> DataFrame:
    """Each method's outcomes as shares, one column for each outcome."""
    counts = scored.groupBy("method").pivot("outcome", list(OUTCOMES)).count().fillna(0)
    total = sum((F.col(o) for o in OUTCOMES), F.lit(0))
    return counts.select("method", *[(F.col(o) / total).alias(o) for o in OUTCOMES])


def digest_parts(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """(by, n, s0 .. s3): rows and the sums of their hashes' parts, the same for any order and partitioning."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]), 256)
    parts = [F.sum(F.conv(F.substring("_row", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)]
    return df.select(*by, row.alias("_row")).groupBy(*by).agg(F.count("*").alias("n"), *parts)


def digest(df: DataFrame, columns: list[str]) -> str:
    """One hash of a table's rows; only the hashes' sums leave the executors."""
    return "-".join(str(x) for x in digest_parts(df, columns).first())
