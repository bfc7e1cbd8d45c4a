"""A sample of wrong cells with the printed rows around what was read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import FIELDS, Field
from .extract import statement_tables
from .split import sample_per_group

PER_GROUP, AROUND, MOST_TEXT = 4, 2, 400


def sample_failures(scored: DataFrame, per_group: int = PER_GROUP, seed: int = 0) -> DataFrame:
    return sample_per_group(scored.where(~F.col("correct")), ["method", "outcome"], per_group, seed, ["doc_id", "field"])


def annotate(sample: DataFrame, prepared: DataFrame, fields: list[Field] = FIELDS) -> DataFrame:
    """Adds statement_table, read_row and nearby_rows (the labels up to two rows away, or all labels cut to 400 letters)."""
    wanted = prepared.join(sample.select("doc_id").distinct(), "doc_id", "left_semi")
    return annotate_from(sample, statement_tables(wanted.select("doc_id", F.inline("tables"))), fields)


def annotate_from(sample: DataFrame, picked: DataFrame, fields: list[Field] = FIELDS) -> DataFrame:
    """`annotate` with the tables of `statement_tables`, for a sample whose answers were read from the same ones."""
    spark = sample.sparkSession
    if "matched_label" not in sample.columns:
        sample = sample.withColumn("matched_label", F.lit(None).cast("string"))
    statements = F.broadcast(spark.createDataFrame([(f.key, f.statement) for f in fields], "field string, wanted string"))
    out = sample.join(statements, "field", "left").join(picked, ["doc_id", "wanted"], "left")
    t = F.col("table")
    at = F.array_position(t["labels"], F.replace(F.col("matched_label"), F.lit("[section] "), F.lit("")))  # from 1; 0 is nowhere
    shown = lambda a: F.array_join(F.filter(a, lambda x: F.trim(x) != ""), " // ")
    low = F.greatest(at.cast("int") - AROUND, F.lit(1))
    near = shown(F.slice(t["labels"], low, at.cast("int") + AROUND - low + 1))
    found = F.coalesce(at > 0, F.lit(False))
    return out.select(
        *sample.columns,
        t["index"].alias("statement_table"),
        F.when(found, F.array_join(F.filter(F.get(t["rows"], at.cast("int") - 1), lambda c: F.trim(c) != ""), " | ")).alias("read_row"),
        F.when(found, near).otherwise(F.substring(shown(t["labels"]), 1, MOST_TEXT)).alias("nearby_rows"),
    )
