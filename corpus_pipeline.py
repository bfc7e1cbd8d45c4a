"""The training-data pipeline over documents: toxicity, near-duplicates, decontamination, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, neardup, packing, pii, toxicity
from ledgerlens.llm.common import materialize, table
from ledgerlens.llm.queries import WORDS


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier rejects go; it is fitted on the labels outside the held-out fold.

    Null and empty texts are scored as texts without a telling word and stay; rows that repeat a text go or stay together.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component stays: that with the smallest doc_id, one without an id only if no other is there.

    Every row is compared by its own text, whatever its id. Of rows that repeat the id that stays one stays, be their
    texts equal or only near. Null and empty texts are near nothing and stay; no rows give no rows.
    """
    columns = docs.columns
    free = "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in columns))  # names that no column of the user has
    row, none = free + "row", free + "none"
    docs = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = neardup.near_duplicates(docs, id_col=row).select(F.col("doc_id").alias(row), "component_id")
    keys = docs.select(row, F.col("doc_id").isNull().alias(none), "doc_id").join(found, row)
    least = keys.groupBy("component_id").agg(F.min(F.struct(none, "doc_id", row)).alias("k"))
    return docs.join(least.select(f"k.{row}"), row, "left_semi").select(columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item or a part of one go.

    Each row is judged by its own text: null and empty texts stay, rows that repeat a text go or stay together.
    """
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data in its text becomes [EMAIL], [IP], [CARD] or [PHONE], and n_chars follows.

    Null texts stay null, empty ones empty; rows that repeat an id or a text each keep theirs.
    """
    redacted = pii.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else redacted


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's length bucket, batch and slot.

    Null and empty texts have one token; rows that repeat an id or a text each get a place; ties in length go by doc_id.
    """
    return packing.pack(docs, WORDS)


STAGES = [("toxicity", not_toxic), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("personal_data", without_personal_data), ("packing", packed)]
#: The stages use trained models, hashing and dynamic programming, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
