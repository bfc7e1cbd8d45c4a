"""Labels from reported facts: for each filing and field the value that the filing reports for its own period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import FIELDS, Field

DAYS = (300, 400)
#: Why a cell has no label.
REASONS = ("no_concept_present", "no_fact_in_filing", "no_period_end_match", "no_annual_duration", "conflicting_values")


def concept_table(spark: SparkSession, fields: list[Field] = FIELDS) -> DataFrame:
    """(field, unit, duration, position, concept): a few rows for each field, so joins broadcast it."""
    rows = [(f.key, f.unit, f.period_type == "duration", k, c) for f in fields for k, c in enumerate(f.concepts)]
    return F.broadcast(spark.createDataFrame(rows, "field string, unit string, duration boolean, position int, concept string"))


def is_annual(start: Column, end: Column) -> Column:
    return F.coalesce(F.datediff(end, start).between(*DAYS), F.lit(False))


def concept_candidates(filings: DataFrame, facts: DataFrame, concepts: DataFrame) -> DataFrame:
    """(cik, doc_id, field, position, concept, unit, value, reason) of each concept that the company has facts for.

    Every grouping and join has the company among its keys: of tables laid out by company (readers.save_by_company) nothing is
    shuffled, of others the facts once, and once more the distinct concepts of each company.

    In order: facts of the same filing, of its period end, of about a year (or, for instants, those
    without a start if there are any); different values are a conflict, else the first fact counts.
    """
    keyed = facts.join(concepts, ["concept", "unit"])
    what = ["field", "position", "concept", "unit", "duration"]
    own = filings.select("doc_id", "cik", "accession", "report_date").join(keyed.withColumnRenamed("accn", "accession"), ["cik", "accession"])
    ends = F.col("end") == F.col("report_date")
    annual = ends & is_annual(F.col("start"), F.col("end"))
    instant = ends & F.col("start").isNull()
    rounded = F.round("val", 6)
    marked = own.groupBy("cik", "doc_id", *what).agg(
        F.count_if(ends).alias("n_ends"),
        F.count_if(annual).alias("n_annual"),
        F.count_if(instant).alias("n_instant"),
        *[(F.min(F.when(c, rounded)) < F.max(F.when(c, rounded))).alias(f"d_{n}") for n, c in (("annual", annual), ("instant", instant), ("ends", ends))],
        *[F.min_by(F.when(c, F.col("val")), F.when(c, F.col("ordinal"))).alias(f"v_{n}") for n, c in (("annual", annual), ("instant", instant), ("ends", ends))],
    )
    tried = filings.select("doc_id", "cik").join(keyed.select("cik", *what).distinct(), "cik")
    marked = tried.join(marked.withColumn("n_same", F.lit(1)), ["cik", "doc_id", *what], "left")
    use = F.when(F.col("duration"), "annual").when(F.col("n_instant") > 0, "instant").otherwise("ends")
    pick = lambda k: F.when(use == "annual", F.col(f"{k}_annual")).when(use == "instant", F.col(f"{k}_instant")).otherwise(F.col(f"{k}_ends"))
    reason = (
        F.when(F.col("n_same").isNull(), "no_fact_in_filing").when(F.col("n_ends") == 0, "no_period_end_match").when(F.col("duration") & (F.col("n_annual") == 0), "no_annual_duration")
        .when(pick("d"), "conflicting_values").otherwise("ok")
    )
    return marked.select("cik", "doc_id", "field", "position", "concept", "unit", reason.alias("reason"), F.when(reason == "ok", pick("v")).alias("value"))


def build_labels(filings: DataFrame, facts: DataFrame, fields: list[Field] = FIELDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(truth, misses, coverage). The first acceptable concept gives the value; a miss tells the first concept's reason."""
    spark = filings.sparkSession
    tried = concept_candidates(filings, facts, concept_table(spark, fields))
    good = F.col("reason") == "ok"
    best = tried.groupBy("cik", "doc_id", "field").agg(
        F.min_by(F.when(good, F.struct("concept", "unit", "value")), F.when(good, F.col("position"))).alias("best"), F.min_by("reason", "position").alias("reason")
    )
    wanted = filings.crossJoin(F.broadcast(spark.createDataFrame([(f.key,) for f in fields], "field string")))
    cells = wanted.join(best, ["cik", "doc_id", "field"], "left")
    truth = cells.where("best is not null").select("doc_id", "cik", "company", "ticker", "report_date", "filing_date", "accession", "field", "best.concept", "best.unit", F.col("best.value").alias("true_value"))
    misses = cells.where("best is null").select("doc_id", "company", "report_date", "field", F.coalesce("reason", F.lit("no_concept_present")).alias("reason"))
    return truth, misses, coverage(filings, truth, len(fields))


def coverage(filings: DataFrame, truth: DataFrame, n_fields: int) -> DataFrame:
    found = truth.groupBy("doc_id").agg(F.count("*").alias("fields_found"))
    out = filings.select("doc_id", "company", "ticker", "report_date", "accession").join(found, "doc_id", "left").fillna(0, ["fields_found"])
    return out.withColumn("complete", F.col("fields_found") == n_fields)


def all_period_values(facts: DataFrame, fields: list[Field] = FIELDS, form: str = "10-K") -> DataFrame:
    """(cik, field, period_end, value): every annual value, or value at a date, that a company reported for a field."""
    keyed = facts.join(concept_table(facts.sparkSession, fields), ["concept", "unit"])
    fits = F.when(F.col("duration"), is_annual(F.col("start"), F.col("end"))).otherwise(F.col("start").isNull())
    return keyed.where((F.col("form") == form) & F.col("end").isNotNull() & fits).select("cik", "field", F.col("end").alias("period_end"), F.col("val").alias("value")).distinct()


def concept_match_counts(truth: DataFrame) -> DataFrame:
    from .stats import with_share

    return with_share(truth.groupBy("field", "concept").agg(F.count("*").alias("filings")), "filings", ["field"])


def miss_reasons(misses: DataFrame) -> DataFrame:
    return misses.groupBy("reason").agg(F.count("*").alias("cells"))
