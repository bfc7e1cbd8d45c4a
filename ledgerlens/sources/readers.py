"""Readers and writers: raw files, JSON documents, CSV and Parquet tables."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def raw_pages(spark: SparkSession, path: str, glob: str = "*.htm*") -> DataFrame:
    """(doc_id, html, doc_bytes) of each file: UTF-8, or Latin-1 where that fails. The id is the file's name without its end."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    text = F.coalesce(F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    return files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("doc_id"), text.alias("html"), F.col("length").alias("doc_bytes"))


#: Kinds of failure of a landed document, in the order in which they are told.
FAILURES = ("missing", "ambiguous", "empty", "not_html")


def document_status(index: DataFrame, pages: DataFrame) -> DataFrame:
    """The index with doc_bytes and doc_status: ok, or failed with its kind.

    missing: no file was landed; ambiguous: several files of one id; empty: no byte; not_html: no tag in it
    (told only if `pages` has html). Every row of the index stays once.
    """
    plain = ~F.coalesce(F.max(F.col("html").rlike("<[a-zA-Z!/?]")), F.lit(False)) if "html" in pages.columns else F.lit(False)
    landed = pages.groupBy("doc_id").agg(F.max("doc_bytes").alias("doc_bytes"), F.count("*").alias("_files"), plain.alias("_plain"))
    out = index.join(landed, "doc_id", "left")
    kind = F.when(F.col("_files").isNull(), "missing").when(F.col("_files") > 1, "ambiguous").when(F.col("doc_bytes") == 0, "empty").when(F.col("_plain"), "not_html")
    return out.withColumn("doc_status", F.coalesce(F.concat(F.lit("failed: "), kind), F.lit("ok"))).drop("_files", "_plain").fillna(0, ["doc_bytes"])


def failed(kind: str, status: str = "doc_status") -> F.Column:
    return F.col(status) == f"failed: {kind}"


def prepared_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SAMPLE).json(path, multiLine=True)


def cut_samples(prepared: DataFrame, filings: DataFrame, most_text: int = 4000) -> DataFrame:
    """The last filing of each ticker, its statement tables only, and the text's beginning."""
    last = filings.groupBy("ticker").agg(F.max_by("doc_id", "report_date").alias("doc_id"))
    tables = F.filter("tables", lambda t: t["statement"].isNotNull())
    return prepared.join(last, "doc_id").withColumn("tables", tables).withColumn("text", F.substring("text", 1, most_text))


def company_facts(spark: SparkSession, path: str, taxonomy: str = "us-gaap") -> DataFrame:
    """Facts (schemas.FACTS) of company files {"cik": ..., "facts": {taxonomy: {concept: {units: {unit: [...]}}}}}."""
    raw = spark.read.schema(f"cik bigint, facts {schemas.COMPANY_FACTS}").json(path, multiLine=True)
    concepts = raw.select("cik", F.explode(F.try_element_at("facts", F.lit(taxonomy))).alias("concept", "entry"))
    units = concepts.select("cik", "concept", F.explode("entry.units").alias("unit", "list"))
    each = units.select("cik", "concept", "unit", F.posexplode("list").alias("ordinal", "f"))
    day = lambda c: F.try_to_date(F.col(c), "yyyy-MM-dd")
    return each.select("cik", "concept", "unit", day("f.start").alias("start"), day("f.end").alias("end"), "f.val", "f.accn", "f.form", "f.fy", "f.fp", F.col("ordinal").cast("long"))


def submissions(spark: SparkSession, path: str) -> DataFrame:
    """One row for each filing of histories kept as parallel arrays, with those of the overflow pages that a history names.

    Pages lie in one folder; the cik comes from the file's name (its first digits). Company and ticker stand on
    the main page.
    """
    raw = spark.read.schema(schemas.SUBMISSIONS).json(path, multiLine=True).withColumn("_file", F.col("_metadata.file_name")).withColumn("cik", F.regexp_extract("_file", r"(\d+)", 1).cast("long"))
    main, more = raw.where("filings is not null"), raw.where("filings is null")
    named = main.select(F.explode("filings.files.name").alias("_file")).distinct()
    names = {"accessionNumber": "accession", "form": "form", "filingDate": "filing_date", "reportDate": "report_date", "primaryDocument": "primary_document", "isInlineXBRL": "is_inline_xbrl"}

    def rows(pages: DataFrame, at: str) -> DataFrame:
        zipped = F.arrays_zip(*[F.coalesce(F.col(at + k), F.array().cast("array<string>" if k != "isInlineXBRL" else "array<int>")).alias(v) for k, v in names.items()])
        return pages.select("cik", F.inline(zipped))

    companies = main.select("cik", F.col("name").alias("company"), F.coalesce(F.get("tickers", 0), F.lit("")).alias("ticker")).dropDuplicates(["cik"])
    each = rows(main, "filings.recent.").unionByName(rows(more.join(named, "_file", "left_semi"), "")).join(companies, "cik")
    day = lambda c: F.try_to_date(F.col(c), "yyyy-MM-dd").alias(c)
    return each.select("cik", "company", "ticker", "form", day("filing_date"), day("report_date"), "accession", F.coalesce("primary_document", F.lit("")).alias("primary_document"), F.coalesce("is_inline_xbrl", F.lit(0)).alias("is_inline_xbrl"))


def filing_index(filings: DataFrame, form: str = "10-K", years: tuple[int, int] = (2019, 2024)) -> DataFrame:
    """Filings of a form and a range of report years with an HTML document; the earliest of each company and period."""
    from pyspark.sql import Window

    fit = filings.where((F.col("form") == form) & F.year("report_date").between(*years) & F.lower("primary_document").rlike(r"\.html?$"))
    w = Window.partitionBy("cik", "report_date").orderBy("filing_date", "accession")
    first = fit.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return first.withColumn("doc_id", document_key("cik", "accession"))


def document_key(cik: str, accession: str) -> F.Column:
    return F.format_string("%010d_%s", F.col(cik), F.col(accession))


def json_config(spark: SparkSession, path: str) -> dict:
    """A small JSON file, read through Spark's file systems."""
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))


def pricing(spark: SparkSession, rates: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(m, a, b) for m, (a, b) in rates.items()], schemas.PRICING))


def dotenv(path: str) -> dict[str, str]:
    """KEY=VALUE lines into the environment; what is set already stays."""
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            key, eq, value = line.strip().partition("=")
            if eq and not key.startswith("#"):
                out[key.strip()] = os.environ.setdefault(key.strip(), value.strip().strip("'\""))
    return out


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def universe(spark: SparkSession, path: str) -> DataFrame:
    """(cik, ticker, name) of the companies in a configuration file: a list of objects, alone or under "companies"."""
    found = json_config(spark, path)
    rows = found.get("companies", []) if isinstance(found, dict) else found
    return spark.createDataFrame([(int(x["cik"]), x.get("ticker"), x.get("name")) for x in rows], "cik long, ticker string, name string")


def export_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One CSV file with a header, for result tables of a few rows."""
    (df.orderBy(*order) if order else df).coalesce(1).write.mode("overwrite").csv(path, header=True)


def save(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a table as Parquet and read it back: later steps start from the files."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def save_by_company(df: DataFrame, path: str, buckets: int = 64, key: str = "cik") -> DataFrame:
    """A table stored in buckets of companies, sorted in them, one file each: joins and groupings by company need no shuffle.

    Tables that are used together need one number of buckets: so many that one fits a task. A company stays in one bucket; where
    one has a large share of all rows, plain tables do better, whose joins Spark can split. Needs the settings of session.session.
    """
    spark = df.sparkSession
    name = "by_company_" + hashlib.sha256(path.encode()).hexdigest()[:16]
    spark.sql(f"drop table if exists {name}")
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)
