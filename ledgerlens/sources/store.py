"""Prepared documents that are parsed once: a store keyed by document, content digest and parser version.

The store is a Parquet folder partitioned by parser and batch. A run reads only the keys of what is stored (two
short columns), parses the pages that are not there, and writes them as one more batch, named by what it holds:
a run that broke off and is run again overwrites its own batch and no other. Documents of one page, older
contents and older parsers stay until `compact` rewrites the store with what is wanted.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from . import html

KEY = ["doc_id", "digest"]
#: The store's columns; the version of the parser goes up with every change of what it gives.
STORED, PARSER = schemas.PREPARED.replace(",scale_phrase:string", "") + ", digest string", "1"


def version(once: bool = False) -> str:
    return PARSER + "-once" * once


def stored(spark: SparkSession, path: str, parser: str) -> DataFrame:
    """What the store holds of a parser's, each key once per batch; an absent store is empty."""
    try:
        return spark.read.schema(STORED + ", parser string, batch string").parquet(path).where(F.col("parser") == parser)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED + ", parser string, batch string")


def keyed(pages: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """(doc_id, html, digest): the digest of a null page is that of an empty one."""
    return pages.select(F.col(f"`{id_col}`").cast("string").alias("doc_id"), F.col(f"`{html_col}`").alias("html"), F.sha2(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), 256).alias("digest"))


def prepare(pages: DataFrame, path: str, once: bool = False, id_col: str = "doc_id", html_col: str = "html") -> tuple[DataFrame, dict[str, int]]:
    """(prepared documents of these pages, counters). Only pages that the store lacks are parsed.

    Counters: parsed and broken (pages whose parse gave no text), tables and ix_facts_removed of those, all told by the job that
    writes them. Pages of one id and content count once; pages without an id are not kept. `pages` is read twice, for
    keys and for what is new, so it should be a table and not the end of a long plan.
    """
    spark = pages.sparkSession
    parser = version(once)
    page = keyed(pages, id_col, html_col).where("doc_id is not null")
    known = stored(spark, path, parser).select(*KEY)
    new = page.join(known, KEY, "left_anti").dropDuplicates(KEY)
    name = new.agg(F.hex(F.bit_xor(F.xxhash64(*KEY))).alias("batch"), F.count("*").alias("n")).first()
    counted = {"parsed": 0, "broken": 0, "tables": 0, "ix_facts_removed": 0}
    if name.n:
        told = Observation()
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        made = html.prepare(new.select("doc_id", "html", "digest"), once=once, carry=("digest",)).observe(
            told, F.count(F.lit(1)).alias("parsed"), F.count_if((F.length("text") == 0) & (F.col("raw_chars") > 0)).alias("broken"), total(F.size("tables")).alias("tables"), total("ix_facts_removed").alias("ix_facts_removed")
        )
        made = made.withColumns({"parser": F.lit(parser), "batch": F.lit(name.batch)})
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("parser", "batch").parquet(path)
        counted = {k: int(v) for k, v in told.get.items()}
    return current(stored(spark, path, parser), page.select(*KEY)), counted


def current(held: DataFrame, keys: DataFrame) -> DataFrame:
    """The stored documents of these keys: the keys are short, so the documents are not shuffled while keys can be broadcast."""
    return held.join(keys.distinct(), KEY, "left_semi").drop("digest", "parser", "batch")


def compact(spark: SparkSession, path: str, into: str, keys: DataFrame, once: bool = False) -> None:
    """A new store at `into` that holds only the documents of these keys (doc_id, digest), in one batch."""
    held = stored(spark, path, version(once)).join(keys.select(*KEY).distinct(), KEY, "left_semi")
    held.withColumn("batch", F.lit("all")).write.mode("overwrite").partitionBy("parser", "batch").parquet(into)
