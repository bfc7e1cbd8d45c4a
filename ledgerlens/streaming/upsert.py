"""Re-filed documents as a stream: of each company and period the newest version counts, however late it comes.

The state of a key is its newest version, not the document: the stateful operator sees narrow rows, and the
batch reads the files of the versions that won. What each batch takes in is a partition of its own, so that a
batch run again replaces what it had written; `latest` is the view of what counts now.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schemas
from ..operators.extract import extract

KEY = ["cik", "report_date"]
FILED = schemas.PREPARED + ", cik bigint, report_date date, filing_date date, accession string"
CHANGES = "cik bigint, report_date date, version string, doc_id string, file string, kind string"
#: Settings that the session needs: the state store of transformWithState, and no batches without data, in which timers
#: of the processing time would keep a query that should end running; timers run out with the next batch instead.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class Newest(StatefulProcessor):
    """Passes on a version that is newer than all before it of its key; `settle_ms` after the last one the key is final and forgotten."""

    def __init__(self, settle_ms: int):
        self.settle_ms = settle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.version = handle.getValueState("version", "version string, doc_id string, file string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.version.get()[0] if self.version.exists() else ""
        best = None
        for part in rows:
            top = part.loc[part["version"].idxmax()]
            if top["version"] > (best["version"] if best is not None else held):
                best = top
        if best is None:
            return
        self.version.update((best["version"], best["doc_id"], best["file"]))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.settle_ms)
        yield self._row(key, best["version"], best["doc_id"], best["file"], "upsert" if not held else "correction")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.version.exists():
            version, doc_id, file = self.version.get()
            self.version.clear()
            yield self._row(key, version, doc_id, file, "final")

    def _row(self, key, *rest) -> pd.DataFrame:
        return pd.DataFrame([(*key, *rest)], columns=[x.split()[0] for x in CHANGES.split(", ")])

    def close(self) -> None:
        pass


def filed_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """(cik, report_date, version, doc_id, file) of prepared documents as their files appear; versions order by filing date, then accession."""
    stream = spark.readStream.schema(FILED).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    version = F.concat_ws(" ", F.date_format("filing_date", "yyyy-MM-dd"), "accession")
    return stream.where("cik is not null and report_date is not null").select(*KEY, version.alias("version"), "doc_id", F.col("_metadata.file_path").alias("file"))


def changes(filed: DataFrame, settle_ms: int = 400 * 86_400_000) -> DataFrame:
    """The versions of `filed` that count (kind: upsert, correction), and keys that take no more (final). Late versions are never dropped unseen."""
    return filed.groupBy(*KEY).transformWithStateInPandas(Newest(settle_ms), CHANGES, outputMode="Update", timeMode="ProcessingTime")


def upsert_stream(changed: DataFrame, out: str, checkpoint: str, answers: Callable[[DataFrame, DataFrame], DataFrame] = extract):
    """A query that writes the answers of each batch's winning versions, and their changes, under the batch's number."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{out}/changes/batch={number}")
        told = spark.read.schema(CHANGES).parquet(f"{out}/changes/batch={number}")
        won = told.where("kind <> 'final'")
        files = [r.file for r in won.select("file").distinct().collect()]  # as many as a trigger takes files at most
        if not files:
            return
        documents = spark.read.schema(FILED).parquet(*files).withColumn("version", F.concat_ws(" ", F.date_format("filing_date", "yyyy-MM-dd"), "accession"))
        documents = documents.join(won.select(*KEY, "version", "doc_id"), [*KEY, "version", "doc_id"], "left_semi").dropDuplicates([*KEY, "version", "doc_id"])
        found = answers(documents, documents.select("doc_id", "report_date"))
        named = documents.select("doc_id", "report_date", "cik", "version")
        found.join(named, "doc_id").write.mode("overwrite").parquet(f"{out}/answers/batch={number}")

    return changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The answers of each key's newest version."""
    found = spark.read.parquet(f"{out}/answers").drop("batch")
    newest = found.groupBy(*KEY).agg(F.max("version").alias("version"))
    return found.join(newest, [*KEY, "version"], "left_semi")
