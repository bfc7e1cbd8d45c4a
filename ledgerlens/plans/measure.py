"""Tables written with what the writing job saw: rows and failures are observed in it, bytes are the files'."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass
class Measured:
    """Numbers of the tables that one stage has written."""

    rows: int = 0
    bytes: int = 0
    failures: dict[str, int] = field(default_factory=dict)
    seen: dict[str, int] = field(default_factory=dict)

    def add(self, rows: int, size: int, failures: dict[str, int], seen: dict[str, int]) -> None:
        self.rows += rows
        self.bytes += size
        for mine, more in ((self.failures, failures), (self.seen, seen)):
            for k, n in more.items():
                mine[k] = mine.get(k, 0) + n


def stored_bytes(df: DataFrame, path: str) -> int:
    """Bytes below a path, from the file system's own listing."""
    jvm = df.sparkSession._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def save(df: DataFrame, path: str, into: Measured | None = None, failures: dict[str, Column] | None = None, seen: dict[str, Column] | None = None) -> DataFrame:
    """Writes a table as Parquet and reads it back. Conditions of `failures` and aggregates of `seen` are taken by the same job."""
    if into is None:
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.parquet(path)
    told = Observation()
    kinds, more = failures or {}, seen or {}
    watched = [F.count_if(c).alias(f"failures {k}") for k, c in kinds.items()] + [F.coalesce(c, F.lit(0)).cast("long").alias(f"seen {k}") for k, c in more.items()]
    df.observe(told, F.count(F.lit(1)).alias("rows"), *watched).write.mode("overwrite").parquet(path)
    got = told.get
    into.add(got["rows"], stored_bytes(df, path), {k: got[f"failures {k}"] for k in kinds}, {k: got[f"seen {k}"] for k in more})
    return df.sparkSession.read.parquet(path)
