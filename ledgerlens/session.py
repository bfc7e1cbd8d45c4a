"""The session that the library expects: UTC, adaptive execution, joins on more keys than tables are bucketed by."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName("ledgerlens")
    if master:
        cores = master[6:-1] if master.startswith("local[") else ""
        cores = str(os.cpu_count() or 1) if cores in ("", "*") else cores
        b = b.master(master).config("spark.sql.shuffle.partitions", cores)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.sql.requireAllClusterKeysForCoPartition": "false"} | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
