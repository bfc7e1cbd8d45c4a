"""Group holdout and reproducible samples by hash, which no partitioning changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bits of a hash by which groups are counted before any is chosen.
CELL_BITS = 12


def group_split(df: DataFrame, key: str, seed: int, n_dev: int, pinned: tuple = (), order: Column | None = None) -> DataFrame:
    """(key, split): n_dev groups in dev, pinned ones first and the others by hash (or `order`); the rest in test.

    Two phases for hashes: groups are counted by the first bits of their hash, which tells the cell in which the n_dev-th group
    lies; all groups of cells before it are in, and of its own groups the least. So only 4096 counts and one cell's groups
    come together, however many groups there are and go to dev. With an order of one's own the n_dev least groups do.
    """
    by = F.xxhash64(F.col(key), F.lit(seed)) if order is None else order
    first = F.when(F.col(key).isin(*pinned), 0).otherwise(1) if pinned else F.lit(1)
    keys = df.select(key).distinct().select(key, first.alias("_first"), by.alias("_by"))
    cell, full, rest = F.lit(0), F.lit(False), keys.orderBy("_first", "_by", key).limit(n_dev)
    if order is None:
        cell = F.when(F.col("_first") == 0, -(1 << CELL_BITS)).otherwise(F.shiftright("_by", 64 - CELL_BITS))
        left, last = n_dev, None
        for c, n in sorted(tuple(r) for r in keys.groupBy(cell.cast("int").alias("cell")).count().collect()):
            last = c
            if n > left:
                break
            left, last = left - n, c + 1
        last = 0 if last is None else last
        full, rest = cell < last, keys.where(cell == last).orderBy("_by", key).limit(left)
    rest = F.broadcast(rest.select(F.col(key).alias("_key"), F.lit(True).alias("_in")))
    out = keys.join(rest, F.col(key).eqNullSafe(F.col("_key")), "left")
    return out.select(key, F.when(full | F.coalesce("_in", F.lit(False)), "dev").otherwise("test").alias("split"))


def attach_split(df: DataFrame, split: DataFrame, key: str) -> DataFrame:
    return df.join(split.select(key, "split"), key, "left")


def sample_per_group(df: DataFrame, by: list[str], most: int, seed: int, keys: list[str], order: Column | None = None) -> DataFrame:
    """At most `most` rows of each group, those with the least hash of the keys (or the least `order`, then keys)."""
    w = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), *keys) if order is None else order, *keys)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")
