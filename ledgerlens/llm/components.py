"""Connected components of an edge table, by large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

EDGES = "a long, b long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest node of its component, for a bounded list of edges."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.split(flat, 2)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each run of at most a million edges becomes its spanning stars."""
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        a, b = forest(t.column(0).to_numpy(), t.column(1).to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= 1_000_000:
            yield flush()
            held, n = [], 0
    if n:
        yield flush()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a > b): each node's other neighbours (larger ones, or smaller ones) are linked to its smallest."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of `edges` (a, b) with the smallest node that it reaches.

    Loops and repeated edges are allowed and edges with a null end count as absent; an empty table
    gives no rows. Rounds end when one changes nothing, which two numbers tell; no edge goes to the driver.
    """
    e = edges.where("a is not null and b is not null and a <> b").select("a", "b").mapInArrow(_local, EDGES)
    e = materialize(e.distinct(), "edges")
    said = None
    while True:
        e = materialize(_star(_star(e, True), False), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == said:
            break
        said = tuple(now)
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
