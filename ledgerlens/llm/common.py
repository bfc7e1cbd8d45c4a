"""Shared helpers of the training-data operators: tables, shared storage and byte kernels."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Only in local mode it may be unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/ledgerlens-shared"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back, so later jobs neither recompute nor differ."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch into Python, so that batches of whole texts stay small however long the texts are.
BATCH_BYTES = 4 << 20


def documents_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names, whatever else the input carries.

    Also holds the session's Arrow batches to BATCH_BYTES, for whole texts pass through them.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The (UTF-8) bytes of a string or binary column in one array, and len+1 offsets into it; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or off[-1] == off[0]:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about `most` bytes each; a longer text makes a range of its own."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, side="right")) - 1)
        yield a, b
        a = b


#: Random odd multiplier and byte values of the polynomial hashes (any would do; fixed for repeatable runs).
BASE = np.uint64(0x9E3779B97F4A7C15)
BYTES = np.random.default_rng(20240917).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; changes x in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(b: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q-byte string of b, by joining hashes of halves; empty if b is shorter than q."""
    if len(b) < q:
        return np.empty(0, np.uint64)
    h, size, out, done = BYTES[b], 1, None, 0
    power = np.array([BASE])
    while True:
        if q & size:
            if out is None:
                out, done = h, size
            else:  # out covers `done` bytes, then h the next `size` bytes
                n = len(b) - done - size + 1
                out = out[:n] * power + h[done : done + n]
                done += size
        if size * 2 > q:
            return mix(out.copy() if out is h else out)
        n = len(b) - 2 * size + 1
        h = h[:n] * power + h[size : size + n]
        power = power * power
        size *= 2


def sliding(f: np.ufunc, x: np.ndarray, w: int) -> np.ndarray:
    """f (minimum or maximum) over x[i : i + w] for each i, by doubling."""
    size = 1
    while size * 2 <= w:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


_memo: list[tuple[str, Callable[[], None]]] = []


def claim_memo(owner: str, forget: Callable[[], None]) -> None:
    """A worker keeps the memo of one operator: another one's is forgotten when an operator claims the place."""
    if _memo and _memo[0][0] != owner:
        _memo[0][1]()
    _memo[:] = [(owner, forget)]


@contextmanager
def without_collector() -> Iterator[None]:
    """For tasks with large memos of strings: these hold no cycles, and the collector would walk them over and over."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def arrow_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups, from batches sorted by `keys`; a group that spans batches is carried over."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            c = batch.column(k).to_numpy(zero_copy_only=False)
            change |= c[1:] != c[:-1]
        cuts = np.flatnonzero(change) + 1
        first, last = (int(cuts[0]), int(cuts[-1])) if len(cuts) else (batch.num_rows, 0)
        same = not held or all(held[-1].column(k)[-1] == batch.column(k)[0] for k in keys)
        if held and not same:
            yield pa.Table.from_batches(held)
            held, first = [], 0
        if not len(cuts):
            held.append(batch)
            continue
        if held:
            yield pa.Table.from_batches([*held, batch.slice(0, first)])
            held = []
        else:
            first = 0
        if last > first:
            yield pa.Table.from_batches([batch.slice(first, last - first)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def numbered(df: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """`df`, written, with the column `name`: its rows' places 0, 1, .. in `order`.

    Rows are sorted over all tasks by ranges; only the number of rows of each range goes to the driver.
    Rows equal in `order` stand in any order and in one range, so it should tell rows apart.
    """
    kept = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()), label)
    at = F.shiftright(F.col(name), 33)
    counts = sorted(tuple(r) for r in kept.groupBy(at.alias("range")).count().collect())
    before, base = [], 0
    for k, n in counts:
        before.append((k, base - (k << 33)))
        base += n
    shift = kept.sparkSession.createDataFrame(before, "`_range` long, `_shift` long")
    return kept.join(F.broadcast(shift), at == F.col("_range")).withColumn(name, F.col(name) + F.col("_shift")).drop("_range", "_shift")
