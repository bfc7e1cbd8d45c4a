"""Token-ID output: flat unsigned files with 64-bit offsets, read back memory-mapped.

Documents are range-partitioned and sorted by doc_id (then by their texts' hashes, so that null ids do
not fall into one range), so a task's shards hold smaller ids than the next one's. A shard is three
files: `.bin` (token ids, 16 bits if the vocabulary fits, else 32), `.idx` (rows + 1 64-bit offsets into
it) and `.doc` (64-bit doc_ids); a task begins a new one when SHARD_BYTES of ids are written. Each write
task names its files by itself and reports the names with their counts; a task run again writes new
files, and only reported ones count. The prefix sum of the shards' token counts is each shard's base in
the whole corpus. Files are read by ranges, memory-mapped where the folder is mounted.

Defined cases: null or empty text gives the end id alone; a null doc_id is stored as the smallest
64-bit integer, comes first and reads back as null; rows of one doc_id stand in the order of their
texts' hashes, then texts; an empty table writes no shard and reads back as no rows; other columns are
ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_of, shared_dir, slices, without_collector
from .wordbpe import encoder

END_ID, NO_ID = 1, np.iinfo(np.int64).min
#: Bytes of ids after which a task begins its next shard (one batch of texts more at most), and of ids that are read at once.
SHARD_BYTES, READ_BYTES = 1 << 29, 1 << 22
MANIFEST = "shard long, part long, name string, n_docs long, n_tokens long"
ENDS = (".bin", ".idx", ".doc")


def _place(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


class ShardWriter:
    """The three files of a shard that is being written."""

    def __init__(self, folder: str, shard: int, part: int, kind: np.dtype):
        fs, path = _place(folder)
        fs.create_dir(path, recursive=True)
        self.said = {"shard": shard, "part": part, "name": f"shard-{shard:06d}-{part:06d}-{uuid.uuid4().hex}", "n_docs": 0, "n_tokens": 0}
        self.files = [fs.open_output_stream(f"{path}/{self.said['name']}{end}") for end in ENDS]
        self.files[1].write(np.zeros(1, "<u8").tobytes())
        self.kind = kind

    def add(self, docs: pa.Array, flat: np.ndarray, ends: np.ndarray) -> None:
        self.files[0].write(flat.astype(self.kind).tobytes())
        self.files[1].write((self.said["n_tokens"] + ends).astype("<u8").tobytes())
        self.files[2].write(docs.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        self.said["n_tokens"] += len(flat)
        self.said["n_docs"] += len(docs)

    def full(self, most: int) -> bool:
        return self.said["n_tokens"] * self.kind.itemsize >= most

    def close(self) -> pa.RecordBatch:
        for f in self.files:
            f.close()
        return pa.RecordBatch.from_pydict({k: [v] for k, v in self.said.items()})


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> list[dict]:
    """Write the token files of all documents under `folder`; returns the manifest, one entry for each shard.

    The manifest has a row for each shuffle partition and one more for each `shard_bytes` of ids.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer_path)
        kind = np.dtype("<u2" if enc.vocabulary <= 1 << 16 else "<u4")
        shard, part, out = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or ShardWriter(folder, shard, part, kind)
            with without_collector():
                ids, off = enc.encode(batch.column(1))
            flat = np.insert(ids, off[1:], end_id)  # behind each document's ids
            out.add(batch.column(0), flat, off[1:] + np.arange(1, len(off)))
            if out.full(shard_bytes):
                yield out.close()
                part, out = part + 1, None
        if out is not None:
            yield out.close()

    rows = documents_of(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    order = F.col("doc_id").asc_nulls_first(), F.col("tie")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    found = ranged.mapInArrow(write, MANIFEST).collect()
    return [r.asDict() for r in sorted(found, key=lambda r: (r.shard, r.part))]


def with_bases(manifest: list[dict]) -> list[dict]:
    """Each shard with the number of tokens before it."""
    ends = np.cumsum([m["n_tokens"] for m in manifest])
    return [m | {"base": int(e) - m["n_tokens"]} for m, e in zip(manifest, ends, strict=True)]


class Shard:
    """A shard's files, read by ranges of their entries: memory-mapped on a mounted folder, else through its file system."""

    def __init__(self, folder: str, name: str, wide: bool, mapped: bool | None = None):
        fs, path = _place(folder)
        if mapped is None:
            mapped = isinstance(fs, pafs.LocalFileSystem)
        self.kinds = [np.dtype(k) for k in ("<u4" if wide else "<u2", "<u8", "<i8")]
        self.files = []
        for end, kind in zip(ENDS, self.kinds, strict=True):
            file = f"{path}/{name}{end}"
            self.files.append(np.memmap(file, kind, "r") if mapped else fs.open_input_file(file))

    def _range(self, k: int, a: int, b: int) -> np.ndarray:
        f, size = self.files[k], self.kinds[k].itemsize
        return np.asarray(f[a:b]) if isinstance(f, np.memmap) else np.frombuffer(f.read_at((b - a) * size, a * size), self.kinds[k])

    def documents(self, n_docs: int, most: int = READ_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(doc_ids, offsets, ids) of some documents after the other, about `most` bytes of ids at once or one document."""
        for a in range(0, n_docs, 4096):
            b = min(a + 4096, n_docs)
            off, docs = self._range(1, a, b + 1).astype(np.int64), self._range(2, a, b)
            for lo, hi in slices(off, max(1, most // self.kinds[0].itemsize)):
                yield docs[lo:hi], off[lo : hi + 1], self._range(0, int(off[lo]), int(off[hi]))


def read_shards(spark: SparkSession, folder: str, manifest: list[dict], wide: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files: one task for each shard."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                for d, off, ids in Shard(folder, m["name"], wide).documents(m["n_docs"]):
                    at = off - off[0]
                    crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(d, mask=d == NO_ID), pa.array(m["base"] + off[:-1]), pa.array(np.diff(off)), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    shards = spark.createDataFrame([(m["name"], m["n_docs"], m["base"]) for m in with_bases(manifest)], "name string, n_docs long, base long")
    return shards.repartition(max(1, len(manifest))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write all documents' token files and give back what they hold, document by document."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = write_shards(docs, folder, tokenizer_path, end_id)
    from tokenizers import Tokenizer

    return read_shards(spark, folder, manifest, Tokenizer.from_file(tokenizer_path).get_vocab_size() > 1 << 16)
