"""Packing into optimal length buckets.

One pass counts tokens; a global histogram of the lengths (at most `budget` entries, since a longer
document needs no bucket) goes to the driver, where dynamic programming places the bucket limits
that minimise padding. Inside a bucket of limit b a batch holds floor(budget / b) documents, in
order of hashed chunk, length and doc_id. A chunk's documents are ranked by a window, and the prefix
sum of the chunks' counts continues the ranks through the bucket, so that no task holds a bucket. Chunks
go by the hash of id and text, and their number grows with the rows. `batches` puts the token ids of
each batch together, padded to the bucket's limit.

Defined cases: null or empty text has one token (the end id); a document longer than `budget` forms
an own batch in bucket -1 whose limit is its length; repeated rows are packed as often as they occur
and ties in length are ordered by doc_id (null first); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents_of, materialize, without_collector
from .wordbpe import encoder

N_BUCKETS, BUDGET = 16, 16_384
#: Chunks of a bucket at least, and rows of a chunk on average at most.
CHUNKS, CHUNK_ROWS = 256, 50_000


def token_lengths(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None) -> DataFrame:
    """(doc_id, spread, n_tokens) with the end id counted, and with an end_id given the ids themselves; spread: the hash of id and text."""
    with_ids = end_id is not None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            out = [batch.column(0), batch.column(1)]
            with without_collector():
                if with_ids:
                    ids, off = enc.encode(batch.column(2))
                    off = np.asarray(off, np.int64)
                    flat = np.insert(ids, off[1:], end_id).astype(np.int32)
                    off = off + np.arange(len(off))
                    out += [pa.array(np.diff(off)), pa.LargeListArray.from_arrays(off, pa.array(flat)).cast(pa.list_(pa.int32()))]
                else:
                    out.append(pa.array(enc.lengths(batch.column(2)) + 1))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "spread", "n_tokens", "ids"][: len(out)])

    rows = documents_of(docs, id_col, text_col).select("doc_id", F.xxhash64("doc_id", "text").alias("spread"), "text")
    return rows.mapInArrow(count, "doc_id long, spread long, n_tokens long" + (", ids array<int>" if with_ids else ""))


def bucket_limits(lengths: np.ndarray, counts: np.ndarray, k: int) -> tuple[list[int], int]:
    """The limits of at most k buckets with the least padding, and that padding.

    lengths: distinct, ascending. With C and S the prefix sums of counts and of tokens, a bucket of
    lengths i..j pads to lengths[j] * (C[j] - C[i - 1]) - (S[j] - S[i - 1]). The best split point
    moves up with j, so each of the k rounds is solved by divide and conquer.
    """
    n = len(lengths)
    if not n:
        return [], 0
    x = lengths.astype(np.int64)
    c, s = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * x)])
    best = x * c[1:] - s[1:]
    cuts = [np.zeros(n, np.int64)]
    for _ in range(1, min(k, n)):
        prior = np.concatenate([[0], best])  # prior[i]: the first i lengths are in earlier buckets
        new, cut = np.empty(n, np.int64), np.empty(n, np.int64)
        stack = [(0, n - 1, 0, n - 1)]
        while stack:
            lo, hi, a, b = stack.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j) + 1)
            cost = prior[i] + x[j] * (c[j + 1] - c[i]) - (s[j + 1] - s[i])
            m = int(cost.argmin())
            new[j], cut[j] = cost[m], i[m]
            stack += [(lo, j - 1, a, int(i[m])), (j + 1, hi, int(i[m]), b)]
        best = new
        cuts.append(cut)
    limits, j, padding = [], n - 1, int(best[-1])
    for cut in reversed(cuts):
        limits.append(int(x[j]))
        j = int(cut[j]) - 1
        if j < 0:
            break
    return limits[::-1], padding


def pack(docs: DataFrame, tokenizer_path: str, n_buckets: int = N_BUCKETS, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_limit, batch, slot) of every row, and with an end_id given its ids."""
    lengths = materialize(token_lengths(docs, tokenizer_path, id_col, text_col, end_id), "lengths")
    histogram = lengths.groupBy(F.least("n_tokens", F.lit(budget + 1)).alias("n")).count().toPandas().sort_values("n")
    within = histogram[histogram["n"] <= budget]
    limits, _ = bucket_limits(within["n"].to_numpy(np.int64), within["count"].to_numpy(np.int64), n_buckets)
    n_chunks = max(CHUNKS, -(-int(histogram["count"].sum()) // CHUNK_ROWS))
    bucket, limit = F.lit(-1), F.col("n_tokens")
    for i in reversed(range(len(limits))):
        bucket = F.when(F.col("n_tokens") <= limits[i], i).otherwise(bucket)
        limit = F.when(F.col("n_tokens") <= limits[i], limits[i]).otherwise(limit)
    rows = lengths.withColumn("bucket", bucket).withColumn("bucket_limit", limit.cast("long"))
    rows = rows.withColumn("chunk", F.pmod("spread", F.lit(n_chunks)).cast("int"))
    counts = rows.groupBy("bucket", "chunk").count()  # at most (n_buckets + 1) * n_chunks rows, one for thousands of documents
    bases = counts.withColumn("base", F.sum("count").over(Window.partitionBy("bucket").orderBy("chunk")) - F.col("count")).drop("count")
    rank = F.row_number().over(Window.partitionBy("bucket", "chunk").orderBy("n_tokens", F.col("doc_id").asc_nulls_first(), "spread")) - 1
    size = F.when(F.col("bucket") >= 0, F.floor(F.lit(budget) / F.col("bucket_limit"))).otherwise(1).cast("long")
    placed = rows.withColumn("rank", rank).join(bases, ["bucket", "chunk"]).withColumn("at", F.col("rank") + F.col("base")).withColumn("size", size)
    extra = [] if end_id is None else ["ids"]
    return placed.select("doc_id", "n_tokens", F.col("bucket").cast("long").alias("bucket"), "bucket_limit", F.floor(F.col("at") / F.col("size")).alias("batch"), (F.col("at") % F.col("size")).alias("slot"), *extra)


def batches(docs: DataFrame, tokenizer_path: str, end_id: int, pad_id: int = 0, **options) -> DataFrame:
    """(bucket, batch, width, doc_ids, lengths, ids): each batch's documents by slot, its ids row after row, padded to `width`.

    A batch holds at most `budget` ids, or one longer document, so that each group is bounded.
    """
    rows = pack(docs, tokenizer_path, end_id=end_id, **options)
    one = F.struct("slot", "doc_id", "n_tokens", "ids")
    each = rows.groupBy("bucket", "batch").agg(F.max("bucket_limit").alias("width"), F.array_sort(F.collect_list(one)).alias("d"))
    filled = F.transform("d", lambda x: F.concat(x["ids"], F.array_repeat(F.lit(pad_id), (F.col("width") - x["n_tokens"]).cast("int"))))
    return each.select("bucket", "batch", "width", F.col("d.doc_id").alias("doc_ids"), F.col("d.n_tokens").alias("lengths"), F.flatten(filled).alias("ids"))
