"""Target-distribution importance resampling with hashed n-grams (DSIR).

1. In an Arrow batch each distinct word gets an integer id. An n-gram is the pair of the id of its first
   n - 1 words and the id of its last word, and each distinct pair gets an id again; so every distinct
   n-gram of the batch is put together as bytes and hashed once, and its bucket goes to all places by id.
2. Each row keeps its features' buckets, sorted, in a written table. Bucket counts are summed in the tasks
   before they are shuffled; counts and gains are as many as there are buckets.
3. A row's weight is the sum of its gains. Rows are sorted by score over all tasks, in ranges, and a row's
   rank is the number of rows of earlier ranges and its place in its own.

The dictionary is one of a batch, not of the corpus: a common one would shuffle every word of every text
to its id and back, for the same buckets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, documents_of, materialize, numbered, text_bytes

MAX_N, BUCKETS, PERCENT, MIN_WORDS, SEED = 1, 10_000, 10, 20, 2024
FEATURES = "doc_id long, n_words long, buckets array<int>"

#: Bytes of words once letters are lower-cased: digits, a-z and all bytes of letters beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def words_of(b: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of some texts (given as bytes and offsets), and each text's offsets into them."""
    low = LOWER[b]
    inside = _WORD[low]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = off[:-1] < off[1:]
    first[off[:-1][full]] |= inside[off[:-1][full]]  # words end with their text
    last[off[1:][full] - 1] |= inside[off[1:][full] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(low[inside].tobytes())])
    return words, np.searchsorted(starts, off)


def feature_buckets(column: pa.Array, max_n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n_words of each text, buckets of all features text by text, each text's offsets into these)."""
    words, at = words_of(*text_bytes(column))
    n_words = np.diff(at)
    coded = words.dictionary_encode()
    ids, known = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    text = np.repeat(np.arange(len(n_words)), n_words)
    left = n_words[text] - (np.arange(len(ids)) - at[:-1][text])  # words from this one to the text's end
    gram, grams, found, owner = ids, known, [], []
    for n in range(1, max_n + 1):
        if n > 1:  # gram[i] stands for n - 1 words from place i
            here = np.flatnonzero(left >= n)
            pairs, place = np.unique(gram[here] * (len(known) + 1) + ids[here + n - 1], return_inverse=True)
            grams = [grams[p] + b" " + known[w] for p, w in zip(*(x.tolist() for x in np.divmod(pairs, len(known) + 1)), strict=True)]
            gram = np.zeros(len(ids), np.int64)
            gram[here] = place
        else:
            here = np.arange(len(ids))
        hashed = np.fromiter(map(zlib.crc32, grams), np.int64, len(grams)) % buckets
        found.append(hashed[gram[here]])
        owner.append(text[here])
    flat, own = np.concatenate(found), np.concatenate(owner)
    return n_words, flat[np.lexsort((flat, own))], np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(n_words)))])


def features(docs: DataFrame, max_n: int, buckets: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, flat, off = feature_buckets(batch.column(1), max_n, buckets)
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), lists], names=["doc_id", "n_words", "buckets"])

    return documents_of(docs, id_col, text_col).mapInArrow(run, FEATURES)


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How many features each bucket holds; a task sends one number for a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            n += np.bincount(batch.column(0).flatten().to_numpy(), minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of a bucket's share of the target to that of the corpus)."""
    s, t, k = corpus.astype(float), target.astype(float), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def resample(docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words) of every row; rank tells the rows drawn.

    score is the weight with a Gumbel variate of the doc_id, so that the `percent` of the rows with at least
    min_words words that have the highest scores are a draw without replacement by weight. Defined cases: a null
    or empty text has no feature, weight 0 and is not drawn (unless min_words is 0); a null doc_id hashes as an
    empty one and ranks before others of its score; rows that repeat a doc_id are rows of their own, ties go to
    the smaller doc_id and then to any; no rows give no rows; an empty target has only the smoothing; other
    columns are ignored.
    """
    found = materialize(features(docs, max_n, buckets, id_col, text_col), "features")
    gain = gains(bucket_counts(found, buckets), bucket_counts(features(target.select(F.lit(0).cast("long").alias("doc_id"), F.col(f"`{target_col}`").alias("text")), max_n, buckets, "doc_id", "text"), buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            n = lists.value_lengths().fill_null(0).to_numpy()
            sums = np.concatenate([[0], np.cumsum(gain[lists.flatten().to_numpy()])])
            end = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(sums[end] - sums[end - n])], names=["doc_id", "n_words", "n_features", "weight"])

    weighed = found.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = weighed.withColumn("score", (F.col("weight") + gumbel).cast("long")).withColumn("_out", F.col("n_words") < min_words).withColumn("_row", F.xxhash64(F.monotonically_increasing_id()))
    ranked = numbered(scored, [F.col("_out"), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("_row")], "_at", "ranked")
    drawn = percent * ranked.where("not _out").count() // 100
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("_at") < drawn, F.col("_at") + 1).alias("rank"), "n_words")
