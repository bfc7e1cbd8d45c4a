"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text gives its set of word shingles (as 64-bit hashes), a digest of the set and a MinHash
   signature. Texts of one set collapse to the smallest doc_id, so exact copies cost one row.
2. Signatures are banded. The members of a band bucket are compared on batches of the signature:
   with m of n hashes equal and a uniform prior, P(similarity >= t) = P(Binomial(n + 1, t) <= m); a
   pair is given up once that is below `miss`. Each bucket reports a spanning forest of the pairs
   that stay; their components are the candidate clusters.
3. In a cluster the full shingle sets are compared exactly, likeliest pairs first, skipping pairs
   that are already connected. The exact links' components are the result.

Buckets and clusters beyond a fixed size are dealt out as pairs of blocks, each block pair to a group
of its own, so that every pair is still compared and no task holds a whole large group.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, BYTES, LOWER, arrow_groups, documents_of, materialize, mix, slices, text_bytes
from .components import components

BANDS, ROWS, STEP, MISS = 20, 3, 12, 1e-6
HASHES = BANDS * ROWS
#: Members of a bucket, and shingles of a cluster, that one block holds.
BUCKET_BLOCK, CLUSTER_BLOCK = 4096, 1_500_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_A = np.random.default_rng(7).integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) mod 2 ** 64; kept while it is small."""
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        x = np.full(max(n, 1 << 19), base, np.uint64)
        x[0] = 1
        np.cumprod(x, out=x)
        if len(x) > 1 << 22:
            return x[:n]
        _powers[key] = x
    return _powers[key][:n]


def word_spans(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of some texts begin and end, and each text's offsets into them."""
    n = len(b)
    inside = ~_SPACE[b]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = off[:-1] < off[1:]
    before[off[:-1][full]] = False
    after[off[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, off)


def word_hashes(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of some texts, and each text's offsets into them."""
    n = len(b)
    starts, ends, at = word_spans(b, off)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTES[LOWER[b]] * _power(BASE, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_INVERSE, n)[starts] if n else np.empty(0, np.uint64)), at


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: words in a row, or all words if there are fewer."""
    b, off = text_bytes(column)
    for lo, hi in slices(off):
        part = off[lo : hi + 1] - off[lo]
        w, at = word_hashes(b[off[lo] : off[hi]], part)
        n = max(0, len(w) - width + 1)
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h = h * np.uint64(0xFF51AFD7ED558CCD) + w[k : k + n]
        mix(h)
        for i in range(hi - lo):
            a, e = at[i], at[i + 1]
            if e - a >= width:
                yield np.unique(h[a : e - width + 1])
            elif e > a:
                yield np.frombuffer(hashlib.blake2b(w[a:e].tobytes(), digest_size=8).digest(), np.uint64)
            else:
                yield np.empty(0, np.uint64)


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES 64-bit minima for each (non-empty) set."""
    out = np.empty((len(sets), HASHES), np.uint64)
    sizes = np.array([len(s) for s in sets])
    for lo, hi in slices(np.concatenate([[0], np.cumsum(sizes)]), 1 << 15):
        flat = np.concatenate(sets[lo:hi])
        at = np.cumsum(sizes[lo:hi]) - sizes[lo:hi]
        for k in range(HASHES):
            x = flat * _A[k]
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xC4CEB9FE1A85EC53)
            out[lo:hi, k] = np.minimum.reduceat(x, at)
    return out


SIGNED = "doc_id long, n_shingles long, digest binary, sig binary, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(batch.column(1), width))
        some = [i for i, s in enumerate(sets) if len(s)]
        digest: list = [None] * len(sets)
        sig, bands = digest.copy(), digest.copy()
        if some:
            m = minhashes([sets[i] for i in some])
            short = (m >> np.uint64(48)).astype(np.uint16)
            key = np.zeros((len(some), BANDS), np.uint64)
            for r in range(ROWS):
                key = key * np.uint64(0x9FB21C651E98DF25) + m[:, r::ROWS][:, :BANDS]
            key = mix(key + np.arange(BANDS, dtype=np.uint64)[None, :] * BASE).view(np.int64)
            for k, i in enumerate(some):
                digest[i], sig[i], bands[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), short[k].tobytes(), key[k].tolist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "sig", "bands"])


def least_matches(similarity: float, miss: float) -> list[int]:
    """After each STEP hashes, the fewest equal ones with which a pair stays."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        out.append(m)
    return out


def plausible(one: np.ndarray, many: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of `many` stay beside `one`, and their equal hashes."""
    stay = np.arange(len(many))
    equal = np.zeros(len(many), np.int64)
    for k, m in enumerate(least):
        cols = slice(k * STEP, (k + 1) * STEP)
        equal += (many[stay, cols] == one[cols]).sum(1)
        on = equal >= m
        stay, equal = stay[on], equal[on]
    return stay, equal


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def spanning(ids: np.ndarray, sigs: np.ndarray, least: list[int]) -> list[tuple[int, int]]:
    """Edges that connect what the plausible pairs of a group connect."""
    n, edges = len(ids), []
    comp = np.arange(n)
    for i in range(n - 1):
        others = np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1
        if not len(others):
            if (comp == comp[i]).all():
                break
            continue
        for j in others[plausible(sigs[i], sigs[others], least)[0]]:
            if comp[j] != comp[i]:
                comp[comp == comp[j]] = comp[i]
                edges.append((int(ids[i]), int(ids[j])))
    return edges


def _bucket_edges(batches: Iterator[pa.RecordBatch], least: list[int]) -> Iterator[pa.RecordBatch]:
    for t in arrow_groups(batches, ["key", "bi", "bj"]):
        ids, sigs = t.column("rep").to_numpy(), _matrix(t.column("sig"))
        keys = [t.column(k).to_numpy() for k in ("key", "bi", "bj")]
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(ids)]])
        a, b = [], []
        two = starts[ends - starts == 2]
        equal = (sigs[two].reshape(-1, len(least), STEP) == sigs[two + 1].reshape(-1, len(least), STEP)).sum(2).cumsum(1)
        on = two[(equal >= np.array(least)).all(1)]
        a, b = ids[on].tolist(), ids[on + 1].tolist()
        for s, e in zip(starts, ends, strict=True):
            if e - s > 2:
                for x, y in spanning(ids[s:e], sigs[s:e], least):
                    a.append(x)
                    b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def exact_edges(ids: np.ndarray, sets: list[np.ndarray], least: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that connect what all exact links of a group connect; pairs that Bayes rules out are not compared."""
    sizes = np.array([len(s) for s in sets])
    sigs = (minhashes(sets) >> np.uint64(48)).astype(np.uint16)
    comp, edges = np.arange(len(ids)), []
    for i in range(len(ids) - 1):
        others = np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1
        fits = 100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])
        others = others[fits]
        stay, equal = plausible(sigs[i], sigs[others], least)
        for j in others[stay[np.argsort(-equal, kind="stable")]]:
            if comp[j] == comp[i]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                comp[comp == comp[j]] = comp[i]
                edges.append((int(ids[i]), int(ids[j])))
    return edges


def _cluster_edges(batches: Iterator[pa.RecordBatch], least: list[int], percent: int, width: int) -> Iterator[pa.RecordBatch]:
    for whole in arrow_groups(batches, ["cluster", "bi", "bj"]):
        keys = [whole.column(k).to_numpy() for k in ("cluster", "bi", "bj")]
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        a, b = [], []
        for s, e in zip([0, *new.tolist()], [*new.tolist(), whole.num_rows], strict=True):
            if e - s > 1:
                t = whole.slice(s, e - s)
                for x, y in exact_edges(t.column("rep").to_numpy(), list(shingle_sets(t.column("text"), width)), least, percent):
                    a.append(x)
                    b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def in_block_pairs(rows: DataFrame, blocks: F.Column) -> DataFrame:
    """Each row once for every pair of blocks that its own block is in: (bi, bj) with bi <= bj; one block gives (0, 0)."""
    own = F.pmod(F.xxhash64("rep"), F.col("_n")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda j: F.struct(F.least(F.col("_own"), j).alias("bi"), F.greatest(F.col("_own"), j).alias("bj")))
    return rows.withColumn("_n", blocks.cast("int")).withColumn("_own", own).withColumn("_p", F.explode(pairs)).select("*", "_p.bi", "_p.bj").drop("_n", "_own", "_p")


def near_duplicates(docs: DataFrame, similarity_percent: int = 75, width: int = 5, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): the near-duplicate component of every row.

    Two documents are linked if 100 * shared shingles >= similarity_percent * all their shingles.
    component_id is the smallest doc_id reached, itself included. Defined cases: a text that is null
    or has no word has no shingle and is linked with nothing; equal texts are linked; a null doc_id
    is never the smallest (a component of only such rows gets null) and is not kept unless it is
    alone; rows that repeat a doc_id get that document's component; other columns are ignored.
    """
    least = least_matches(similarity_percent / 100, miss)
    rows = documents_of(docs, id_col, text_col)
    signed = materialize(rows.mapInArrow(lambda it: _sign(it, width), SIGNED), "signed")
    reps = signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    reps = materialize(reps, "reps")

    members = reps.select("rep", F.explode("bands").alias("key"))
    sizes = members.groupBy("key").count().where("count > 1")
    blocks = F.ceil(F.col("count") / BUCKET_BLOCK)
    dealt = in_block_pairs(members.join(sizes, "key"), blocks).select("rep", "key", "bi", "bj")
    dealt = dealt.join(reps.select("rep", "sig"), "rep").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "rep")
    near = dealt.select("key", "bi", "bj", "rep", "sig").mapInArrow(lambda it: _bucket_edges(it, least), "a long, b long")
    clusters = materialize(components(near), "clusters").withColumnsRenamed({"node": "rep", "component": "cluster"})

    weighed = clusters.join(reps.select("rep", "n_shingles"), "rep")
    totals = weighed.groupBy("cluster").agg(F.sum("n_shingles").alias("total"))
    placed = in_block_pairs(clusters.join(totals, "cluster"), F.ceil(F.col("total") / CLUSTER_BLOCK)).drop("total")
    texts = placed.join(rows.withColumnRenamed("doc_id", "rep"), "rep").repartition("cluster", "bi", "bj").sortWithinPartitions("cluster", "bi", "bj", "rep")
    links = texts.select("cluster", "bi", "bj", "rep", "text").mapInArrow(lambda it: _cluster_edges(it, least, similarity_percent, width), "a long, b long")
    found = components(links).withColumnsRenamed({"node": "rep"})

    classes = reps.select("digest", "rep").join(found, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
