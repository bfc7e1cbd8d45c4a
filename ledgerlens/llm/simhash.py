"""SimHash near-duplicates by the generalised pigeonhole principle.

1. Each text gives a 64-bit fingerprint: a bit is the majority of its shingles' XXH64 bits. Texts of one
   fingerprint are one class from there on, however many they are.
2. Bits that go together are grouped into partitions, greedily by correlation over all fingerprints, so
   that the partitions tell fingerprints apart by as much as can be.
3. For two fingerprints at most `most` bits apart, and thresholds of m partitions that sum to most - m + 1
   (-1: not probed), some partition differs by at most its threshold. Every fingerprint gets thresholds of
   its own: dynamic programming over the partitions chooses those with the fewest probes and candidates,
   the latter estimated from histograms of parts of each partition.
4. Fingerprints are indexed by the value of each partition; probes take all values within the threshold.
   Candidates come from an equi-join and are verified by counting bits. Components of the links are the result.

A value that more than CROWDED fingerprints share is not probed, for its candidates grow with its square: they
and those that would probe it are linked through the strings one bit away (two fingerprints at most two bits
apart share one), which is exact and in proportion; for other distances the value's members are probed anyway.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, documents_of, materialize, slices, text_bytes
from .components import components
from .neardup import word_spans

BITS, MOST, WIDTH, SEED = 64, 2, 3, 42
#: Fingerprints of one value of a partition that are still probed one by one; bits of a histogram.
CROWDED, PART_BITS = 256, 11
_ONE = np.uint64(1)


def bit_sums(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the lowest first."""
    total = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 1 << 14):
        part = h[k : k + (1 << 14)]
        total += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def fingerprints(column: pa.Array, width: int = WIDTH) -> np.ndarray:
    """Fingerprint of each text, as unsigned 64-bit numbers."""
    b, off = text_bytes(column)
    out = np.zeros(len(off) - 1, np.uint64)
    powers = _ONE << np.arange(BITS, dtype=np.uint64)
    for lo, hi in slices(off):
        low = LOWER[b[off[lo] : off[hi]]]
        starts, ends, at = word_spans(low, off[lo : hi + 1] - off[lo])
        size = ends - starts
        place = np.cumsum(size + 1) - size - 1  # where words begin once one space stands between them
        spaced = np.full(int(size.sum()) + len(size), 32, np.uint8)
        inside = np.repeat(starts - place, size)
        here = np.repeat(place - np.cumsum(size) + size, size) + np.arange(len(inside))
        spaced[here] = low[here + inside]
        text, until = spaced.tobytes(), place + size
        for i in range(lo, hi):
            a, e = int(at[i - lo]), int(at[i - lo + 1])
            if e > a:
                n = max(1, e - a - width + 1)
                last = min(width, e - a) - 1
                h = np.fromiter((xxhash.xxh64_intdigest(text[x:y], SEED) for x, y in zip(place[a : a + n].tolist(), until[a + last : a + last + n].tolist(), strict=True)), np.uint64, n)
                out[i] = (powers * (2 * bit_sums(h) > n)).sum(dtype=np.uint64)
    return out


def correlated_groups(pairs: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m groups of bits of nearly one size; pairs[i, j]: in how many of the n fingerprints bits i and j are both set."""
    p = np.diag(pairs) / max(n, 1)
    dev = np.sqrt(p * (1 - p))
    with np.errstate(divide="ignore", invalid="ignore"):
        phi = np.abs(np.nan_to_num((pairs / max(n, 1) - np.outer(p, p)) / np.outer(dev, dev)))
    free, out = list(range(BITS)), []
    for k in range(m):
        size = len(free) // (m - k)
        tie = lambda x: (-phi[x, [y for y in free if y != x]].sum(), x)
        group = [min(free, key=tie)]
        while len(group) < size:
            group.append(min((x for x in free if x not in group), key=lambda x: (-phi[x, group].sum(), x)))
        out.append(sorted(group))
        free = [x for x in free if x not in group]
    return out


def values(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The number that the chosen bits of each fingerprint make."""
    out = np.zeros(len(fps), np.int64)
    for k, bit in enumerate(bits):
        out |= ((fps >> np.uint64(bit)) & _ONE).astype(np.int64) << k
    return out


def parts(bits: list[int]) -> list[list[int]]:
    n = -(-len(bits) // PART_BITS)
    return [bits[len(bits) * k // n : len(bits) * (k + 1) // n] for k in range(n)]


def within(hist: np.ndarray, most: int) -> np.ndarray:
    """[value, d]: the share of a histogram's members that differ from the value in d bits, d = 0 .. most."""
    width, at = int(len(hist)).bit_length() - 1, np.arange(len(hist))
    out = np.zeros((len(hist), most + 1))
    for d in range(min(most, width) + 1):
        for flip in combinations(range(width), d):
            out[:, d] += hist[at ^ sum(1 << f for f in flip)]
    return out / max(hist.sum(), 1)


def allocate(cost: np.ndarray, most: int) -> np.ndarray:
    """Thresholds [row, partition] with the least sum of costs among those that sum to most - m + 1; cost[row, partition, t + 1]."""
    n, m, _ = cost.shape
    room = most + 1  # thresholds and 1, so that they sum to most + 1
    best, took = np.full((n, room + 1), np.inf), []
    best[:, 0] = 0
    for k in range(m):
        new, which = np.full((n, room + 1), np.inf), np.zeros((n, room + 1), np.int8)
        for used in range(room + 1):
            for t in range(room + 1 - used):
                c = best[:, used] + cost[:, k, t]
                better = c < new[:, used + t]
                new[better, used + t], which[better, used + t] = c[better], t
        best = new
        took.append(which)
    left, out = np.full(n, room), np.zeros((n, m), np.int64)
    for k in reversed(range(m)):
        out[:, k] = took[k][np.arange(n), left]
        left = left - out[:, k]
    return out - 1


def partitions(n: int, most: int = MOST) -> int:
    """How many partitions make the fewest probes and candidates for n fingerprints whose bits are even."""

    def cost(m: int) -> float:
        widths = [BITS // m + (k < BITS % m) for k in range(m)]
        ball = [[0.0, *np.cumsum([comb(w, d) for d in range(most + 1)])] for w in widths]
        each = np.array([[[b * (1 + n / 2.0**w) for b in row] for row, w in zip(ball, widths, strict=True)]])
        chosen = allocate(each, most)[0] + 1
        return sum(each[0, k, t] for k, t in enumerate(chosen))

    return min(range(2, most + 3), key=cost)


class Plan:
    """Partitions with their histograms: index keys and probes of fingerprints."""

    def __init__(self, groups: list[list[int]], n: int, most: int):
        self.groups, self.n, self.most = groups, n, most
        self.hists = [[np.zeros(1 << len(p), np.int64) for p in parts(g)] for g in groups]

    def keys(self, fps: np.ndarray) -> np.ndarray:
        """[row, partition]: the index keys."""
        return np.stack([values(fps, g) | (k << 48) for k, g in enumerate(self.groups)], axis=1)

    def tables(self) -> list[list[np.ndarray]]:
        return [[within(h, self.most) for h in hists] for hists in self.hists]

    def costs(self, fps: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Probes and expected candidates of each threshold; parts of a partition count as independent."""
        out = np.zeros((len(fps), len(self.groups), self.most + 2))
        for k, g in enumerate(self.groups):
            share = np.zeros((len(fps), self.most + 1))
            share[:, 0] = 1
            for p, t in zip(parts(g), tables[k], strict=True):
                near = t[values(fps, p)]
                share = np.stack([sum(share[:, d - e] * near[:, e] for e in range(d + 1)) for d in range(self.most + 1)], axis=1)
            out[:, k, 1:] = np.cumsum(share * self.n + np.array([comb(len(g), d) for d in range(self.most + 1)]), axis=1)
        return out

    def probes(self, fps: np.ndarray, tables: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(key, fingerprint) of all probes."""
        limit, own = allocate(self.costs(fps, tables), self.most), self.keys(fps)
        keys, who = [], []
        for k, g in enumerate(self.groups):
            for d in range(self.most + 1):
                rows = np.flatnonzero(limit[:, k] >= d)
                for flip in combinations(range(len(g)), d) if len(rows) else ():
                    keys.append(own[rows, k] ^ sum(1 << f for f in flip))
                    who.append(fps[rows])
        return (np.concatenate(keys), np.concatenate(who)) if keys else (np.empty(0, np.int64), fps[:0])


def _fps(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)


def _sums(fps: DataFrame, count, shape: int) -> np.ndarray:
    """Sums of count(fingerprints) over the table; a task sends at most `shape` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for batch in batches:
            total += count(_fps(batch))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    out = np.zeros(shape, np.int64)
    for r in fps.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out


def plan_for(fps: DataFrame, most: int = MOST) -> Plan:
    """Two passes over the fingerprints: bits that are set together, then histograms of the partitions' parts."""

    def together(x: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(x.view(np.uint8).reshape(len(x), 8), axis=1, bitorder="little").astype(np.float64)
        return (bits.T @ bits).astype(np.int64).ravel()

    n = fps.count()
    pairs = _sums(fps, together, BITS * BITS).reshape(BITS, BITS)
    plan = Plan(correlated_groups(pairs, n, partitions(n, most)), n, most)
    flat = [p for g in plan.groups for p in parts(g)]
    ends = np.cumsum([0, *(1 << len(p) for p in flat)])
    counted = _sums(fps, lambda x: np.concatenate([np.bincount(values(x, p), minlength=1 << len(p)) for p in flat]), int(ends[-1]))
    pieces = iter(np.split(counted, ends[1:-1]))
    plan.hists = [[next(pieces) for _ in parts(g)] for g in plan.groups]
    return plan


def links(fps: DataFrame, most: int = MOST) -> DataFrame:
    """Edges (a, b) that connect what all pairs of fingerprints at most `most` bits apart connect. fps: one column, distinct."""
    plan = plan_for(fps, most)

    def rows(make) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = plan.tables()
            for batch in batches:
                x = _fps(batch)
                for k in range(0, len(x), 2048):
                    key, who = make(x[k : k + 2048], tables)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(who.view(np.int64))], names=["key", "fp"])

        return fps.mapInArrow(run, "key long, fp long")

    index = materialize(rows(lambda x, _: (plan.keys(x).ravel(), np.repeat(x, len(plan.groups)))), "index")
    probes = materialize(rows(plan.probes), "probes")
    crowded = index.groupBy("key").count().where(F.col("count") > (CROWDED if most == 2 else 1 << 62)).select("key")
    crowded = materialize(crowded, "crowded")
    lone = index.join(crowded, "key", "left_anti").withColumnRenamed("fp", "other")
    pairs = probes.join(lone, "key").where((F.col("other") < F.col("fp")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= most))
    edges = pairs.select(F.col("fp").alias("a"), F.col("other").alias("b"))

    members = index.join(crowded, "key", "left_semi").select("fp").unionByName(probes.join(crowded, "key", "left_semi").select("fp")).distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(BITS)])
    near = members.select("fp", F.explode(F.transform(flips, lambda f: f.bitwiseXOR(F.col("fp")))).alias("way"))
    met = near.groupBy("way").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
    least = F.array_min("fps")
    return edges.unionByName(met.select(F.explode("fps").alias("a"), least.alias("b")).where("a <> b"))


def near_duplicates(docs: DataFrame, most: int = MOST, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): every row's fingerprint and the smallest doc_id that links reach, its own included.

    Fingerprints at most `most` bits apart are linked. Defined cases: a text that is null or has no word has the
    fingerprint 0, which is linked like any other; a text with fewer words than a shingle is one shingle; a null
    doc_id is never the smallest (a component of only such rows gets null); rows that repeat a doc_id are each
    judged by their own text; no rows give no rows; other columns are ignored.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1), width).view(np.int64))], names=["doc_id", "fp"])

    signed = materialize(documents_of(docs, id_col, text_col).mapInArrow(sign, "doc_id long, fp long"), "signed")
    classes = materialize(signed.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = components(links(classes.select("fp"), most))
    known = materialize(classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "known")
    smallest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialize(known.join(smallest, "component").select("fp", "component_id"), "named")
    return signed.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
