"""Benchmark decontamination by the q-gram lemma.

A text region with at most k edits from an item of m bytes shares at least m - q + 1 - k * q of the
item's q-grams with it, all on k + 1 neighbouring diagonals (place in the text minus place in the
item). So the shared q-grams are counted in bands of 2(k + 1) diagonals that overlap by half; only
bands that reach that count are kept, and banded alignment decides. ASCII case, and the kind of white
space, do not count. Bytes are compared, so an edit of one non-ASCII letter can count as two.

With regions=True texts and items are folded first (Unicode case; a run of white space is one blank), and
a part of an item counts like the whole: the lemma is applied to windows of PART bytes of the item, or
of PART_SHARE of a shorter one, and those that reach the count are aligned, each within its own budget.
They start an edit budget apart, so that every verbatim passage of that length lies near one of them.

The index of the benchmark goes to every task. It is taken in blocks of BLOCK_BYTES item bytes, each of which
is a pass over the documents and a job of its own, so that a task holds one block's index whatever the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, LOWER, documents_of, gram_hashes, materialize, slices, text_bytes

Q, EDIT_SHARE, BLOCK_BYTES = 12, 0.07, 4 << 20
#: Bytes of a part of an item, or the share of it if that is less.
PART, PART_SHARE = 200, 0.8
_FOLD = LOWER.copy()
_FOLD[[9, 10, 11, 12, 13]] = 32
_FILTER_BITS = 24
#: Shared places that are counted, and cells of alignments that are filled, at once.
PAIRS, CELLS = 1 << 20, 1 << 18


def edit_budget(m: int, q: int, share: float) -> int:
    """The edits allowed for an item of m bytes: a share of m, as far as the lemma still asks for one shared q-gram."""
    return max(0, min(int(m * share), (m - q) // q))


def folded(t: str | None) -> str:
    return " ".join((t or "").casefold().split())


def unfolded(t: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges of folded(t) as byte ranges of t."""
    starts, ends, at, blank = [], [], 0, None
    for c in t:
        n = len(c.encode())
        if not c.isspace():
            if blank and starts:
                starts.append(blank[0])
                ends.append(blank[1])
            blank, f = None, len(c.casefold().encode())
            starts += [at] * f
            ends += [at + n] * f
        else:
            blank = (blank[0] if blank else at, at + n)
        at += n
    return [(starts[a], ends[e - 1]) for a, e in spans]


def part_of(m: int, q: int) -> int:
    """The length of the parts that count of an item of m bytes; very short items count only as a whole."""
    part = min(PART, int(m * PART_SHARE))
    return part if part >= 2 * q else m


class Index:
    """The q-grams of some items, sorted, with the places where they stand, and a bit table that most other q-grams miss."""

    def __init__(self, items: list[tuple[int, str]], q: int, share: float, regions: bool = False):
        self.items, self.q, self.share, self.regions, self._halves = items, q, share, regions, None
        self.ids = [i for i, _ in items]
        self.text = [_FOLD[np.frombuffer((folded(t) if regions else t).encode(), np.uint8)] for _, t in items]
        self.budget = np.array([edit_budget(len(t), q, share) for t in self.text], np.int64)
        self.need = np.array([len(t) - q + 1 - k * q for t, k in zip(self.text, self.budget, strict=True)], np.int64)
        self.part = np.array([part_of(len(t), q) if regions else len(t) for t in self.text], np.int64)
        self.part_budget = np.array([edit_budget(m, q, share) for m in self.part.tolist()], np.int64)
        self.part_need = self.part - q + 1 - self.part_budget * q
        long = [k for k, t in enumerate(self.text) if len(t) >= q]
        self.short = [(k, self.text[k].tobytes()) for k in range(len(items)) if 0 < len(self.text[k]) < q]
        grams = [gram_hashes(self.text[k], q) for k in long]
        flat = np.concatenate([np.empty(0, np.uint64), *grams])
        item = np.repeat(np.array(long, np.int64), [len(g) for g in grams]) if long else np.empty(0, np.int64)
        place = np.concatenate([np.empty(0, np.int64), *[np.arange(len(g)) for g in grams]])
        order = np.argsort(flat, kind="stable")
        self.grams, starts, counts = np.unique(flat[order], return_index=True, return_counts=True)
        self.item, self.place, self.starts, self.counts = item[order], place[order], starts, counts
        self.table = np.zeros(1 << _FILTER_BITS, bool)
        self.table[self.grams >> np.uint64(64 - _FILTER_BITS)] = True

    def hits(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in b, number of the q-gram) of every shared q-gram."""
        h = gram_hashes(b, self.q)
        at = np.flatnonzero(self.table[h >> np.uint64(64 - _FILTER_BITS)]) if len(self.grams) else np.empty(0, np.int64)
        k = np.searchsorted(self.grams, h[at]) if len(at) else at
        on = self.grams[np.minimum(k, len(self.grams) - 1)] == h[at] if len(at) else np.zeros(0, bool)
        return at[on], k[on]

    def places(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of k, item, place in the item) of every place where these q-grams stand."""
        n = self.counts[k]
        stop = np.cumsum(n)
        j = np.repeat(self.starts[k] - stop + n, n) + np.arange(stop[-1] if len(stop) else 0)
        return np.repeat(np.arange(len(k)), n), self.item[j], self.place[j]

    def halves(self) -> list[tuple[int, "Index"]]:
        """(number of the first item, index) of the first and the second half of the items."""
        if self._halves is None:
            cut = len(self.items) // 2
            self._halves = [(0, Index(self.items[:cut], self.q, self.share, self.regions)), (cut, Index(self.items[cut:], self.q, self.share, self.regions))]
        return self._halves


def banded(item: np.ndarray, starts: np.ndarray, part: int, text: np.ndarray, lo: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(edits, end) of the best alignment of each part item[start : start + part] with a piece of the text, on the diagonals lo .. lo + width - 1."""
    n = max(1, len(text))
    far = part + width + 1
    j = (starts + lo)[:, None] + np.arange(width)[None, :]  # text position reached before any byte: byte i is on positions i + j
    row = np.where((j >= 0) & (j <= len(text)), 0, far)
    rank, edge = np.arange(width)[None, :], np.full((len(starts), 1), far)
    for i in range(part):
        p = i + j
        step = row + np.where((p >= 0) & (p < len(text)), text[np.clip(p, 0, n - 1)] != item[starts + i][:, None], far)
        row = np.minimum(step, np.concatenate([row[:, 1:], edge], axis=1) + 1)  # the item's byte has no counterpart
        row = np.minimum.accumulate(row - rank, axis=1) + rank  # bytes that only the text has
        row = np.where((p + 1 >= 0) & (p + 1 <= len(text)), row, far)
    k = row.argmin(1)
    at = np.arange(len(starts))
    return row[at, k], part + j[at, k]


def banded_distance(item: np.ndarray, text: np.ndarray, lo: int, hi: int) -> tuple[int, int]:
    """(edits, end) of the best alignment of the whole item with a part of the text, on the diagonals lo..hi."""
    edits, end = banded(item, np.zeros(1, np.int64), len(item), text, np.array([lo]), hi - lo + 1)
    return int(edits[0]), int(end[0])


def least(item: np.ndarray, starts: np.ndarray, part: int, text: np.ndarray, lo: np.ndarray, width: int) -> tuple[int, int]:
    """The least (edits, end) of banded(), in pieces of a bounded size."""
    piece = max(1, CELLS // width)
    found = [banded(item, starts[a : a + piece], part, text, lo[a : a + piece], width) for a in range(0, len(starts), piece)]
    return min((int(e), int(x)) for edits, end in found for e, x in zip(edits, end, strict=True))


def part_starts(m: int, part: int, budget: int) -> np.ndarray:
    """Where the parts of an item start: an edit budget apart, and the last at its end."""
    return np.unique(np.append(np.arange(0, m - part + 1, max(1, budget)), m - part))


Best = dict[tuple[int, int], tuple[int, int, int, int]]


def find(index: Index, b: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, item number, start, end, edits) of the items found in each of some folded texts; the best place of each item."""
    best: Best = {}
    _search(index, 0, b, off, best)
    out = [(r, i, max(0, end - n), end, edits) for (r, i), (_, edits, end, n) in best.items()]
    for i, needle in index.short:
        for r in range(len(off) - 1):
            p = b[off[r] : off[r + 1]].tobytes().find(needle)
            if p >= 0:
                out.append((r, i, p, p + len(needle), 0))
    return out


def _search(index: Index, first: int, b: np.ndarray, off: np.ndarray, best: Best) -> None:
    """Find an index's items, numbered from `first`. More than PAIRS shared places at once are taken by halves of
    the items, then for a single item text by text, then by ranges of diagonals."""
    at, k = index.hits(b)
    row = np.searchsorted(off, at, side="right") - 1
    inside = at + index.q <= off[row + 1] if len(at) else np.zeros(0, bool)
    at, k, row = at[inside], k[inside], row[inside]
    if not len(at):
        return
    if index.counts[k].sum() > PAIRS and len(index.items) > 1:
        for n, half in index.halves():
            _search(half, first + n, b, off, best)
        return
    cuts = np.flatnonzero(np.diff(row)) + 1 if index.counts[k].sum() > PAIRS else []
    for at_, k_, row_ in zip(np.split(at, cuts), np.split(k, cuts), np.split(row, cuts), strict=True):
        if index.counts[k_].sum() <= PAIRS:
            which, item, place = index.places(k_)
            _verify(index, first, b, off, row_[which], item, place, at_[which] - off[row_[which]], None, best)
            continue
        size, half = len(index.text[0]), int(index.budget[0]) + 1  # a single item and a single text
        bands, each = max(1, PAIRS // (int(index.counts.max()) * half)), at_ - off[row_[0]]
        for low in range(-(size // half) - 2, int(each[-1]) // half + 1, bands):
            near = slice(*np.searchsorted(each, [low * half, (low + bands + 1) * half + size]))
            which, item, place = index.places(k_[near])
            _verify(index, first, b, off, row_[near][which], item, place, each[near][which], (low, low + bands), best)


def _verify(index: Index, first: int, b: np.ndarray, off: np.ndarray, row: np.ndarray, item: np.ndarray, place: np.ndarray, at: np.ndarray, bands: tuple[int, int] | None, best: Best) -> None:
    """Count the shared places of each band of diagonals, and align where they are enough. at: places in the rows' texts."""
    low = (at - place) // (index.budget[item] + 1)
    band = np.concatenate([low, low - 1])
    row, item, place = (np.concatenate([x, x]) for x in (row, item, place))
    if bands:
        on = (band >= bands[0]) & (band < bands[1])
        row, item, band, place = row[on], item[on], band[on], place[on]
    if not len(row):
        return
    base, longest, n_items = int(band.min()), int(place.max()) + 1, int(item.max()) + 1
    span = int(band.max()) - base + 1
    pairs, pair = np.unique(row * n_items + item, return_inverse=True)
    groups, group = np.unique(pair * span + (band - base), return_inverse=True)
    key = np.unique(group * longest + place)  # a place of the item counts once in a band
    group, place = key // longest, key % longest
    starts = np.searchsorted(group, np.arange(len(groups)))
    counts = np.diff(np.append(starts, len(group)))
    band, pair = groups % span + base, groups // span
    row, item = pairs[pair] // n_items, pairs[pair] % n_items
    whole = counts >= index.need[item]
    enough = whole.copy()
    if index.regions:  # a part has enough if so many places that follow each other lie in one
        own = np.repeat(np.arange(len(starts)), counts)
        last = np.arange(len(group)) + index.part_need[item[own]] - 1
        on = last < len(group)
        last = np.minimum(last, len(group) - 1)
        on &= (group[last] == group) & (place[last] - place <= index.part[item[own]] - index.q)
        enough[own[on]] = True
    chosen = np.flatnonzero(enough)
    for g in np.split(chosen, np.flatnonzero(np.diff(pair[chosen])) + 1) if len(chosen) else []:
        r, i = int(row[g[0]]), int(item[g[0]])
        t, text, k = index.text[i], b[off[r] : off[r + 1]], int(index.budget[i])
        m, w, lo, width = len(t), int(index.part[i]), band[g] * (k + 1) - k, 4 * k + 2
        found = [best[r, first + i]] if (r, first + i) in best else []
        if whole[g].any():
            edits, end = least(t, np.zeros(int(whole[g].sum()), np.int64), m, text, lo[whole[g]], width)
            if edits <= k:
                found.append((0, edits, end, m))
        if w < m and not (found and min(found)[0] == 0):  # the whole item goes before its parts
            begin, where = part_starts(m, w, int(index.part_budget[i])), []
            for x, one in zip(lo, g, strict=True):
                places = place[starts[one] : starts[one] + counts[one]]
                s = begin[np.searchsorted(places, begin + w - index.q, side="right") - np.searchsorted(places, begin) >= index.part_need[i]]
                where.append((s, np.full(len(s), x)))
            s, x = (np.concatenate(y) for y in zip(*where, strict=True))
            if len(s):
                edits, end = least(t, s, w, text, x, width)
                if edits <= index.part_budget[i]:
                    found.append((1, edits, end, w))
        if found:
            best[r, first + i] = min(found)


HITS = "array<struct<item_id:long,start:long,end:long,edits:long>>"


def _hits(index: Index, column: pa.Array) -> list[list[dict]]:
    texts = column.to_pylist() if index.regions else []
    b, off = text_bytes(pa.array(map(folded, texts), pa.large_string()) if index.regions else column)
    hits: list[list] = [[] for _ in range(len(column))]
    for lo, hi in slices(off):
        for r, i, start, end, edits in find(index, _FOLD[b[off[lo] : off[hi]]], off[lo : hi + 1] - off[lo]):
            hits[lo + r].append({"item_id": index.ids[i], "start": start, "end": end, "edits": edits})
    for t, h in zip(texts, hits, strict=False):
        if h:
            for x, (a, e) in zip(h, unfolded(t, [(x["start"], x["end"]) for x in h]), strict=True):
                x["start"], x["end"] = a, e
    return [sorted(h, key=lambda x: (x["item_id"], x["start"])) for h in hits]


_KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str) -> list[DataFrame]:
    """The items that are not empty, in blocks of about BLOCK_BYTES; one block at least."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("item")).where("length(item) > 0")
    total = items.agg(F.sum(F.octet_length("item"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    return [items.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(n)) == k) if n > 1 else items for k in range(n)]


def _pass(rows: DataFrame, block: DataFrame, q: int, share: float, regions: bool, every: bool) -> DataFrame:
    """(key, hits) of rows (key, text): of every row, or only of those with hits."""
    held = rows.sparkSession.sparkContext.broadcast([(r.item_id, r.item) for r in block.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(held.value, q, share, regions)
        for batch in batches:
            hits = _hits(index, batch.column(1))
            on = [every or bool(h) for h in hits]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(on, pa.bool_())), pa.array([h for h, x in zip(hits, on, strict=True) if x], _KIND)], names=["key", "hits"])

    return rows.mapInArrow(run, f"key long, hits {HITS}")


def _passes(docs: DataFrame, blocks: list[DataFrame], q: int, share: float, regions: bool, text: str) -> tuple[DataFrame, DataFrame, str]:
    """(docs, written, with a row number; (key, hits) of rows with hits; the number's name). Each block is a job, and the next begins when it has ended.

    So a task holds the index of one block, however many there are, and a pass writes only its hits.
    """
    row = "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in docs.columns)) + "row"
    kept = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate")
    found = [materialize(_pass(kept.select(F.col(row).alias("key"), F.col(f"`{text}`").cast("string").alias("text")), b, q, share, regions, False), "hits") for b in blocks]
    return kept, reduce(DataFrame.unionByName, found), row


def matches(docs: DataFrame, blocks: list[DataFrame], q: int, share: float, regions: bool = False) -> DataFrame:
    """(doc_id, hits) of every row (doc_id, text); rows stay apart whatever their ids. One block is searched as the rows are read."""
    if len(blocks) == 1:
        return _pass(docs.select("doc_id", "text"), blocks[0], q, share, regions, True).withColumnRenamed("key", "doc_id")
    kept, found, row = _passes(docs, blocks, q, share, regions, "text")
    each = found.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))  # of one row: at most one of each item
    return kept.select("doc_id", row).join(each, F.col(row) == F.col("key"), "left").select("doc_id", F.coalesce("hits", F.array().cast(HITS)).alias("hits"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, share: float = EDIT_SHARE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", regions: bool = True) -> DataFrame:
    """The rows of `docs` that hold no item, and by default no part of one.

    A row is judged by its own text, so ids may be null or repeated; null and empty texts stay; an empty table on
    either side changes nothing.
    """
    documents_of(docs, text_col=text_col)  # holds the Arrow batches to BATCH_BYTES
    blocks = _blocks(benchmark, item_col, item_text_col)
    if len(blocks) > 1:
        kept, found, row = _passes(docs, blocks, q, share, regions, text_col)
        return kept.join(found.select(F.col("key").alias(row)).distinct(), row, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])
    held = docs.sparkSession.sparkContext.broadcast([(r.item_id, r.item) for r in blocks[0].collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(held.value, q, share, regions)
        for batch in batches:
            yield batch.filter(pa.array([not h for h in _hits(index, batch.column(text_col))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, share: float = EDIT_SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", regions: bool = False) -> DataFrame:
    """(doc_id, is_contaminated, n_items, item_ids, hits) of every row.

    hits has for each item found the byte range of its best place (the start is the end less the item's
    length) and its edits; with regions=True, parts of items count too, and the range is that of the
    whole item, or else of its best part, in the text as it came. Defined cases: null or empty texts hold nothing, null or empty items are in
    nothing; items shorter than q bytes count where they stand unchanged; a repeated item_id counts
    once in item_ids; rows that repeat a doc_id, or have none, each get their own result; an empty table
    on either side finds nothing.
    """
    rows = documents_of(docs, id_col, text_col)
    found = matches(rows, _blocks(benchmark, item_col, item_text_col), q, share, regions)
    ids = F.array_sort(F.array_distinct("hits.item_id"))
    return found.select("doc_id", (F.size("hits") > 0).alias("is_contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), "hits")
