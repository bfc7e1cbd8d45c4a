"""Exact substring deduplication by bucket-pointer refinement.

A byte goes if a `length`-byte string that covers it also starts in a document with a smaller id.
Suffixes are bucketed by their first q bytes, and only buckets that several documents share are
refined, by the buckets of the suffixes further on:

1. Texts equal to an earlier one go as a whole and take no further part.
2. Initial buckets. In each window of length - q + 1 suffixes those in the least bucket are its
   anchors, so equal strings have anchors in the same buckets at the same places. Documents are dealt
   into blocks of bounded size, and a block tells each of its buckets once, however many of its
   documents are in it. A shuffle on the bucket shows which are shared, and how large they are.
3. Anchors of shared buckets are sent to their buckets with the bytes that their strings span. A bucket
   of more than HOT suffixes is refined in the blocks first: there each string that several suffixes
   begin is kept once, and what is left is dealt out by the buckets of the string's first and last
   suffix, so that neither a common passage nor a common phrase becomes one task's work.
4. Refinement, see `refine`: suffixes of a bucket are sorted by the bucket pointers of the suffixes
   `depth` bytes further on, which doubles the depth; the pointers so updated serve the next round,
   until the depth is `length`. Pointers stand for bytes, not for hashes, so equal ones are equal strings.
   Equal contexts are refined as one, for the least of their documents, so copies cost no refinement.

The text is shuffled once, compressed; its exchange is shared by the steps that read it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, documents_of, gram_hashes, mix, slices, sliding, text_bytes

LENGTH, Q = 50, 20
#: Suffixes of a bucket beyond which it is refined in the blocks first; the result is the same either way.
HOT = 1 << 14
#: Contexts that are refined at once, those of one bucket at most, and bytes of text in a block.
PIECE, LARGEST, BLOCK_BYTES = 1 << 12, 1 << 15, 4 << 20
#: Blocks that one row lists for a text, so that no row grows with the corpus, however many blocks hold the text.
LISTED = 1 << 16


def anchors(b: np.ndarray, off: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions in b of the anchors of some texts, and their bucket numbers."""
    w = length - q + 1
    h = gram_hashes(b, q)
    if len(h) < w:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least = sliding(np.minimum, h, w)  # of each string, over its q-grams
    end = np.repeat(off[1:], np.diff(off))[: len(least)]
    valid = np.arange(len(least)) + length <= end
    least[~valid] = 0
    h |= np.uint64(1)
    least |= valid.astype(np.uint64)
    most = sliding(np.maximum, np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)]), w)
    at = np.flatnonzero(most[: len(h)] == h)
    return at, h[at]


def span_of(at: np.ndarray, h: np.ndarray, on: np.ndarray, off: np.ndarray, row: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """The byte range that holds the strings for which an anchor decides: those that reach neither neighbour with a lesser bucket."""
    reach, n = length - q, len(at)
    k = np.flatnonzero(on)
    a, e = np.maximum(at[k] - reach, off[row[k]]), np.minimum(at[k] + length, off[row[k] + 1])
    left, right = k - 1, k + 1
    near = left >= 0
    less = near & (h[np.maximum(left, 0)] < h[k])
    a = np.where(less, np.maximum(a, at[np.maximum(left, 0)] + 1), a)
    near = right < n
    less = near & (h[np.minimum(right, n - 1)] < h[k])
    e = np.where(less, np.minimum(e, at[np.minimum(right, n - 1)] - 1 + q), e)
    return a, np.maximum(e, at[k] + q)


# ---- bucket-pointer refinement ---------------------------------------------------------------


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values begin, and their sizes."""
    starts = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1]) if len(x) else np.empty(0, np.int64)
    return starts, np.diff(np.append(starts, len(x)))


def _deeper(pointer: np.ndarray, at: np.ndarray, depth: int, length: int, room: np.ndarray, doc: np.ndarray, alike: bool) -> np.ndarray:
    """Refine the buckets of the suffixes `at` (sorted by pointer) from `depth` to `length` bytes; pointers are updated in place.

    Buckets of one suffix, or with alike=False of one document, are settled and take no further part.
    """
    step = min(depth, length - depth)
    at = at[room[at] >= depth + step]
    starts, sizes = _runs(pointer[at])
    if not len(at):
        return at
    open_ = sizes > 1
    if not alike:
        open_ &= np.minimum.reduceat(doc[at], starts) < np.maximum.reduceat(doc[at], starts)
    at = at[np.repeat(open_, sizes)]
    if not step or not len(at):
        return at
    key = (pointer[at] << 32) | pointer[at + step]
    order = np.argsort(key)
    at, key = at[order], key[order]
    starts, sizes = _runs(key)
    bucket = key >> 32
    first, counts = _runs(bucket)
    pointer[at] = bucket + np.repeat(starts, sizes) - np.repeat(first, counts)
    return _deeper(pointer, at, depth + step, length, room, doc, alike)


def refine(b: np.ndarray, sizes: np.ndarray, doc: np.ndarray, length: int, alike: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, starts, counts): positions in b at which equal strings of `length` bytes begin, run after run.

    b: some rows of bytes one after the other, with their sizes and documents. Only strings that several
    documents hold are told, or with alike=True all that occur twice. The initial buckets are the first
    eight bytes of each suffix; a bucket's pointer is its place in the order of all suffixes.
    """
    n = len(b)
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
    owner = np.repeat(doc, sizes)
    depth = min(8, length)
    gram, padded = np.zeros(n, np.uint64), np.append(b, np.zeros(depth, np.uint8))
    for k in range(depth):
        gram = (gram << np.uint64(8)) | padded[k : k + n]
    at = np.flatnonzero(room >= depth)
    at = at[np.argsort(gram[at])]
    starts, counts = _runs(gram[at])
    pointer = np.zeros(n, np.int64)
    pointer[at] = np.repeat(starts, counts)
    at = _deeper(pointer, at, depth, length, room, owner, alike)
    return at, *_runs(pointer[at])


def _pack(b: np.ndarray, a: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the ranges that begin at a, and where each ends."""
    stop = np.cumsum(sizes)
    return b[np.repeat(a - stop + sizes, sizes) + np.arange(stop[-1] if len(stop) else 0)], stop


def _binary(flat: np.ndarray, stop: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(stop), [None, pa.py_buffer(np.concatenate([[0], stop]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def _merged(row: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the runs that strings at some positions cover, overlapping ones joined."""
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] > at[:-1] + length)]) if len(at) else np.empty(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    return row[first], at[first], at[last] + length


# ---- the steps -------------------------------------------------------------------------------


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, doc, z, own): each text compressed, as it is shuffled whole, and its digest."""
    z = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
        own = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(z.compress, texts), pa.binary()), own], names=["block", "doc", "z", "own"])


class Block:
    """A block's distinct (document, text) rows in a fixed order; copies: whether an earlier document has the whole text."""

    def __init__(self, rows: pa.Table, more: pa.Table):
        ids, own, z = rows.column("doc").to_pylist(), rows.column("own").to_pylist(), rows.column("z").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], own[i]))
        self.times: list[int] = []
        kept: list[int] = []
        for i in order:
            if kept and (ids[kept[-1]], own[kept[-1]]) == (ids[i], own[i]):
                self.times[-1] += 1
            else:
                kept.append(i)
                self.times.append(1)
        told = more.filter(pc.is_valid(more.column("digest")))
        least = dict(zip(told.column("digest").to_pylist(), told.column("least").to_pylist(), strict=True))
        self.ids = np.array([ids[i] for i in kept], np.int64)
        self.copies = np.array([least.get(own[i], ids[i]) < ids[i] for i in kept], bool)
        unpack = zstandard.ZstdDecompressor().decompress
        self.texts = [unpack(z[i]) for i in kept]
        self.number = rows.column("block")[0].as_py() if rows.num_rows else 0

    def parts(self, length: int, q: int) -> Iterator[tuple]:
        """(bytes, row offsets, row numbers, anchors, their buckets) of the texts that are no copies, piece by piece."""
        rows = np.flatnonzero(~self.copies)
        b, off = text_bytes(pa.array([self.texts[i] for i in rows], pa.large_binary()))
        for lo, hi in slices(off):
            part, s = off[lo : hi + 1] - off[lo], b[off[lo] : off[hi]]
            at, h = anchors(s, part, length, q)
            if len(at):
                yield s, part, rows[lo:hi], at, h


def _table(schema: pa.Schema, *columns) -> pa.Table:
    return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


BUCKETS = pa.schema([("h", pa.int64()), ("block", pa.int64()), ("n", pa.int64())])


def _buckets(rows: pa.Table, more: pa.Table, length: int, q: int) -> pa.Table:
    """(h, block, n) of each bucket in a block: its anchors, as a negative number if they are of several documents."""
    block = Block(rows, more)
    found = [(h, block.ids[which[np.searchsorted(part, at, side="right") - 1]]) for _, part, which, at, h in block.parts(length, q)]
    if not found:
        return _table(BUCKETS, [], [], [])
    h, doc = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    starts, n = _runs(h)
    several = np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts)
    return _table(BUCKETS, h[starts].view(np.int64), np.full(len(starts), block.number), np.where(several, -n, n))


def _shared(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """From (h, block, n) sorted by h: (block, h, hot) of the buckets that several documents share; hot: more than `most` suffixes.

    Of a bucket's rows at most `most` are held back until it is known to be hot.
    """
    held, hot = None, None
    for batch in batches:
        rows = np.stack([batch.column(k).to_numpy() for k in ("h", "block", "n")])
        if held is not None:
            rows = np.concatenate([held, rows], axis=1)
        if not rows.shape[1]:
            continue
        starts, sizes = _runs(rows[0])
        total = np.add.reduceat(np.abs(rows[2]), starts)
        total[0] += (most + 1) * (rows[0, 0] == hot)
        if total[-1] > most:
            hot, held, m = rows[0, -1], None, len(starts)
        else:
            held, m = rows[:, starts[-1] :], len(starts) - 1
        yield _told(rows[:, : rows.shape[1] if held is None else starts[-1]], starts[:m], sizes[:m], total[:m], most)
    if held is not None:
        starts, sizes = _runs(held[0])
        yield _told(held, starts, sizes, np.add.reduceat(np.abs(held[2]), starts), most)


def _told(rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray, total: np.ndarray, most: int) -> pa.RecordBatch:
    several = (sizes > 1) | (np.minimum.reduceat(rows[2], starts) < 0) | (total > most) if len(starts) else np.empty(0, bool)
    on = np.repeat(several, sizes)
    return pa.RecordBatch.from_arrays([pa.array(rows[1][on]), pa.array(rows[0][on]), pa.array(np.repeat(total > most, sizes)[on])], names=["block", "h", "hot"])


CONTEXTS = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("block", pa.int64()), ("r", pa.int64()), ("at", pa.int64()), ("bytes", pa.binary()), ("also", pa.binary()), ("e", pa.int64())])


def _contexts(rows: pa.Table, more: pa.Table, length: int, q: int) -> pa.Table:
    """The bytes (from `at` in row r) around each anchor in a shared bucket, keyed by the bucket; of hot buckets see _strings."""
    block, said = Block(rows, more), more.filter(pc.is_valid(more.column("h")))
    known, heat = said.column("h").to_numpy().view(np.uint64), said.column("hot").to_numpy(zero_copy_only=False).astype(bool)
    order = np.argsort(known)
    known, heat = known[order], heat[order]
    cold, hot = [], []
    for s, part, which, at, h in block.parts(length, q):
        if not len(known):
            break
        k = np.minimum(np.searchsorted(known, h), len(known) - 1)
        on = known[k] == h
        row = np.searchsorted(part, at, side="right") - 1
        a, e = span_of(at, h, on, part, row, length, q)
        key, row, is_hot = h[on], row[on], heat[k[on]]
        for chosen, to in ((~is_hot, cold), (is_hot, hot)):
            if chosen.any():
                flat, stop = _pack(s, a[chosen], (e - a)[chosen])
                to.append((key[chosen], which[row[chosen]], (a - part[row])[chosen], (e - a)[chosen], flat))
    out = [_table(CONTEXTS, key.view(np.int64), block.ids[r], np.full(len(r), block.number), r, at, _binary(flat, np.cumsum(sizes)), pa.nulls(len(r), pa.binary()), pa.nulls(len(r), pa.int64())) for key, r, at, sizes, flat in cold]
    if hot:
        out += _strings(block, *(np.concatenate(x) for x in zip(*hot, strict=True)), length, q)
    return pa.concat_tables(out) if out else CONTEXTS.empty_table()


def _strings(block: Block, key: np.ndarray, r: np.ndarray, at: np.ndarray, sizes: np.ndarray, flat: np.ndarray, length: int, q: int) -> Iterator[pa.Table]:
    """Contexts of hot buckets by string: each once, for its earliest document in the block, keyed by the buckets of its two ends.

    `also` has the other places (r, at) where that document holds it. Later documents' strings come
    without bytes, as the ranges (r, at, e) that go.
    """
    begin, order = np.cumsum(sizes) - sizes, np.argsort(key, kind="stable")
    for lo in range(0, len(order), 2 * PIECE):
        k = order[lo : lo + 2 * PIECE]
        b, stop = _pack(flat, begin[k], sizes[k])
        context = np.repeat(np.arange(len(k)), sizes[k])
        place = at[k][context] + np.arange(len(b)) - (stop - sizes[k])[context]
        row, doc = r[k], block.ids[r[k]]
        pos, starts, counts = refine(b, sizes[k], doc, length, alike=True)
        owner = doc[context[pos]]
        least = np.repeat(np.minimum.reduceat(owner, starts), counts) if len(pos) else owner
        gone = pos[owner > least]
        span, a, e = _merged(context[gone], place[gone], length)
        yield _table(CONTEXTS, mix(a.view(np.uint64) * BASE + row[span].view(np.uint64)).view(np.int64), doc[span], np.full(len(span), block.number), row[span], a, pa.nulls(len(span), pa.binary()), pa.nulls(len(span), pa.binary()), e)
        alone = stop[context] - np.arange(len(b)) >= length  # the strings, then those that occur once
        alone[pos] = False
        alone = np.flatnonzero(alone)
        mine = np.flatnonzero(owner == least)
        run = np.repeat(np.arange(len(starts)), counts)[mine]
        first, n = _runs(run)
        reps = np.concatenate([pos[mine[first]], alone])
        also: list[bytes | None] = [None] * len(reps)
        for i in np.flatnonzero(n > 1).tolist():
            others = pos[mine[first[i] + 1 : first[i] + n[i]]]
            also[i] = np.stack([row[context[others]], place[others]]).tobytes()
        gram = gram_hashes(b, q)
        ends = mix(mix(gram[reps] * BASE) + gram[reps + length - q]).view(np.int64)
        c = context[reps]
        yield _table(CONTEXTS, ends, doc[c], np.full(len(reps), block.number), row[c], place[reps], _binary(_pack(b, reps, np.full(len(reps), length))[0], np.arange(1, len(reps) + 1) * length), pa.array(also, pa.binary()), pa.nulls(len(reps), pa.int64()))


SPANS = ["block", "r", "a", "e", "also"]


def _refined(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(block, r, a, e, also): byte ranges that go, from the contexts sorted by (key, doc); whole buckets at once, in pieces of a bounded size.

    A range that is one string goes at the places in `also`, too. Only the strings of a hot bucket can fill LARGEST rows with one key. They come by document, so the
    earliest document of each is in the first piece that holds it, and is kept for the next ones.
    """
    held: list[pa.Table] = []
    earliest: dict[bytes, int] = {}
    last = None
    for batch in batches:
        done = batch.filter(pc.is_valid(batch.column("e")))
        yield pa.RecordBatch.from_arrays([done.column(k) for k in ("block", "r", "at", "e", "also")], names=SPANS)
        held.append(pa.Table.from_batches([batch.filter(pc.is_null(batch.column("e")))]))
        n = sum(t.num_rows for t in held)
        if n < PIECE:
            continue
        t = pa.concat_tables(held)
        starts, _ = _runs(t.column("key").to_numpy())
        if len(starts) == 1 and n < LARGEST:
            continue
        cut = int(starts[-1]) or n
        if t.column("key")[0].as_py() != last:
            earliest.clear()
        last = t.column("key")[0].as_py() if len(starts) == 1 else None
        yield _gone(t.slice(0, cut), length, earliest if earliest or len(starts) == 1 else None)
        held = [t.slice(cut)]
    if held:
        t = pa.concat_tables(held)
        if t.num_rows:
            yield _gone(t, length, earliest if t.column("key")[0].as_py() == last else None)


def _gone(t: pa.Table, length: int, earliest: dict[bytes, int] | None) -> pa.RecordBatch:
    """The ranges that go of some contexts. earliest: documents of strings that were met before, and of those met now.

    Equal contexts are refined as one, for their least document; of the others' rows all bytes go. A context
    without a different one beside it in its bucket is settled and takes no part in refinement.
    """
    told = t.column("bytes").combine_chunks().dictionary_encode()
    b, off = text_bytes(told.dictionary)
    which, sizes = told.indices.to_numpy(), np.diff(off)
    key, doc, block, r, at = (t.column(k).to_numpy() for k in ("key", "doc", "block", "r", "at"))
    least = np.full(len(sizes), np.iinfo(np.int64).max)
    np.minimum.at(least, which, doc)
    starts, counts = _runs(key)
    mixed = np.minimum.reduceat(which, starts) < np.maximum.reduceat(which, starts)
    on = np.zeros(len(sizes), bool)
    on[which[np.repeat(mixed, counts)]] = True
    on = np.flatnonzero(on)
    flat, stop = _pack(b, off[on], sizes[on])
    pos, starts, counts = refine(flat, sizes[on], least[on], length)
    c = np.searchsorted(stop, pos, side="right")
    owner = least[on[c]]
    gone = owner > np.repeat(np.minimum.reduceat(owner, starts), counts) if len(pos) else np.empty(0, bool)
    gone = (pos + (off[on] - stop + sizes[on])[c])[gone]
    if earliest is not None:
        more = []
        for d, lo, hi in zip(least.tolist(), off.tolist(), (off[1:] - length + 1).tolist(), strict=False):
            more += [p for p in range(lo, hi) if earliest.setdefault(b[p : p + length].tobytes(), d) < d]
        gone = np.union1d(gone, np.array(more, np.int64))
    c = np.searchsorted(off, gone, side="right") - 1
    span, a, e = _merged(c, gone - off[c], length)
    n = np.bincount(span, minlength=len(sizes))
    first = np.flatnonzero(doc == least[which])
    copies = np.flatnonzero((doc > least[which]) & (sizes[which] >= length))
    n, begin = n[which[first]], (np.cumsum(n) - n)[which[first]]
    k = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
    row = np.concatenate([np.repeat(first, n), copies])
    a, e = np.concatenate([a[k], np.zeros(len(copies), np.int64)]), np.concatenate([e[k], sizes[which[copies]]])
    also = t.column("also").take(pa.array(row))
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (block[row], r[row], at[row] + a, at[row] + e)] + [also.combine_chunks()], names=SPANS)


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _cut(rows: pa.Table, more: pa.Table, length: int) -> pa.Table:
    block, said = Block(rows, more), more.filter(pc.is_valid(more.column("r")))
    spans: dict[int, list[tuple[int, int]]] = {}
    for r, a, e, also in zip(*(said.column(k).to_pylist() for k in SPANS[1:]), strict=True):
        spans.setdefault(r, []).append((a, e))
        if also is not None:
            for other, place in zip(*np.frombuffer(also, np.int64).reshape(2, -1).tolist(), strict=True):
                spans.setdefault(other, []).append((place, place + length))
    out = []
    for r, text in enumerate(block.texts):
        s = sorted(spans.get(r, ()))
        if block.copies[r] and len(text) >= length:
            s = [(0, len(text))]
        kept, at, n = [], 0, 0
        for a, e in s:
            if a > at or not n:
                kept.append(text[at:a])
                n += 1
            at = max(at, e)
        kept.append(text[at:])
        out += [_row(int(block.ids[r]), text, b"".join(kept), n)] * block.times[r]
    return pa.Table.from_pylist(out, schema=RESULT)


def _row(doc: int | None, text: bytes, left: bytes, n: int) -> dict:
    return {"doc_id": doc, "n_bytes": len(text), "n_removed": len(text) - len(left), "n_spans": n, "kept_sha256": hashlib.sha256(left).hexdigest(), "kept": left}


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_pylist([_row(None, t, t, 0) for t in texts], schema=RESULT)


def _copies(dealt: DataFrame, n_blocks: int) -> DataFrame:
    """(block, digest, least): each text that several documents have, in each block that holds it, with its least document.

    A row lists LISTED blocks at most. With more blocks than that a text has a row for each of some lists;
    all of them meet the text's least document by a join, at eight bytes for 4 MB of the corpus.
    """
    digests = dealt.select("block", "doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    held = F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.collect_set("block").alias("blocks")
    lists = -(-n_blocks // LISTED)
    if lists == 1:
        several = digests.groupBy("digest").agg(*held).where("least < most")
    else:
        parts = digests.groupBy("digest", F.pmod("block", F.lit(lists))).agg(*held)
        totals = parts.groupBy("digest").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least < most")
        several = parts.select("digest", "blocks").join(totals, "digest")
    return several.select(F.explode("blocks").alias("block"), "digest", "least")


def substring_dedup(docs: DataFrame, length: int = LENGTH, q: int = Q, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is left of every document without the strings of `length` bytes that an earlier one has.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and the kept bytes
    if asked for. 1 <= q <= length must hold. Defined cases: null text counts as empty; texts under
    `length` bytes lose nothing; rows that repeat a doc_id are one document's parts, none earlier than
    the other (give distinct ids to compare them); a row with null doc_id is not compared and keeps
    all; an empty table gives no rows; other columns are ignored.
    """
    if not 1 <= q <= length:
        raise ValueError("q must be from 1 to length")
    rows = documents_of(docs, id_col, text_col)
    spark = docs.sparkSession
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(-(-total // BLOCK_BYTES), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.where("doc_id is not null").select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).alias("block"), "doc_id", "text")
    # every step reads the text under the same plan, so that its exchange is made once
    whole = dealt.mapInArrow(_squeeze, "block long, doc long, z binary, own binary")
    copies = _copies(dealt.where(F.octet_length("text") >= length), n_blocks)

    def by_block(more: DataFrame, f, schema: str) -> DataFrame:
        return whole.groupBy("block").cogroup(more.groupBy("block")).applyInArrow(f, schema)

    n, hot = (length, q), HOT
    buckets = by_block(copies, lambda a, b: _buckets(a, b, *n), "h long, block long, n long")
    shared = buckets.repartition("h").sortWithinPartitions("h").mapInArrow(lambda it: _shared(it, hot), "block long, h long, hot boolean")
    contexts = by_block(shared.unionByName(copies, allowMissingColumns=True), lambda a, b: _contexts(a, b, *n), "key long, doc long, block long, r long, at long, bytes binary, also binary, e long")
    spans = contexts.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(lambda it: _refined(it, length), "block long, r long, a long, e long, also binary")
    kept = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", ", kept binary")
    columns = [c.split()[0] for c in kept[0].split(", ")] + ["kept"] * with_text
    out = by_block(spans.unionByName(copies, allowMissingColumns=True), lambda a, b: _cut(a, b, length).select(columns), kept[0] + kept[1] * with_text)
    return out.unionByName(rows.where("doc_id is null").mapInArrow(_whole, "".join(kept)).select(columns))
