"""Interleaved document sequences with media.

`sequences` parses HTML into ordered text and media-reference structs: a reference has the media's
digest and its caption (the figure's, else the alternative text). `resolve` joins references with a
media table by digest. A media payload is stored as an 8-bit greyscale PNG of 192 columns, losslessly,
and `features` are computed from the bytes that were stored.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, materialize

WIDTH, SCHEME = 192, "sha256:"
#: Digests that can be hot at most, and the groups that one is dealt over.
MOST_HOT, SPREAD = 1000, 64
_BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "figure", "figcaption", "table", "tr", "td", "th", "ul", "ol", "br", "hr", "pre", "blockquote", "main", "header", "footer", "nav", "aside", "title", "body", "html"}
_SILENT = {"script", "style", "head", "template", "noscript"}


class _Walk(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.parts: list[str] = []
        self.silent, self.figure, self.caption = 0, -1, False

    def flush(self) -> None:
        text = "".join(self.parts).strip()
        self.parts = []
        if not text:
            return
        if self.caption:
            if 0 <= self.figure < len(self.items):
                for item in self.items[self.figure :]:
                    if item["kind"] == "media":
                        item["caption"] = text
            return
        self.items.append({"kind": "text", "text": text, "ref": None, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SILENT:
            self.silent += 1
        if tag in _BLOCKS or tag in ("img", "audio", "video"):
            self.flush()
        if tag == "figure":
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.caption = True
        elif tag in ("img", "audio", "video") and not self.silent:
            found = dict(attrs)
            ref = found.get("src") or ""
            self.items.append({"kind": "media", "text": None, "ref": ref, "digest": ref[len(SCHEME) :] if ref.startswith(SCHEME) else None, "caption": found.get("alt") or None})

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        if tag in _BLOCKS:
            self.flush()
        if tag == "figcaption":
            self.caption = False
        elif tag == "figure":
            self.figure, self.caption = -1, False

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)


def parse(page: str | None) -> list[dict]:
    """The page's items in order, with pos, kind, text, ref, digest and caption."""
    if not page:
        return []
    walk = _Walk()
    walk.feed(page)
    walk.close()
    walk.flush()
    return [{"pos": k, **item} for k, item in enumerate(walk.items)]


ITEM = [("pos", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("digest", pa.string()), ("caption", pa.string())]
ITEMS = "array<struct<pos:long,kind:string,text:string,ref:string,digest:string,caption:string>>"


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(doc_id, items) of every page. Null and empty pages have no item; repeated rows each get theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parse(p) for p in batch.column(1).to_pylist()], pa.list_(pa.struct(ITEM)))], names=["doc_id", "items"])

    return documents_of(pages, id_col, html_col).mapInArrow(run, f"doc_id long, items {ITEMS}")


def resolve(items: DataFrame, media: DataFrame) -> DataFrame:
    """One row for each item of `items` (doc_id, items; a written table, for it is read more than once), with the media table's columns where its digest is known.

    media: digest, and any columns; of rows with one digest the joined values are those of any, for
    equal digests mean equal media. Text items, and references without or with an unknown digest, stay
    with nulls, so positions and captions stay complete. Digests that more than a MOST_HOT-th of the
    references name are dealt over SPREAD groups. `rebuild` puts the sequences together again.
    """
    long = items.select("doc_id", F.explode("items").alias("i")).select("doc_id", "i.*")
    once = media.where("digest is not null").dropDuplicates(["digest"])
    known = long.where("digest is not null")
    counts = known.groupBy("digest").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = [r.digest for r in counts.where(F.col("count") > max(1, total // MOST_HOT)).select("digest").collect()]  # at most MOST_HOT digests
    is_hot = F.col("digest").isin(hot) if hot else F.lit(False)
    spread = F.when(is_hot, F.pmod(F.xxhash64("pos", "ref", F.monotonically_increasing_id()), F.lit(SPREAD))).otherwise(0)
    spots = F.when(is_hot, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    found = known.withColumn("_spot", spread.cast("int")).join(once.withColumn("_spot", F.explode(spots)), ["digest", "_spot"], "left").drop("_spot")
    # items without a digest need no join, in which they would all meet in one task
    return found.unionByName(long.where("digest is null"), allowMissingColumns=True).select(*long.columns, *[c for c in once.columns if c != "digest"])


def rebuild(resolved: DataFrame) -> DataFrame:
    """(doc_id, items): the rows of resolve() as one sequence for each document in order of pos; an item has all of resolve()'s columns.

    Rows that repeat a doc_id come together; give distinct ids to keep them apart.
    """
    rest = [c for c in resolved.columns if c not in ("doc_id", "pos")]
    return resolved.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", *rest))).alias("items"))


def padded(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, the text's bytes with blanks up to a positive multiple of WIDTH)."""
    b = (text or "").encode()
    return len(b), b.ljust(max(1, -(-len(b) // WIDTH)) * WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 1) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row after its filter type, 0
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of an image that to_png made; every checksum is verified."""
    at, data, width = 8, [], 0
    while at < len(image):
        n = struct.unpack(">I", image[at : at + 4])[0]
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk of the image is damaged")
        if kind == b"IHDR":
            width = struct.unpack(">I", body[:4])[0]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
    if raw[:, 0].any():
        raise ValueError("only rows without a filter are read")
    return raw[:, 1:].tobytes()


def sample_features(payload: bytes) -> str:
    """Size, mean and variance in thousandths, extremes, and the samples' histogram in eight bins."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    v = np.arange(256)
    n, s, q = len(x), int(counts @ v), int(counts @ (v * v))
    bins = ",".join(map(str, counts.reshape(8, 32).sum(1).tolist()))
    present = np.flatnonzero(counts)
    return f"{WIDTH}x{n // WIDTH};mean={s * 1000 // n};var={(q * n - s * s) * 1000 // (n * n)};min={present[0]};max={present[-1]};hist={bins}"


def store(docs: DataFrame, label: str = "media") -> DataFrame:
    """Write each row's text as media: (digest of the payload, bytes without padding, the image), read back from the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(hashlib.sha256(p).hexdigest() + f"-{n}", n, to_png(p)) for n, p in map(padded, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.binary())], names=["digest", "n_bytes", "image"])

    return materialize(docs.mapInArrow(run, "digest string, n_bytes long, image binary"), label)


FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """What the stored images hold: one row for each row of `media`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, n, image in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p = from_png(image)
                rows.append((digest, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(image), hashlib.sha256(image).hexdigest(), sample_features(p)))
            names = [x.split()[0] for x in FEATURES.split(", ")]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return media.select("digest", "n_bytes", "image").mapInArrow(run, FEATURES)


def page_of(text: str | None) -> str:
    """An article of the text's lines, with the text's own media as a figure behind the first line."""
    n, p = padded(text)
    lines = [f"<p>{html.escape(x, quote=False)}</p>" for x in (text or "").split("\n")]
    figure = f'<figure><img src="{SCHEME}{hashlib.sha256(p).hexdigest()}-{n}"><figcaption>{n} bytes</figcaption></figure>'
    return f"<article>{lines[0]}{figure}{''.join(lines[1:])}</article>"


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's text as an interleaved document whose media is the text's own payload, resolved from the store.

    Returns doc_id, the stored media's features, pos and caption of the reference, and n_texts (text
    items of the document). Equal texts have equal values. Defined cases: null counts as empty, whose
    payload is one row of blanks; rows that repeat a doc_id each get their row; a null doc_id stays; an
    empty table gives no rows. Only digests and features are shuffled; images stay where they are stored.
    """
    rows = documents_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refs, count = [], []
            for text in batch.column(1).to_pylist():
                items = parse(page_of(text))
                refs.append([{**i, "text": None} for i in items if i["kind"] == "media"])
                count.append(len(items) - len(refs[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(refs, pa.list_(pa.struct(ITEM)))], names=["doc_id", "n_texts", "items"])

    parsed = rows.mapInArrow(run, f"doc_id long, n_texts long, items {ITEMS}")
    refs = materialize(parsed.select(F.struct("doc_id", "n_texts").alias("doc_id"), "items"), "references")  # small; resolve() reads them more than once
    found = resolve(refs, features(store(rows)))
    return found.select("doc_id.doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption", "doc_id.n_texts")
