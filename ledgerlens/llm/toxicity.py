"""Toxicity by compression distance.

There are two zstandard dictionaries: one is trained on windows of ordinary texts, one holds those words
of toxic texts that have a contrasting n-gram (one that toxic texts have far oftener than ordinary ones). A
window is compressed with the ordinary dictionary, and with the toxic one placed before it; the
toxic dictionary can then only save bytes by what ordinary text lacks. Every window is one word with
a fixed run of ordinary text before it, so that frame costs cancel and equal windows are compressed
once in a worker. Letters are two bytes wide (UTF-16), which doubles what a match saves against what
it costs, so that short words show. The library's trainer passes over words shorter than its
segments, so the toxic dictionary is made of those words themselves, the commonest last (nearest).
With both dictionaries trained by the library, on running text of eight words, more toxic documents
were missed (figures in the README), so this form is kept.
A logistic calibration on other labelled documents turns the savings of a text's windows into a score.

Fitting uses at most N_TOXIC and N_ORDINARY labelled documents, those with the least hash of the
doc_id, and of near copies among them (that share IN_COMMON of eight MinHash values) one; one half trains
the dictionaries, the other the calibration.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim_memo, documents_of, materialize
from .neardup import minhashes, shingle_sets

N_TOXIC, N_ORDINARY = 3000, 6000
#: Contrasting n-grams: how much oftener in toxic documents (log odds), and in what share of them at least (and in two documents), at every size.
GRAM, LONGEST, CONTRAST, SUPPORT = 5, 24, 3.0, 0.06
ORDINARY_BYTES, LEVEL, WINDOW = 65536, 19, 8
#: Of eight MinHash values, so many in common make near copies.
IN_COMMON = 4
STEPS, MARGINS, MOST_KEPT, CUT = (2, 3, 4, 5, 6, 7), (1, 2, 3, 4), 300_000, 0.3
WIDE = "utf-16-le"
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_grams(word: str) -> set[str]:
    """All n-grams of the word between blanks (a shorter word is one), and its longer beginnings, up to the whole of it."""
    w = f" {word} "
    return {w[i : i + GRAM] for i in range(max(1, len(w) - GRAM + 1))} | {w[:k] for k in range(GRAM + 1, min(len(w), LONGEST) + 1)}


@dataclass
class Model:
    """What a worker needs to score texts. weights: of features(); None: no toxic label was there."""

    toxic: bytes
    ordinary: bytes
    weights: list[float] | None

    def key(self) -> int:
        return zlib.crc32(self.toxic + self.ordinary)


class Windows:
    """Bytes that the toxic dictionary saves on each window."""

    def __init__(self, model: Model):
        self.carrier = model.ordinary[-64:-32]
        self.kept: dict[str, int] = {}
        self.pair = []
        for content in (model.ordinary, model.toxic + model.ordinary):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def saved(self, word: str) -> int:
        n = self.kept.get(word)
        if n is None:
            if len(self.kept) >= MOST_KEPT:
                self.kept.clear()
            b = self.carrier + f" {word} ".encode(WIDE)
            ordinary, toxic = (len(c.compress(b)) for c in self.pair)
            n = self.kept[word] = ordinary - toxic
        return n

    def features(self, text: str | None) -> list[float]:
        """A constant, the greatest saving as steps, and how many distinct windows reach each margin, also for the text's size."""
        each = set(words(text))
        saved = [n for x in each if (n := self.saved(x)) > 0]
        top, root = max(saved, default=0), max(1, len(each)) ** 0.5
        hits = [sum(n >= m for n in saved) for m in MARGINS]
        return [1.0, *(float(top >= k) for k in STEPS), *map(math.log1p, hits), hits[1] / root, hits[2] / root]


_windows: dict[int, Windows] = {}


def windows(model: Model) -> Windows:
    claim_memo("toxicity", _windows.clear)
    if model.key() not in _windows:
        _windows.clear()
        _windows[model.key()] = Windows(model)
    return _windows[model.key()]


def _ordinary_content(samples: list[bytes]) -> bytes:
    """A trained dictionary's content; with too few samples to train one, the samples themselves."""
    try:
        d = zstandard.train_dictionary(ORDINARY_BYTES, samples, d=8, k=64).as_bytes()
        return d[min(len(d) // 4, 512) :]  # behind the header and entropy tables
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-ORDINARY_BYTES:].ljust(64)


def _toxic_content(samples: list[bytes]) -> bytes:
    """The words of the windows, the commonest last."""
    common = Counter(w for x in samples for w in x.decode(WIDE).split())
    return "".join(f" {w} " for w, _ in sorted(common.items(), key=lambda x: (x[1], x[0]))).encode(WIDE)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic].update(set().union(*map(word_grams, set(words(text)))))
    keys = list(counts[0] | counts[1])
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)], names=["gram", "ordinary", "toxic"])


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[int]]:
    """The bounded sample of labelled texts (text, toxic, half), and how many labelled documents each class has."""
    each = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = {r.toxic: r["count"] for r in each.groupBy("toxic").count().collect()}
    ids = []
    for toxic, most in ((0, N_ORDINARY), (1, N_TOXIC)):
        ids += [(r.doc_id, toxic) for r in each.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, toxic int")  # at most N_TOXIC + N_ORDINARY rows
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")
    texts = materialize(documents_of(docs).join(F.broadcast(chosen), "doc_id").withColumn("half", half).repartition(32), "toxic-sample")
    met: dict[tuple[int, int], list[int]] = {}
    kept = []
    for r in sorted(texts.mapInArrow(_minima, "doc_id long, minima array<long>").collect(), key=lambda r: r.doc_id):
        values = list(enumerate(r.minima))
        shared = Counter(d for v in values for d in met.get(v, ()))
        if max(shared.values(), default=0) < IN_COMMON:
            kept.append((r.doc_id,))
            for v in values:
                met.setdefault(v, []).append(r.doc_id)
    one = docs.sparkSession.createDataFrame(kept, "doc_id long")
    return texts.join(F.broadcast(one), "doc_id").select("text", "toxic", "half"), [n.get(0, 0), n.get(1, 0)]


def _minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Eight MinHash values of each text that has a word."""
    for batch in batches:
        sets = list(shingle_sets(batch.column("text")))
        some = [i for i, s in enumerate(sets) if len(s)]
        m = minhashes([sets[i] for i in some])[:, :8].view(np.int64).tolist() if some else []
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(some, pa.int64())), pa.array(m, pa.list_(pa.int64()))], names=["doc_id", "minima"])


def _training_windows(batches: Iterator[pa.RecordBatch], good: set[str]) -> Iterator[pa.RecordBatch]:
    """Windows of toxic texts' contrasting words, and of ordinary texts all windows."""
    for batch in batches:
        kind, out = [], []
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            w = words(text)
            if toxic:
                w = [x for x in w if not good.isdisjoint(word_grams(x))]
            cut = [(" " + " ".join(w[i : i + WINDOW]) + " ").encode(WIDE) for i in range(0, len(w), WINDOW)]
            kind += [toxic] * len(cut)
            out += cut
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(out, pa.binary())], names=["toxic", "cut"])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> list[float]:
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (weight * (p - y)) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: doc_id, text. labels: doc_id, toxic (0 or 1; null is no label; of several, the greatest)."""
    sample, totals = _sample(docs, labels)
    if not totals[1] or not totals[0]:
        return Model(b"", b"", None)
    train = sample.where("half = 0")
    sizes = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    n = [max(1, sizes.get(k, 0)) for k in (0, 1)]
    counts = train.select("text", "toxic").mapInArrow(_gram_counts, "gram string, ordinary long, toxic long").groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / n[1]) - F.log((F.col("ordinary") + 0.5) / n[0])
    good = {r.gram for r in counts.where((odds >= CONTRAST) & (F.col("toxic") >= 2) & (F.col("toxic") >= SUPPORT * n[1])).select("gram").collect()}
    cuts = train.select("text", "toxic").mapInArrow(lambda it: _training_windows(it, good), "toxic int, cut binary")
    by_class = [sorted(cuts.where(F.col("toxic") == k).select("cut").toArrow().column(0).to_pylist()) for k in (0, 1)]
    if not by_class[1] or not by_class[0]:
        return Model(b"", b"", None)
    model = Model(_toxic_content(by_class[1]), _ordinary_content(by_class[0]), None)
    rows = sample.where("half = 1").select("text", "toxic").mapInArrow(lambda it: _featured(it, model), "toxic int, x array<double>").collect()
    y = np.array([r.toxic for r in rows], float)
    if not len(y):
        return model
    share = np.array([totals[k] / max(1, (y == k).sum()) for k in (0, 1)])
    weight = share[y.astype(int)]
    model.weights = logistic(np.array([r.x for r in rows]), y, weight * len(y) / weight.sum())
    return model


def _featured(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    at = windows(model)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([at.features(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))], names=["toxic", "x"])


def _scores(column: pa.Array, model: Model) -> np.ndarray:
    if not model.weights:
        return np.zeros(len(column))
    at, w = windows(model), np.array(model.weights)
    x = np.array([at.features(t) for t in column.to_pylist()]).reshape(len(column), len(w))
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row, from its text alone.

    Defined cases: null and empty texts get the score of a text without a telling window; with no toxic
    label to learn from all get 0; repeated rows each get their result; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch.column(1), model), pa.float64())], names=["doc_id", "score"])

    return documents_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): learnt from the labels outside the held-out fold, for all documents."""
    model = fit(docs, labels.where(~held_out()))
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that classify() does not reject. A row is judged by its own text, so ids may be null or repeated."""
    model = fit(docs, labels.where(~held_out()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(text_col), model) < CUT))

    return docs.mapInArrow(run, docs.schema)
