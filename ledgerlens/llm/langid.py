"""Language identification by rank-order profiles.

A profile is the list of a language's (or a document's) most frequent letter n-grams, n = 1 to 3, of
lower-cased words with a blank on either side. A document's distance to a language is the sum over
its profile of how far each n-gram is out of place there, and the most that can be if it is missing.
Counts are made by numpy inside the tasks; languages' counts are summed over all labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents_of

PROFILE, NO_LANGUAGE = 300, "und"
_BITS = 21


def _letters() -> np.ndarray:
    """For each code point of the basic plane its lower-case letter, or a blank."""
    out = np.full(1 << 16, 32, np.int64)
    for c in range(1 << 16):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_table: list[np.ndarray] = []


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text; none if it has no letter."""
    if not _table:
        _table.append(_letters())
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    high = points >= 1 << 16
    c = _table[0][np.where(high, 32, points)]
    if high.any():
        c = np.where(high & np.array([chr(p).isalpha() for p in points.tolist()]), points, c)
    c = np.concatenate([[32], c, [32]])
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    if len(c) < 3:
        return np.empty(0, np.int64)
    two = (c[:-1] << _BITS) | c[1:]
    three = (two[:-1] << _BITS) | c[2:]
    return np.concatenate([c[c != 32], two, three])


def ranked(codes: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent codes, most frequent first; of equal counts the smaller code first."""
    values, counts = np.unique(codes, return_counts=True)
    if len(values) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        on = counts >= least
        values, counts = values[on], counts[on]
    return values[np.lexsort((values, -counts))][:most]


def profiles(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", most: int = PROFILE) -> dict[str, np.ndarray]:
    """Each language's profile, from all rows that have a language. At most `most` n-grams of each go to the driver."""
    documents_of(docs, id_col, text_col)  # for its batch size
    both = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("lang is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            waiting: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                waiting.setdefault(lang, []).append(grams(text))
            for lang, lists in waiting.items():
                v, n = np.unique(np.concatenate(lists), return_counts=True)
                if lang in held:
                    v, at = np.unique(np.concatenate([held[lang][0], v]), return_inverse=True)
                    n = np.bincount(at, np.concatenate([held[lang][1], n])).astype(np.int64)
                held[lang] = v, n
        for lang, (v, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(v)), pa.array(v), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    total = both.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = total.withColumn("rank", first).where(F.col("rank") <= most).collect()
    out: dict[str, np.ndarray] = {}
    for lang in sorted({r.lang for r in top}):
        out[lang] = np.array([r.gram for r in sorted((r for r in top if r.lang == lang), key=lambda r: r["rank"])], np.int64)
    return out


class Ranks:
    """All profiles' n-grams, sorted, with the rank that each has in each language."""

    def __init__(self, by_lang: dict[str, np.ndarray], most: int = PROFILE):
        self.langs, self.most = list(by_lang), most
        self.codes = np.unique(np.concatenate([np.empty(0, np.int64), *by_lang.values()]))
        self.rank = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)
        for k, p in enumerate(by_lang.values()):
            self.rank[k, np.searchsorted(self.codes, p)] = np.arange(len(p))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the nearest profile, and by what part the next one is farther; of equal distances the first by name."""
        codes = grams(text) if text else np.empty(0, np.int64)
        if not len(codes) or not self.langs:
            return NO_LANGUAGE, 0.0
        own = ranked(codes, self.most)
        at = np.searchsorted(self.codes, own)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        there = self.rank[:, at]
        distance = np.where(there < 0, self.most, np.abs(there - np.arange(len(own)))).sum(1)
        k = int(distance.argmin())
        if len(self.langs) == 1:
            return self.langs[0], 1.0
        second = np.partition(distance, 1)[1]
        return self.langs[k], float(1 - distance[k] / second) if second else 0.0


def predict(docs: DataFrame, by_lang: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row; null texts and those without a letter get `und` and 0."""
    held = docs.sparkSession.sparkContext.broadcast(by_lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks(held.value)
        for batch in batches:
            got = [ranks.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return documents_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learnt from the documents of the other four folds, predicted for all.

    Defined cases: rows without lang are only predicted; a null doc_id is in no held-out fold; with no
    labelled row every prediction is `und`; repeated rows count as often in the profiles; an empty
    table gives no rows; other columns are ignored.
    """
    learnt = profiles(docs.where(~held_out()))
    out = predict(docs, learnt)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
