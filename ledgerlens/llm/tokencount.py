"""Unigram token counts on a shared trie.

Pieces come from a tokenizer's vocabulary file; a piece's score is the logarithm of a Zipf prior on
its rank, since such files rank pieces and hold no probabilities. A pre-token is a run without white
space, after a mark for its start, or the ASCII punctuation that such a run ends with, if it is more
than that. It is cut so that the scores' sum is greatest. The distinct pre-tokens are put in a trie, laid
out as their sorted list: a node is a prefix, kept in the row where it first occurs, and later rows
refer to it. A node's best score and number of tokens come from the nodes above it, once however
many pre-tokens share the prefix, for all nodes of one depth at a time; the count at a pre-token's
last node is its token count. A document adds up the counts of its runs.

Each worker keeps the counts of the runs it has met and starts afresh beyond MOST_KNOWN; that
changes no result.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BASE, claim_memo, documents_of, mix, without_collector

MOST_KNOWN, MOST_LENGTH, ROWS, MARK = 500_000, 64, 20_000, "▁"
PUNCTUATION = string.punctuation
_TABLE_BITS = 20

_tries: dict[str, Trie] = {}


def piece_scores(path: str) -> tuple[dict[str, float], list[float]]:
    """The pieces' scores, and those of the 256 single bytes for letters that no piece has."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    total = math.log(sum(1 / (i + 1) for i in range(n)))
    score = lambda i: -math.log(i + 1) - total
    pieces = {p.id_to_piece(i): score(i) for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))}
    return pieces, [score(p.piece_to_id(f"<0x{b:02X}>")) for b in range(256)]


class Trie:
    def __init__(self, path: str):
        self.scores, self.bytes = piece_scores(path)
        self.longest = max(map(len, self.scores))
        self.powers = np.array([pow(int(BASE), k, 2**64) for k in range(MOST_LENGTH + 1)], np.uint64)
        pieces = [p for p in self.scores if len(p) > 1]
        keys = np.array([self._key(p) for p in pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array([self.scores[p] for p in pieces])[order]
        self.table = np.zeros(1 << _TABLE_BITS, bool)  # a bit for each piece, which most other strings miss
        self.table[self.keys >> np.uint64(64 - _TABLE_BITS)] = True
        self.singles: dict[str, tuple[float, int]] = {}
        self.known: dict[str, int] = {}

    def _key(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c)) % 2**64
        return int(mix(np.array([h], np.uint64))[0])

    def single(self, c: str) -> tuple[float, int]:
        """Score and tokens of one letter: its piece, or its UTF-8 bytes."""
        if c not in self.singles:
            s = self.scores.get(c)
            raw = c.encode("utf-8", "replace")
            self.singles[c] = (s, 1) if s is not None else (sum(self.bytes[b] for b in raw), len(raw))
        return self.singles[c]

    def alone(self, text: str) -> int:
        """The count of one pre-token without a trie, for very long ones."""
        best, count = [0.0], [0]
        for d in range(1, len(text) + 1):
            s, n = self.single(text[d - 1])
            top, tokens = best[d - 1] + s, count[d - 1] + n
            for i in range(d - 2, max(-1, d - self.longest - 1), -1):
                s = self.scores.get(text[i:d])
                if s is not None and best[i] + s >= top:
                    top, tokens = best[i] + s, count[i] + 1
            best.append(top)
            count.append(tokens)
        return count[-1]

    def counts(self, texts: list[str]) -> np.ndarray:
        """The counts of distinct sorted pre-tokens of at most MOST_LENGTH letters. Of equal scores the longest last piece counts."""
        if not texts:
            return np.empty(0, np.int64)
        n, sizes = len(texts), np.array(list(map(len, texts)))
        letters = np.array(texts, f"U{sizes.max()}").view(np.uint32).reshape(n, -1)
        width = letters.shape[1]
        # a prefix is new in a row if the row before does not begin with it
        same = np.zeros((n, width), bool)
        same[1:] = np.logical_and.accumulate(letters[1:] == letters[:-1], axis=1)
        each, back = np.unique(letters, return_inverse=True)
        one = [self.single(chr(c)) for c in each.tolist()]
        one_score, one_count, back = np.array([x[0] for x in one]), np.array([x[1] for x in one]), back.reshape(n, width)
        hashes = np.zeros((n, width + 1), np.uint64)
        best, count = np.zeros((n, width + 1)), np.zeros((n, width + 1), np.int64)
        for d in range(1, width + 1):
            hashes[:, d] = hashes[:, d - 1] * BASE + letters[:, d - 1]
            inside = sizes >= d
            new = np.flatnonzero(inside & ~same[:, d - 1])
            k = back[new, d - 1]
            top, tokens = best[new, d - 1] + one_score[k], count[new, d - 1] + one_count[k]
            for size in range(2, min(d, self.longest) + 1):
                h = mix(hashes[new, d] - hashes[new, d - size] * self.powers[size])
                hit = np.flatnonzero(self.table[h >> np.uint64(64 - _TABLE_BITS)])
                if not len(hit):
                    continue
                at = np.minimum(np.searchsorted(self.keys, h[hit]), len(self.keys) - 1)
                real = self.keys[at] == h[hit]
                hit, at = hit[real], at[real]
                s = best[new[hit], d - size] + self.values[at]
                better = s >= top[hit]
                hit = hit[better]
                top[hit], tokens[hit] = s[better], count[new[hit], d - size] + 1
            best[new, d], count[new, d] = top, tokens
            first = np.zeros(n, np.int64)
            first[new] = new
            first = np.maximum.accumulate(first)  # the row where this row's prefix is kept
            old = np.flatnonzero(inside & same[:, d - 1])
            best[old, d], count[old, d] = best[first[old], d], count[first[old], d]
        return count[np.arange(n), sizes]

    def learn(self, runs: set[str]) -> None:
        """Counts of runs that are not known yet: of the run, and of the punctuation at its end."""
        parts: dict[str, tuple[str, str]] = {}
        for r in runs:
            stem = r.rstrip(PUNCTUATION)
            parts[r] = (MARK + stem, r[len(stem) :]) if 0 < len(stem) < len(r) else (MARK + r, "")
        texts = sorted({x for p in parts.values() for x in p if 0 < len(x) <= MOST_LENGTH})
        found: dict[str, int] = {"": 0}
        for i in range(0, len(texts), ROWS):
            found.update(zip(texts[i : i + ROWS], self.counts(texts[i : i + ROWS]).tolist(), strict=True))
        for r, (a, b) in parts.items():
            self.known[r] = (found[a] if a in found else self.alone(a)) + (found[b] if b in found else self.alone(b))


def trie(path: str) -> Trie:
    claim_memo("tokencount", _tries.clear)
    if path not in _tries:
        _tries[path] = Trie(path)
    if len(_tries[path].known) > MOST_KNOWN:
        _tries[path].known.clear()
    return _tries[path]


def token_counts(docs: DataFrame, pieces_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_runs, n_tokens, n_distinct) of every row: runs without white space, their tokens, distinct runs.

    White space is what Unicode calls so. Defined cases: null, empty and blank texts have no
    run; letters without a piece count as their bytes; repeated rows each get their result; an
    empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with without_collector():
            for batch in batches:
                t = trie(pieces_path)
                runs = [x.split() if x else [] for x in batch.column(1).to_pylist()]
                distinct = [set(r) for r in runs]
                new = {x for s in distinct for x in s if x not in t.known}
                if new:
                    t.learn(new)
                count = t.known.__getitem__
                columns = [list(map(len, runs)), [sum(map(count, r)) for r in runs], list(map(len, distinct))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_runs", "n_tokens", "n_distinct"])

    return documents_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_runs long, n_tokens long, n_distinct long")
