"""Token ids of whole texts through the `tokenizers` library, sharing the work of repeated chunks.

The tokenizer's pieces never cross white space, so a text's ids are those of its chunks between
spaces and line feeds, one after another. A chunk is taken apart further where the tokenizer's own
rules surely cut it: ASCII punctuation at its end is a piece run of its own, and if all letters are
of Latin-1 the rest is lower-cased first. What is left is encoded once by each worker and kept: by
the tokenizer's model alone if it is one run of letters, else by the whole tokenizer, many in one
string with a separator between them. Beyond MOST_PARTS parts the worker forgets them and starts
afresh, which changes no result.
For a file with other rules than those checked in `_letters_apart` chunks stay whole.
"""

from __future__ import annotations

import json
import os
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import claim_memo

MOST_PARTS, MOST_LENGTH, SEPARATOR = 300_000, 128, "\x01"
#: Fixed value: how a tokenizer must cut texts for letter runs and punctuation to be apart.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each file and worker process."""
    claim_memo("wordbpe", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def byte_letters() -> dict[int, str]:
    """The visible letter that byte-level vocabularies use for each byte (given as the letter of its number)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class ChunkEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.stop = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self.apart = self._letters_apart()
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.visible = byte_letters()
        self.clear()

    def _letters_apart(self) -> bool:
        """Whether the file lower-cases, cuts with SPLIT and then takes bytes."""
        c = json.loads(self.tokenizer.to_str())
        steps = [x.get("type") for x in (c.get("normalizer") or {}).get("normalizers", [])]
        cuts = (c.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": SPLIT} and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"] and c["model"]["type"] == "BPE"

    def clear(self) -> None:
        self.part: dict[str, int] = {}
        self.starts, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.int64)

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _several(self, parts: list[str]) -> list[list[int]]:
        """The ids of each of some strings without blanks, from one call."""
        ids = self.plain(f" {SEPARATOR} ".join(parts))
        out: list[list[int]] = [[]]
        for i in ids:
            if len(self.stop) == 1 and i == self.stop[0]:
                out.append([])
            else:
                out[-1].append(i)
        return out if len(out) == len(parts) else [self.plain(x) for x in parts]  # one holds the separator itself

    def _encode_parts(self, new: list[str]) -> None:
        found: list[list[int] | None] = []
        rest: list[int] = []
        for k, x in enumerate(new):
            if self.apart and x.isalpha() and (x.isascii() or max(x) < "\u0100"):
                if not x.isascii():
                    x = x.encode().decode("latin-1").translate(self.visible)
                found.append([t.id for t in self.model.tokenize(x)])
            else:
                found.append(None)
                rest.append(k)
        for i in range(0, len(rest), 2000):
            group = rest[i : i + 2000]
            for k, ids in zip(group, self._several([new[k] for k in group]), strict=True):
                found[k] = ids
        n = len(self.sizes)
        self.part.update(zip(new, range(n, n + len(new)), strict=True))
        self.ids = np.concatenate([self.ids, np.array([t for x in found for t in x], np.int64)])
        self.sizes = np.concatenate([self.sizes, np.array(list(map(len, found)), np.int64)])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _taken_apart(self, chunks: pa.Array, special: bool) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """(stems, ends, with_end): each chunk's stem, lower-cased where that is sure to be right, and the ends of those that have one.

        special: whether a special token may be in a chunk; such chunks stay whole.
        """
        if not self.apart:
            return chunks, chunks.slice(0, 0), np.empty(0, np.int64)
        stems = pc.utf8_rtrim(chunks, string.punctuation)
        cut = pc.match_substring_regex(stems, r"\pL$")
        latin = pc.match_substring_regex(chunks, r"^[\x00-\x{FF}]*$")
        if special:
            plain = pc.invert(pc.match_substring_regex(chunks, "|".join(map(re.escape, self.special))))
            cut, latin = pc.and_(cut, plain), pc.and_(latin, plain)
        stems = pc.if_else(cut, stems, chunks)
        with_end = np.flatnonzero(pc.not_equal(pc.binary_length(stems), pc.binary_length(chunks)).to_numpy(zero_copy_only=False))
        ends = pc.struct_field(pc.extract_regex(chunks.take(pa.array(with_end)), rf"(?P<end>[{re.escape(string.punctuation)}]*)$"), [0])
        return pc.if_else(latin, pc.utf8_lower(stems), stems), ends, with_end

    def _numbers(self, parts: pa.Array) -> np.ndarray:
        """The numbers under which the ids of some strings are kept; new ones are encoded."""
        numbered = parts.dictionary_encode()
        each = numbered.dictionary.to_pylist()
        if new := [x for x in each if x not in self.part]:
            self._encode_parts(new)
        return np.fromiter(map(self.part.__getitem__, each), np.int64, len(each))[numbered.indices.to_numpy()]

    def _segments(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
        """(parts, offsets, whole): each text's chunks' parts, two for each, and the ids of texts with a chunk over MOST_LENGTH bytes.

        Arrow splits the texts, numbers their distinct chunks and takes those apart, so that only
        distinct parts pass through Python.
        """
        if len(self.part) > MOST_PARTS:
            self.clear()
        texts = column.fill_null("") if column.null_count else column
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        numbered = lists.flatten().dictionary_encode()
        index, chunks = numbered.indices.to_numpy(), numbered.dictionary
        whole: dict[int, list[int]] = {}
        long = pc.greater(pc.binary_length(chunks), MOST_LENGTH)
        if pc.any(long).as_py():
            rows = np.unique(np.searchsorted(offsets, np.flatnonzero(long.to_numpy(zero_copy_only=False)[index]), side="right") - 1)
            whole = {r: self.plain(texts[r].as_py()) for r in rows.tolist()}
            chunks = pc.if_else(long, "", chunks)
        special = any(pc.any(pc.match_substring(texts, x)).as_py() for x in self.special)
        stems, ends, with_end = self._taken_apart(chunks, special)
        numbers = self._numbers(pa.concat_arrays([stems, ends, pa.array([""])]))
        both = np.full((len(chunks), 2), numbers[-1])
        both[:, 0] = numbers[: len(chunks)]
        both[with_end, 1] = numbers[len(chunks) : -1]
        return both[index].reshape(-1), 2 * offsets, whole

    def lengths(self, column: pa.Array) -> np.ndarray:
        """The number of ids of each text; null counts as empty."""
        parts, offsets, whole = self._segments(column)
        ends = np.concatenate([[0], np.cumsum(self.sizes[parts])])
        out = ends[offsets[1:]] - ends[offsets[:-1]]
        for r, ids in whole.items():
            out[r] = len(ids)
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of all texts, one after another."""
        parts, offsets, whole = self._segments(column)
        size = self.sizes[parts]
        end = np.cumsum(size)
        ids = self.ids[np.repeat(self.starts[parts] - end + size, size) + np.arange(end[-1] if len(end) else 0)]
        off = np.concatenate([[0], end])[offsets]
        if whole:
            each = [np.array(whole[r], np.int64) if r in whole else ids[off[r] : off[r + 1]] for r in range(len(off) - 1)]
            ids, off = np.concatenate(each), np.concatenate([[0], np.cumsum(list(map(len, each)))])
        return ids, off
