import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import suffixdedup


def brute(rows, n=50):
    """rows: (doc_id, text), ids distinct and not null."""
    first = {}
    raw = {i: (t or "").encode() for i, t in rows}
    for i in sorted(raw):
        for p in range(len(raw[i]) - n + 1):
            first.setdefault(raw[i][p : p + n], i)
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b) + 2, bool)
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < i:
                gone[p + 1 : p + n + 1] = True
        kept = bytes(x for x, g in zip(b, gone[1:], strict=False) if not g)
        out[i] = (len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out


def found(df, **k):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.substring_dedup(df, **k).collect()}


@pytest.mark.parametrize(("piece", "hot"), [(1 << 15, 1 << 14), (64, 8), (4, 0)])
def test_against_brute_force(docs, hard, monkeypatch, piece, hot):
    """Also with so small limits that most buckets are hot and fill several pieces."""
    monkeypatch.setattr(suffixdedup, "PIECE", piece)
    monkeypatch.setattr(suffixdedup, "LARGEST", piece)
    monkeypatch.setattr(suffixdedup, "HOT", hot)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randrange(6, 40))) for _ in range(12)]
    texts = list(hard)
    for _ in range(60):
        texts.append(" ".join(rng.choice(passages)[rng.randrange(9) :] if rng.random() < 0.5 else word() for _ in range(rng.randrange(1, 25))))
    texts += [texts[-1], texts[-2], "ab" * 400, "ab" * 300, "x" * 49, "x" * 50, "x" * 51]
    ids = list(range(-5, len(texts) * 3, 3))[: len(texts)]
    rng.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    assert found(docs(rows)) == brute(rows)


@pytest.mark.parametrize("listed", [1 << 16, 3])
def test_one_text_in_every_block(docs, monkeypatch, listed):
    """The blocks that hold it fill several lists; the empty text and one of 49 bytes are everywhere, too."""
    monkeypatch.setattr(suffixdedup, "LISTED", listed)
    monkeypatch.setattr(suffixdedup, "BLOCK_BYTES", 1 << 10)
    same = "the same passage of more than fifty bytes is in every block of the table"
    rows = [(i, (same, "", "y" * 49, f"{i} {same} {i}")[i % 4]) for i in range(400, 0, -1)]
    assert found(docs(rows)) == brute(rows)


def test_table_of_the_driver(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert found(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_other_lengths(docs):
    texts = ["abcdefghijklmnopqrst" * 2, "xx abcdefghijklmnopqrst yy", "klmnopqrstabcdefghij"]
    rows = list(enumerate(texts))
    assert found(docs(rows), length=16, q=6) == brute(rows, 16)


@pytest.mark.parametrize(("length", "q"), [(7, 3), (16, 16), (50, 9), (100, 20), (333, 20)])
def test_any_length(docs, length, q):
    rng = random.Random(length)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(900))
    texts = [passage[rng.randrange(300) : rng.randrange(400, 900)] + "".join(rng.choice("xyz") for _ in range(rng.randrange(30))) + passage[rng.randrange(800) :] for _ in range(25)]
    rows = list(enumerate(texts))
    assert found(docs(rows), length=length, q=q) == brute(rows, length)


def refined_directly(rows, length, piece, monkeypatch):
    """rows: (key, doc, bytes), one string each, in sorted order; the documents that lose it."""
    monkeypatch.setattr(suffixdedup, "PIECE", piece)
    monkeypatch.setattr(suffixdedup, "LARGEST", 2 * piece)
    t = pa.Table.from_pylist([{"key": k, "doc": d, "block": 0, "r": d, "at": 0, "bytes": b} for k, d, b in rows], schema=suffixdedup.CONTEXTS)
    return sorted(r for batch in suffixdedup._refined(iter(t.to_batches(max_chunksize=97)), length) for r in batch.column("r").to_pylist())


def test_a_bucket_larger_than_a_piece(monkeypatch):
    one, other = b"the same passage of many documents, over and over.", b"another one with the same bucket number as the one"
    rows = [(1, 0, one)] + [(5, d, other if d % 7 == 3 else one) for d in range(1000)] + [(6, 2000, other[::-1])]
    want = [d for d in range(1000) if d not in (0, 3)]
    for piece in (100_000, 256, 31):
        assert refined_directly(rows, 50, piece, monkeypatch) == want


def test_equal_contexts_are_refined_as_one(monkeypatch):
    """The bytes that are refined grow with the different contexts of a bucket, not with the documents that hold them."""
    rng = random.Random(11)
    text = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    alone, one = text(80), text(70)
    other = one[:60] + b"#" * 9  # shares its first strings with `one`
    rows = [(1, d, alone) for d in range(900)] + [(2, d, other if d % 5 == 2 else one) for d in range(700)]
    refined, f = [], suffixdedup.refine
    monkeypatch.setattr(suffixdedup, "refine", lambda b, *k, **o: (refined.append(len(b)), f(b, *k, **o))[1])
    t = pa.Table.from_pylist([{"key": k, "doc": d, "block": k, "r": d, "at": 7, "bytes": b} for k, d, b in rows], schema=suffixdedup.CONTEXTS)
    got = {(s["block"], s["r"]): (s["a"], s["e"]) for batch in suffixdedup._refined(iter([t.to_batches()[0]]), 50) for s in batch.to_pylist()}
    want = {(1, d): (7, 87) for d in range(1, 900)} | {(2, d): (7, 76 if d % 5 == 2 else 77) for d in range(1, 700)}
    want[2, 2] = (7, 67)  # the earliest with `other`: only what `one` has, too
    assert got == want
    assert sum(refined) == len(one) + len(other)


@pytest.mark.parametrize("piece", [1 << 12, 40, 8])
def test_repeated_contexts_against_brute_force(monkeypatch, piece):
    """Also if one document holds a context several times, and if a bucket fills several pieces."""
    monkeypatch.setattr(suffixdedup, "PIECE", piece)
    monkeypatch.setattr(suffixdedup, "LARGEST", 2 * piece)
    rng = random.Random(piece)
    core = bytes(rng.choice(b"abc") for _ in range(90))
    forms = [core[a:e] for a, e in ((0, 90), (0, 60), (20, 75), (35, 90), (40, 90), (5, 56))] + [core[10:60] + b"?", b"!" + core[1:71], core[30:70]]
    rows = sorted((rng.randrange(3), rng.randrange(-20, 40), rng.choice(forms)) for _ in range(300))
    t = pa.Table.from_pylist([{"key": k, "doc": d, "block": k, "r": i, "at": 0, "bytes": b} for i, (k, d, b) in enumerate(rows)], schema=suffixdedup.CONTEXTS)
    gone = [set() for _ in rows]
    for batch in suffixdedup._refined(iter(t.to_batches(max_chunksize=17)), 20):
        for s in batch.to_pylist():
            assert s["e"] - s["a"] >= 20
            gone[s["r"]] |= set(range(s["a"], s["e"]))
    first = {}
    for _, d, b in rows:
        for p in range(len(b) - 19):
            first[b[p : p + 20]] = min(first.get(b[p : p + 20], d), d)
    within = {}
    for k, d, b in rows:
        for p in range(len(b) - 19):
            within[k, b[p : p + 20]] = min(within.get((k, b[p : p + 20]), d), d)
    for (k, d, b), g in zip(rows, gone, strict=True):
        least, most = ({x for p in range(len(b) - 19) if found(b[p : p + 20]) < d for x in range(p, p + 20)} for found in (lambda x, k=k: within[k, x], lambda x: first[x]))
        assert least <= g <= most  # all that its bucket tells, and nothing that no earlier document has


def test_hot_buckets_are_split(spark, docs, monkeypatch):
    """A passage that all documents share, and its different surroundings: no key keeps more rows than there are blocks."""
    monkeypatch.setattr(suffixdedup, "HOT", 50)
    rng = random.Random(3)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(20))
    word = lambda: "".join(rng.choice("pqrstuv") for _ in range(6))
    rows = [(i, f"{word()} {word()} {word()} {passage} {word()} {word()}") for i in range(1500)]
    assert found(docs(rows)) == brute(rows)
    seen = []
    monkeypatch.setattr(type(docs(rows)), "sortWithinPartitions", lambda self, *k, f=type(docs(rows)).sortWithinPartitions: (seen.append(self), f(self, *k))[1])
    suffixdedup.substring_dedup(docs(rows))
    contexts = next(x for x in seen if "key" in x.columns)
    largest = contexts.where("bytes is not null").groupBy("key").count().agg({"count": "max"}).first()[0]
    assert largest <= max(50, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def test_nulls_repeats_and_no_rows(docs):
    long = "the quick brown fox jumps over the lazy dog and runs away " * 2
    df = docs([(None, long), (1, long), (1, long + "tail"), (2, "head " + long), (2, None)])
    got = sorted((str(r.doc_id), r.n_removed > 0) for r in suffixdedup.substring_dedup(df).collect())
    assert got == [("1", False), ("1", False), ("2", False), ("2", True), ("None", False)]
    assert suffixdedup.substring_dedup(docs([(1, "x")]).where("false")).count() == 0


def test_kept_text_is_given(docs):
    long = "the quick brown fox jumps over the lazy dog and runs away"
    got = {r.doc_id: bytes(r.kept) for r in suffixdedup.substring_dedup(docs([(1, long), (2, "A" + long + "Z")]), with_text=True).collect()}
    assert got == {1: long.encode(), 2: b"AZ"}
