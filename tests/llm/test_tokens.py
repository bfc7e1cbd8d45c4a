import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import packing, tokenfile, wordbpe
from ledgerlens.llm.queries import WORDS


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORDS)


ODD = ["It's 12,5% of x\x01y <|endoftext|>z", "é ́x  ΣΑΣ\tİ", "\x01", "\x1c \x85", "don't\r\nstop", "Ünïcode, ÉÈ! straße; Ñandú... Μ µ ª º İstanbul ŒUVRE, (x) 'tis 's s's it's. I'LL, x'", "a1b2, 3.14! 100% _x_ x-y- --", "<|startoftext|>, <|endoftext|>."]


def test_chunks_equal_the_library(spark, sf_dir, tokenizer, hard):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + [t or "" for t in hard] + ODD
    e = wordbpe.ChunkEncoder(WORDS)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for part in (pa.array([None, *texts]).slice(1), pa.array(texts[:1]), pa.array([], pa.string())):
        ids, off = e.encode(part)
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:], strict=False)] == want[: len(part)]
        e.clear()
        assert e.lengths(part).tolist() == list(map(len, want[: len(part)]))


def test_files_give_back_every_token(docs, hard, tokenizer):
    texts = hard + ODD
    rows = [(97 * i % 31 - 5, t) for i, t in enumerate(texts)]
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.token_files(docs(rows).repartition(3), WORDS).collect()]
    start, want = 0, []
    for i, t in sorted(rows):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got) == want


def test_null_ids_repeats_and_no_rows(docs):
    got = sorted(tokenfile.token_files(docs([(None, "a"), (2, "b"), (2, "b")]), WORDS).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start) for r in got] == [(None, 0), (2, 2), (2, 4)]
    assert tokenfile.token_files(docs([(1, "x")]).where("false"), WORDS).count() == 0


def test_small_shards_and_ranges(docs, spark, hard, tokenizer, tmp_path):
    """Shards of some bytes, read by ranges of some bytes, mapped and not; null ids lie in several shards."""
    rows = [(None if i % 3 == 0 else i // 2, t) for i, t in enumerate((hard + ODD) * 6)]
    folder = f"file://{tmp_path}/tokens"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        manifest = tokenfile.write_shards(docs(rows), folder, WORDS, shard_bytes=64)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(manifest) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = sorted((str(i), *tokenizer.encode(t or "", add_special_tokens=False).ids, 1) for i, t in rows)
    for mapped in (True, False):
        found, ids, nulls = [], [], 0
        for m in manifest:
            parts = list(tokenfile.Shard(folder, m["name"], False, mapped).documents(m["n_docs"], 16))
            some = [int(d) for p in parts for d in p[0]]
            nulls += tokenfile.NO_ID in some
            ids += some
            for d, off, flat in parts:
                found += [(str(None if i == tokenfile.NO_ID else i), *flat[x - off[0] : y - off[0]].tolist()) for i, x, y in zip(d.tolist(), off, off[1:], strict=False)]
        assert sorted(found) == want and ids == sorted(ids) and nulls > 1
    got = sorted(tokenfile.read_shards(spark, folder, manifest).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]


def brute_limits(x, c, k):
    best = None
    for m in range(1, min(k, len(x)) + 1):
        for inner in itertools.combinations(range(len(x) - 1), m - 1):
            ends, lo, cost = [*inner, len(x) - 1], 0, 0
            for e in ends:
                cost += sum((x[e] - x[i]) * c[i] for i in range(lo, e + 1))
                lo = e + 1
            best = cost if best is None else min(best, cost)
    return best


def test_bucket_limits_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        x, c, k = np.sort(rng.choice(60, n, replace=False)) + 1, rng.integers(1, 9, n), int(rng.integers(1, 5))
        limits, padding = packing.bucket_limits(x, c, k)
        at = np.searchsorted(limits, x)
        assert limits[-1] == x[-1] and len(limits) <= k
        assert padding == sum((np.array(limits)[at] - x) * c) == brute_limits(x.tolist(), c.tolist(), k)
    assert packing.bucket_limits(np.empty(0, np.int64), np.empty(0, np.int64), 4) == ([], 0)


def test_packing_keeps_rows_and_budget(docs, hard, tokenizer):
    rows = list(enumerate(hard * 5 + ["tiny text"] * 70)) + [(None, "t"), (3, None)]
    got = packing.pack(docs(rows), WORDS, n_buckets=3, budget=64).toPandas()
    assert len(got) == len(rows)
    want = sorted(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sorted(got.n_tokens) == want
    assert (got.n_tokens <= got.bucket_limit).all()
    for (bucket, _batch), g in got.groupby(["bucket", "batch"]):
        assert len(g) == 1 if bucket == -1 else g.bucket_limit.sum() <= 64
        assert sorted(g.slot) == list(range(len(g)))
    full = got[got.bucket >= 0].groupby("bucket").apply(lambda g: (g.groupby("batch").size() < 64 // g.bucket_limit.iloc[0]).sum())
    assert (full <= 1).all()
    assert packing.pack(docs([(1, "x")]).where("false"), WORDS).count() == 0


def test_batches_are_padded_and_rebuilt_to_ids(docs, hard):
    from tokenizers import Tokenizer

    texts = [*hard[:8], *[f"some words number {i} " * (i % 40) for i in range(200)]]
    rows = [(None if i % 50 == 0 else i // 2, x) for i, x in enumerate(texts)]
    plain = Tokenizer.from_file(WORDS)
    got = packing.batches(docs(rows), WORDS, 1, pad_id=0, budget=512, n_buckets=4).collect()
    found = []
    for r in got:
        assert len(r.ids) == r.width * len(r.doc_ids) and (len(r.ids) <= 512 or len(r.doc_ids) == 1)
        for k, (doc, n) in enumerate(zip(r.doc_ids, r.lengths, strict=True)):
            row = r.ids[k * r.width : (k + 1) * r.width]
            assert not any(row[n:])
            found.append((str(doc), tuple(row[:n])))
    assert sorted(found) == sorted((str(i), (*plain.encode(x or "", add_special_tokens=False).ids, 1)) for i, x in rows)
