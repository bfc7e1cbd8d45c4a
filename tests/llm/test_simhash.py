import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from ledgerlens.llm import simhash


def fingerprint(text, width=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    votes = Counter()
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        votes.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def joined(fps, most=2):
    """Root of each fingerprint, all pairs compared."""
    x = np.array(sorted(fps), np.uint64)
    label = np.arange(len(x))
    for i in range(len(x)):
        near = np.bitwise_count(x ^ x[i]) <= most
        for j in np.unique(label[near]):
            label[label == j] = label[i]
    return dict(zip(x.tolist(), label.tolist(), strict=True))


def brute(rows, most=2, width=3):
    fps = [fingerprint(t, width) for _, t in rows]
    root = joined(set(fps), most)
    least = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    return Counter((i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(rows, fps, strict=True))


def result(df):
    return Counter(map(tuple, df.collect()))


def family(rng, n, words):
    base = [f"w{rng.randrange(900)}" for _ in range(words)]
    for _ in range(n):
        x = list(base)
        x[rng.randrange(len(x))] = f"e{rng.randrange(10**6)}"
        yield " ".join(x)


@pytest.mark.parametrize("crowded", [256, 3])
def test_against_all_pairs(docs, hard, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = random.Random(4)
    texts = [*hard, *family(rng, 150, 300), *family(rng, 60, 900), *family(rng, 30, 40), *[" ".join(f"u{rng.randrange(10**6)}" for _ in range(30)) for _ in range(40)]]
    texts += [t.upper() for t in texts if t][:20] + ["Lorem  ipsum\tdolor " * 150_000]
    rng.shuffle(texts)
    rows = [*enumerate(texts), (None, "alone without an id"), (4, texts[9]), (4, texts[9])]
    want = brute(rows)
    assert result(simhash.near_duplicates(docs(rows))) == want
    assert len({c for _, _, c in want}) < len({f for _, f, _ in want}) - 20


def test_table_of_the_driver(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert result(simhash.near_duplicates(df)) == brute([(r.doc_id, r.text) for r in df.collect()])


@pytest.mark.parametrize(("most", "crowded"), [(1, 256), (2, 256), (2, 2), (3, 256), (5, 256)])
def test_links_of_fingerprints(spark, monkeypatch, most, crowded):
    """Random ones, and clusters whose members differ in one to seven bits of a few or of any."""
    from ledgerlens.llm.components import components

    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = random.Random(most)
    fps = {0, 2**64 - 1, 1 << 63} | {rng.getrandbits(64) for _ in range(300)}
    for width in (6, 20, 64):
        for base in [rng.getrandbits(64) for _ in range(8)]:
            fps |= {base ^ sum(1 << b for b in rng.sample(range(width), rng.randrange(1, 6))) for _ in range(40)}
    df = spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp long").repartition(3)
    got = {r.node % 2**64: r.component % 2**64 for r in components(simhash.links(df, most)).collect()}
    groups = lambda label: {frozenset(x for x in label if label[x] == v) for v in set(label.values())}
    assert groups({f: got.get(f, f) for f in fps}) == groups(joined(fps, most))


def test_thresholds_are_the_cheapest():
    rng = np.random.default_rng(2)
    cost = np.sort(rng.random((50, 3, 4)), axis=2)
    cost[:, :, 0] = 0
    got = simhash.allocate(cost, 2)
    from itertools import product

    for row, t in zip(cost, got, strict=True):
        options = [x for x in product(range(4), repeat=3) if sum(x) == 3]
        assert t.sum() == 0
        assert min(sum(row[k, v] for k, v in enumerate(x)) for x in options) == pytest.approx(sum(row[k, v + 1] for k, v in enumerate(t)))


def test_correlated_bits_share_a_partition():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, (4000, 64))
    for k in range(1, 10):
        bits[:, 5 * k] = bits[:, 0] ^ (rng.random(4000) < 0.02)
    groups = simhash.correlated_groups((bits.T @ bits).astype(np.int64), 4000, 3)
    assert sorted(x for g in groups for x in g) == list(range(64)) and {len(g) for g in groups} == {21, 22}
    assert any(set(range(0, 50, 5)) <= set(g) for g in groups)


def test_no_rows(docs):
    assert simhash.near_duplicates(docs(["x"]).where("false")).count() == 0
