import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import neardup
from ledgerlens.llm.components import components


def shingles(text, width=5):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        x = list(base)
        for _ in range(edits):
            x[rng.randrange(len(x))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(x))
    return out


@pytest.mark.parametrize("block", [4096, 8])
def test_against_brute_force(docs, monkeypatch, hard, block):
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", block)
    monkeypatch.setattr(neardup, "CLUSTER_BLOCK", 1_500_000 if block > 8 else 900)
    rng = random.Random(3)
    texts = hard + family(rng, 40, 120, 2) + family(rng, 30, 200, 5) + family(rng, 20, 60, 1) + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(50)) for _ in range(40)]
    rng.shuffle(texts)
    texts += [t.upper() for t in texts if t and len(t) < 900][:10]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs(rows)).collect()}
    assert got == brute(rows)


def test_table_of_the_driver(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_nulls_repeats_and_no_rows(docs):
    df = docs([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None), (5, None)])
    got = sorted(((str(r.doc_id), r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == [("3", 3, True), ("3", 3, True), ("5", 5, True), ("None", 3, False), ("None", None, True)]
    assert neardup.near_duplicates(docs([(1, "x")]).where("false")).count() == 0


def test_least_matches_follow_the_binomial():
    least = neardup.least_matches(0.75, 1e-6)
    draws = np.random.default_rng(0).binomial(60, 0.75, 400_000)
    assert len(least) == 5 and (draws < least[-1]).mean() < 1e-4


def test_components_of_a_long_path(spark):
    n = 300
    edges = [(i + 1, i) for i in range(n)] + [(1000, 1001), (1001, 1000), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


def test_word_hashes_do_not_depend_on_place():
    a, _ = neardup.word_hashes(*neardup.text_bytes(pa.array(["Alpha beta\tgamma"])))
    b, at = neardup.word_hashes(*neardup.text_bytes(pa.array(["x", "zz gamma BETA", "alpha"])))
    assert a.tolist() == [b[4], b[3], b[2]]
    assert at.tolist() == [0, 1, 4, 5]


def test_components_of_a_star_a_chain_and_random_edges(spark):
    import random

    rng = random.Random(6)
    edges = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(90)] + [(5, 5), (None, 3)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    want = {x: top(x) for x in root}
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    assert {r.node: r.component for r in components(df).collect()} == want
