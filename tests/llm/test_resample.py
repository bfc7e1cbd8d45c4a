import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from ledgerlens.llm import resample


def grams(text, most):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, most=1, buckets=10_000, percent=10, least=20, seed=2024):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    feats = [(i, *grams(t, most)) for i, t in rows]
    s, t = Counter(), Counter()
    for _, _, g in feats:
        s.update(map(bucket, g))
    for x in target:
        t.update(map(bucket, grams(x, most)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    out = []
    for i, n, g in feats:
        weight = sum(gain[bucket(x)] for x in g)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_table_of_the_driver(spark, sf_dir):
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    got = result(resample.resample(docs, target))
    assert got == want and sum(r[4] is not None for r in got) >= 10


@pytest.mark.parametrize("most", [1, 2, 3])
def test_n_grams_nulls_ties_and_long_texts(docs, hard, most):
    rng = random.Random(5)
    texts = hard + [" ".join(rng.choice(["Alpha", "beta", "Größe", "x1", "漢字", "--", "y_z"]) for _ in range(rng.randrange(80))) for _ in range(60)] + ["lorem ipsum " * 120_000]
    rows = [*enumerate(texts), (None, "a null id " * 9), (7, "seven again " * 12), (7, "seven again " * 12)]
    target = docs(["alpha beta größe", None, "", "漢字 x1 " * 30])
    got = result(resample.resample(docs(rows), target, max_n=most, buckets=97, percent=35, min_words=3))
    ranks = lambda rows: Counter(r[4] for r in rows)  # noqa: E731  (equal rows share their ranks in any order)
    plain = lambda rows: Counter(r[:4] + r[5:] for r in rows)
    want = brute(rows, ["alpha beta größe", "漢字 x1 " * 30], most, 97, 35, 3)
    assert plain(got) == plain(want) and ranks(got) == ranks(want)
    assert {r[4]: r[0] for r in got if r[4]} == {r[4]: r[0] for r in want if r[4]}


def test_empty_tables(docs):
    none = docs(["x"]).where("false")
    assert resample.resample(none, docs(["a b"])).count() == 0
    [row] = resample.resample(docs(["word " * 20]), none, percent=100).collect()
    assert row.rank == 1 and row.n_features == row.n_words == 20


def test_many_equal_scores_are_numbered_once(docs):
    rows = [(None, "same text here " * 10)] * 300 + [(k, "other " * 25) for k in range(50)]
    got = resample.resample(docs(rows).repartition(9), docs(["other"]), percent=60).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 211))
