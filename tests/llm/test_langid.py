import zlib
from collections import Counter

import numpy as np

from ledgerlens.llm import langid


def brute_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text).split()
    low = "".join((c.lower() if len(c.lower()) == 1 else c) for c in " ".join(words))
    if not words:
        return Counter()
    s = f" {low} "
    out = Counter(c for c in s if c != " ")
    out.update(s[i : i + 2] for i in range(len(s) - 1))
    out.update(s[i : i + 3] for i in range(len(s) - 2))
    return out


def code(g):
    n = 0
    for c in g:
        n = n << 21 | ord(c)
    return n


def test_grams_and_ranks(hard):
    for t in [*hard, "Ünïcode, ÇA va? İ ß", "1 2 ... !!", "𝔘𝔫𝔦 漢字"]:
        want = Counter({code(g): n for g, n in brute_grams(t or "").items()})
        got = langid.grams(t or "")
        assert Counter(got.tolist()) == want
        top = sorted(want, key=lambda g: (-want[g], g))[: langid.PROFILE]
        assert langid.ranked(got).tolist() == top


def test_distance_is_out_of_place():
    by = {"a": np.array([5, 6, 7]), "b": np.array([7, 5])}
    ranks = langid.Ranks(by)
    assert ranks.rank[0, np.searchsorted(ranks.codes, [5, 6, 7])].tolist() == [0, 1, 2]
    assert ranks.rank[1, np.searchsorted(ranks.codes, [5, 6, 7])].tolist() == [1, -1, 0]


def test_predictions_against_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = df.collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows}
    total = {}
    for r in rows:
        if not held[r.doc_id] and r.lang:
            total.setdefault(r.lang, Counter()).update({code(g): n for g, n in brute_grams(r.text).items()})
    profile = {k: {g: i for i, g in enumerate(sorted(c, key=lambda g: (-c[g], g))[:300])} for k, c in sorted(total.items())}
    right = []
    for r in langid.identify(df).collect():
        row = next(x for x in rows if x.doc_id == r.doc_id)
        own = Counter({code(g): n for g, n in brute_grams(row.text).items()})
        own = sorted(own, key=lambda g: (-own[g], g))[:300]
        far = {k: sum(abs(p[g] - i) if g in p else 300 for i, g in enumerate(own)) for k, p in profile.items()}
        assert r.lang_pred == min(far, key=far.get) and r.held_out == held[r.doc_id] and 0 <= r.score <= 1
        right.append(row.lang == r.lang_pred)
    assert np.mean(right) > 0.9


def test_nulls_repeats_and_no_rows(docs):
    df = docs([(1, None), (2, "12 !"), (3, "hello there"), (3, "hello there"), (None, "hello")])
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(df).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "en"), (None, "en")}
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", langid.F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(df.where("false")).count() == 0
