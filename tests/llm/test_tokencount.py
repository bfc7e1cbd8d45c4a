import random

import numpy as np

from ledgerlens.llm import tokencount
from ledgerlens.llm.queries import PIECES


def brute(word, scores, single):
    """Best segmentations by trying every last piece, without sharing anything."""
    k = len(word)
    while k and word[k - 1] in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
        k -= 1
    if 0 < k < len(word):
        return best_cut("▁" + word[:k], scores, single) + best_cut(word[k:], scores, single)
    return best_cut("▁" + word, scores, single)


def best_cut(text, scores, single):
    best = [(0.0, 0)]
    longest = max(map(len, scores))
    for d in range(1, len(text) + 1):
        s, n = single(text[d - 1])
        options = [(best[d - 1][0] + s, best[d - 1][1] + n)]
        for i in range(d - 2, max(0, d - longest) - 1, -1):
            if text[i:d] in scores:
                options.append((best[i][0] + scores[text[i:d]], best[i][1] + 1))
        top = max(o[0] for o in options)
        best.append([o for o in options if o[0] == top][-1])
    return best[-1][1]


def test_against_brute_force(docs, hard, monkeypatch, spark, sf_dir):
    t = tokencount.Trie(PIECES)
    rng = random.Random(1)
    texts = hard + [" ".join("".join(rng.choice("abcehinorst\U0001f600é漢") for _ in range(rng.randrange(1, 14))) for _ in range(60)) for _ in range(5)] + ["a, b. (c) ... x!!! -- don't,"]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(25).collect()]
    got = {r.doc_id: r for r in tokencount.token_counts(docs(texts), PIECES).collect()}
    known = {}
    for i, x in enumerate(texts):
        words = (x or "").split()
        for w in words:
            if w not in known:
                known[w] = brute(w, t.scores, t.single)
        assert (got[i].n_runs, got[i].n_tokens, got[i].n_distinct) == (len(words), sum(known[w] for w in words), len(set(words)))


def test_shared_prefixes_are_scored_once(monkeypatch):
    """Letters looked up in a level are those of new prefixes: as many as the trie has nodes."""
    t = tokencount.Trie(PIECES)
    words = sorted("▁" + w for w in ("there", "therefore", "them", "the", "they", "ab"))
    nodes = {w[:d] for w in words for d in range(1, len(w) + 1)}
    seen = []

    class Counted(np.ndarray):
        def __getitem__(self, k):
            seen.append(len(k[0]) if isinstance(k, tuple) and isinstance(k[1], int) else 0)
            return np.asarray(self)[k]

    unique = np.unique
    monkeypatch.setattr(tokencount.np, "unique", lambda x, **k: (lambda u, b: (u, b.reshape(x.shape).view(Counted)))(*unique(x, **k)))
    monkeypatch.setattr(Counted, "reshape", lambda self, *a: self)
    got = t.counts(words)
    assert sum(seen) == len(nodes)
    monkeypatch.undo()
    assert got.tolist() == [best_cut(w, t.scores, t.single) for w in words]


def test_a_fresh_memo_changes_nothing(monkeypatch):
    words = [f"w{i * 7919}x," for i in range(300)] + ["z" * 70, "z" * 70 + "!" * 70]

    def all_counts():
        out = []
        for w in words:
            t = tokencount.trie(PIECES)
            if w not in t.known:
                t.learn({w})
            out.append(t.known[w])
        return out

    want = all_counts()
    monkeypatch.setattr(tokencount, "MOST_KNOWN", 5)
    assert all_counts() == want == [brute(w, tokencount.trie(PIECES).scores, tokencount.trie(PIECES).single) for w in words]


def test_no_rows(docs):
    assert tokencount.token_counts(docs([(1, "x")]).where("false"), PIECES).count() == 0


def test_null_and_repeated_ids_each_get_their_row(docs, hard):
    texts = [*hard[:8], "more words"]
    one = {r.doc_id: tuple(r)[1:] for r in tokencount.token_counts(docs(texts), PIECES).collect()}
    rows = [(None if i % 2 else 7, x) for i, x in enumerate(texts)] + [(None, None), (7, texts[-1])]
    got = sorted((str(tuple(r)) for r in tokencount.token_counts(docs(rows), PIECES).collect()))
    want = sorted(str((i, *one[texts.index(x)])) for i, x in rows)
    assert got == want
