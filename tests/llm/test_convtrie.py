import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest

from ledgerlens.llm import convtrie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, x1 string, start int, owner string"


def brute(rows, heads=4, group=20):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0, sha), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        paths[c] = tuple(own.get(c - int(math.fmod(c, group)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))

    def below(p):
        waiting = [p]
        while waiting:
            x = waiting.pop()
            yield x
            waiting += kids[x]

    out = []
    for p in list(members):
        tree = list(below(p))
        ends = ",".join(map(str, sorted(c for c in members[p] if len(paths[c]) == len(p))))
        saved = sum((len(members[x]) - 1) * words(x[-1][1]) for x in tree if x)
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), sum(not kids[x] for x in tree), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA).repartition(5)
    return sorted(map(tuple, convtrie.prefix_trie(df, **how).collect()), key=str)


def test_table_of_the_driver(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = sorted(map(tuple, convtrie.prefix_trie(df).collect()), key=str)
    assert got == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("block", [4096, 3])
def test_random_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(convtrie, "BLOCK", block)
    monkeypatch.setattr(convtrie, "PIECE", block)
    rng = random.Random(8)
    say = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["yes", "no  maybe\tso", "", None, "é 漢字 ok"]))
    rows = [(c, t, *say()) for c in [*range(90), 1003, 1019, -7, 10**12] for t in range(rng.randrange(1, 6))]
    rows += [(c, t, "user", "the same words") for c in range(200, 330) for t in range(4)]  # copies
    rows += [(400, t, "user", f"turn {t % 3}") for t in range(40)] + [(401, t, "user", f"turn {t % 3}") for t in range(37)]  # long ones
    rng.shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_nulls_ties_repeats_and_no_rows(spark):
    rows = [(None, 1, "user", "none"), (5, None, "user", "first"), (5, None, None, None), (5, 2, "user", "b"), (5, 2, "user", "a"), (5, 2, "user", "a"), (17, 1, "x", "word " * 100_000)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[:0] + [(None, 1, "a", "b")]) == []
    assert found(spark, rows, heads=2, group=3) == brute(rows, 2, 3)
