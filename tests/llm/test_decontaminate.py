import random

import numpy as np
import pytest

from ledgerlens.llm import decontaminate as d


def fold(t):
    return d._FOLD[np.frombuffer(t.encode(), np.uint8)]


def best(item, text):
    """Least edits of item against any part of text, by the whole table."""
    row = [0] * (len(text) + 1)
    for x in item:
        new = [row[0] + 1]
        for k, y in enumerate(text):
            new.append(min(row[k] + (x != y), row[k + 1] + 1, new[k] + 1))
        row = new
    return min(row)


def edited(rng, t, k):
    t = list(t)
    for _ in range(k):
        p = rng.randrange(len(t))
        kind = rng.randrange(3)
        if kind == 0:
            t[p] = rng.choice("xyz")
        elif kind == 1:
            t.insert(p, rng.choice("xyz"))
        else:
            del t[p]
    return "".join(t)


@pytest.fixture
def words():
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 8))) for _ in range(80)]
    return rng, lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))


def test_against_brute_force(spark, docs, hard, words):
    rng, text = words
    items = [(i, text(rng.randrange(4, 30))) for i in range(12)] + [(50, "short one"), (51, ""), (52, None), (0, text(9))]
    texts = list(hard)
    for _ in range(70):
        _, item = items[rng.randrange(12)]
        budget = d.edit_budget(len(fold(item)), d.Q, d.EDIT_SHARE)
        texts.append(text(rng.randrange(9)) + " " + edited(rng, item, rng.randrange(budget + 4)).upper().replace(" ", "\t") + " " + text(rng.randrange(9)))
    texts += ["a SHORT one here", text(50), items[3][1]]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in d.contaminated(docs(texts), benchmark).collect()}
    for k, t in enumerate(texts):
        want = set()
        for i, item in items:
            if item:
                f = fold(item)
                budget = d.edit_budget(len(f), d.Q, d.EDIT_SHARE)
                if best(f.tolist(), fold(t or "").tolist() if len(t or "") < 2000 else []) <= budget:
                    want.add(i)
        assert got[k] == sorted(want), (k, t)


def test_blocks_of_items_and_no_rows(spark, docs, words, monkeypatch):
    rng, text = words
    items = [(i, text(20)) for i in range(9)]
    rows = docs([text(5) + " " + items[i % 9][1] for i in range(20)] + [None])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, d.contaminated(rows, benchmark).collect()))
    monkeypatch.setattr(d, "BLOCK_BYTES", 200)
    assert sorted(map(str, d.contaminated(rows, benchmark).collect())) == whole
    assert d.contaminated(rows.where("false"), benchmark).count() == 0
    assert not any(r.is_contaminated for r in d.contaminated(rows, benchmark.where("false")).collect())


def test_driver_tables_hold_whole_items(spark, sf_dir):
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    got = {r.doc_id: set(r.item_ids) for r in d.contaminated(docs, benchmark).collect()}
    for r in docs.collect():
        assert {i for i, t in items if t in r.text} <= got[r.doc_id]


def test_query_finds_parts_case_and_blanks(spark, tmp_path, docs, words):
    from ledgerlens.llm.queries import QUERIES

    rng, text = words
    items = [text(n) for n in (16, 45, 300)]
    short, middle, long = items
    cut = lambda t, a, e: t.encode()[a:e].decode(errors="ignore")
    around = [text(30), text(20)]
    held = [(1, cut(middle, 20, 232)), (2, cut(long, len(long) // 2, 9999)), (2, cut(long, 307, 510)), (0, cut(short, 0, len(short.encode()) * 17 // 20)), (2, edited(rng, cut(long, 100, 400), 6)), (1, middle.upper()), (0, short.upper()), (1, middle.replace(" ", " \n ")), (2, long.replace(" ", "\u00a0  "))]
    texts = [f"{around[0]} {t} {around[1]}" for _, t in held] + [text(200), f"{around[0]} {cut(long, 500, 600)} {around[1]}", None, " "]
    docs(texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in QUERIES["op8_decontamination"](spark, str(tmp_path)).collect()}
    assert [got[k].item_ids for k in range(len(texts))] == [[i] for i, _ in held] + [[]] * 4


def test_parts_against_brute_force(words):
    rng, text = words
    item = d.folded(text(50))
    index = d.Index([(0, item)], d.Q, d.EDIT_SHARE, True)
    m, w, k = len(index.text[0]), int(index.part[0]), int(index.part_budget[0])
    for _ in range(12):
        a = rng.randrange(m - w)
        t = fold(d.folded(text(8) + edited(rng, item[a // 2 : a // 2 + 190], rng.randrange(k + 6)) + text(8)))
        want = best(index.text[0].tolist(), t.tolist()) <= index.budget[0] or any(best(index.text[0][s : s + w].tolist(), t.tolist()) <= k for s in d.part_starts(m, w, k))
        assert bool(d.find(index, t, np.array([0, len(t)]))) == want


def test_ranges_are_those_of_the_text_as_it_came():
    t = "  Ein  \u00c9t\u00c9 \u1e9e\n"
    assert d.folded(t) == "ein \u00e9t\u00e9 ss"
    whole = d.folded(t).encode()
    assert d.unfolded(t, [(0, 3), (4, whole.index(b" ss"))]) == [(2, 5), (7, 12)]


def test_repeated_q_grams_stay_bounded():
    """A run of one letter in item and text: time and memory grow with the text, not with the pairs of places."""
    import resource
    import time

    for item in ("-" * 200, "answer the question " + "-" * 300 + " with one word"):
        index = d.Index([(1, item), (2, "something else altogether, which is not there")], d.Q, d.EDIT_SHARE, True)
        before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.monotonic()
        for n in (1_000, 80_000):
            text = np.frombuffer(b"-" * n, np.uint8)
            found = d.find(index, text, np.array([0, n]))
            assert [(r, i) for r, i, *_ in found] == [(0, 0)]
        assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 300
        assert time.monotonic() - began < 60


def test_items_by_halves_and_bands_give_the_same(docs, monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc-") for _ in range(rng.randrange(1, 6)))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(12)] + [(50, "-" * 120)]
    texts = [" ".join(word() for _ in range(60)) + items[i % 13][1][: 90 + 7 * i] + "-" * (9 * i) for i in range(26)]
    flat = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    one = sorted(d.find(d.Index(items, 12, 0.07, True), flat, off))
    assert len(one) > 13
    for pairs, cells in ((40, 64), (3000, 1 << 18)):
        monkeypatch.setattr(d, "PAIRS", pairs)
        monkeypatch.setattr(d, "CELLS", cells)
        assert sorted(d.find(d.Index(items, 12, 0.07, True), flat, off)) == one


def test_rows_stay_apart_with_several_blocks(spark, docs, monkeypatch):
    item = "which of the seven rivers of the old kingdom ran dry before the great winter began"
    other = "how many towers did the builders of the northern wall leave without a roof in the end"
    bench = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    rows = [(None, item), (None, "clean"), (7, f"{item} {other}"), (7, None), (7, other), (7, other)]
    told = lambda: sorted((str(r.doc_id), r.item_ids) for r in d.contaminated(docs(rows), bench).collect())
    one = told()
    assert one == [("7", []), ("7", [1, 2]), ("7", [2]), ("7", [2]), ("None", []), ("None", [1])]
    monkeypatch.setattr(d, "BLOCK_BYTES", 50)
    assert told() == one


def test_a_task_holds_one_index_whatever_the_benchmark(spark, docs, monkeypatch):
    """With many blocks no plan has two searches in it, and results are those of one block."""
    items = [f"item number {k} " + " ".join(f"w{(k * 37 + j * 11) % 997}" for j in range(12)) for k in range(60)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f"before it {items[k]} after it" if k % 3 else f"nothing of {k}" for k in range(60)] + [items[4] + " and " + items[5], None, ""]
    rows = docs([*enumerate(texts), (3, items[9]), (None, items[7])])
    want = sorted(map(str, d.contaminated(rows, bench, regions=True).collect()))
    kept = sorted(map(str, d.without_contaminated(rows, bench).collect()))
    monkeypatch.setattr(d, "BLOCK_BYTES", 300)
    assert len(d._blocks(bench, "item_id", "text")) > 10
    many, stays = d.contaminated(rows, bench, regions=True), d.without_contaminated(rows, bench)
    assert sorted(map(str, many.collect())) == want and sorted(map(str, stays.collect())) == kept and stays.columns == rows.columns
    for df in (many, stays):
        assert "MapInArrow" not in df._jdf.queryExecution().executedPlan().toString()
