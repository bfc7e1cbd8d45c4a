import random
import zlib

from ledgerlens.llm import toxicity


def corpus(n=900):
    rng = random.Random(2)
    syllables = ["ta", "ri", "mon", "el", "os", "un", "ker", "di"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(20, 120))]
        toxic = i % 5 == 0
        for _ in range(rng.randrange(1, 4) * toxic):
            w[rng.randrange(len(w))] = rng.choice(["fwipjack", "Blorghead", "zuckwurst", "qualpig"])
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_held_out_accuracy(spark, docs):
    rows = corpus()
    labels = spark.createDataFrame([(i, None, t) for i, _, t in rows] + [(3, None, None), (None, None, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs([(i, t) for i, t, _ in rows] + [(10_000, None), (10_001, "")]), labels).collect()}
    tests = [(got[i].predicted, t) for i, _, t in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    assert sum(p == t for p, t in tests) / len(tests) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert got[10_000].score == got[10_001].score < 0.3


def test_scores_do_not_depend_on_the_memo():
    model = toxicity.Model(("blorghead zuckwurst " * 20).encode(toxicity.WIDE), ("monel taridi kerun osmon " * 200).encode(toxicity.WIDE), [0.0] * 13)
    w = toxicity.Windows(model)
    first = w.saved("zuckwurst")
    w.kept.clear()
    assert first == w.saved("zuckwurst") > w.saved("monel")


def test_without_labels_and_no_rows(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.classify(docs(["some text", None, "some text"]), labels).collect()
    assert [(r.score, r.predicted) for r in got] == [(0.0, 0)] * 3
    few = spark.createDataFrame([(0, 1), (2, 0), (5, 0)], "doc_id long, toxic int")
    assert toxicity.classify(docs(["bad words", None, "good words", "", "x", "good"]), few).count() == 6
    assert toxicity.classify(docs([(1, "x")]).where("false"), few).count() == 0


def test_scores_against_a_plain_computation(spark, docs):
    """Each text's score from compressions of its own, without memo, batches or Spark."""
    import math
    import re

    import zstandard

    rows = corpus(300)
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    df = docs([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "a"), (903, rows[0][1] * 50), (None, rows[5][1])])
    model = toxicity.fit(df, labels)
    assert model.weights

    def size(content, b):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=19, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(b))

    def plain(text, memo={}):  # noqa: B006
        gains = []
        each = {w for w in re.findall(r"[^\W\d_]+", (text or "").lower())}
        for w in each:
            b = model.ordinary[-64:-32] + f" {w} ".encode("utf-16-le")
            if w not in memo:
                memo[w] = size(model.ordinary, b) - size(model.toxic + model.ordinary, b)
            gains.append(max(0, memo[w]))
        top, root = max(gains, default=0), math.sqrt(max(1, len(each)))
        hits = [sum(g >= m for g in gains) for m in (1, 2, 3, 4)]
        x = [1.0, *(float(top >= k) for k in range(2, 8)), *(math.log(1 + h) for h in hits), hits[1] / root, hits[2] / root]
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights, strict=True))))

    texts = {r.doc_id: r.text for r in df.collect()}
    for r in toxicity.score(df, model).collect():
        assert abs(r.score - plain(texts[r.doc_id])) < 1e-9
