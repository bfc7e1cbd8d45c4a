import corpus_pipeline
from ledgerlens.llm import neardup
from ledgerlens.llm.queries import QUERIES


def test_every_operator_has_its_query():
    assert [int(k[2:].split("_")[0]) for k in QUERIES] == list(range(1, 14))


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, frames[-1], sf_dir), name)
        assert out.columns == columns, name
        frames.append(out)
    n = [f.count() for f in frames]
    assert n[0] > n[1] > n[2] >= n[3] == n[4] > 0.5 * n[0]
    again = neardup.near_duplicates(frames[2])
    assert again.where("not kept").count() == 0
    for item in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        assert not any(item.text in r.text for r in frames[3].collect())
    assert not any("@mail" in r.text for r in frames[4].collect())
    last = corpus_pipeline.run(spark, sf_dir)
    assert last.count() == n[4]


def test_null_and_repeated_rows_go_through(spark, sf_dir, docs):
    rows = [(None, None), (None, "call +1 (456) 555-2186 now please and then"), (3, ""), (3, ""), (4, "one two three four five six"), (5, "one two three four five six"), (4, "one two three four five six")]
    stage = docs(rows).select("doc_id", "text", "lang", "source", "n_chars")
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = corpus_pipeline.materialize(f(spark, stage, sf_dir), "t")
    assert sorted(str(r.doc_id) for r in stage.collect()) == ["3", "3", "4", "None", "None"]
    assert {r.text for r in stage.where("doc_id is null").collect()} == {None, "call [PHONE] now please and then"}
    assert corpus_pipeline.STAGES[-1][1](spark, stage, sf_dir).count() == 5
    empty = docs(rows).select(stage.columns).where("false")
    for _, f in corpus_pipeline.STAGES:
        empty_out = f(spark, empty, sf_dir)
        assert empty_out.count() == 0


def test_rows_are_judged_by_their_own_text(spark, tmp_path, docs):
    item, clean = "which of the seven rivers of the old kingdom ran dry before the great winter began", [f"clean{k} text{k} about{k} nothing{k} much{k} here{k} today{k}" for k in range(5)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ["alpha bravo charlie delta echo foxtrot", "golf hotel india juliet kilo lima mike"]
    rows = [(None, clean[0]), (None, item), (7, clean[1]), (7, f"so {item} then"), (2, names[0]), (None, names[0]), (9, names[0]), (9, clean[2]), (None, names[1]), (None, names[1]), (None, names[1])]
    out = docs(rows).select("doc_id", "text", "lang", "source", "n_chars")
    for name, f in corpus_pipeline.STAGES[1:3]:
        out = corpus_pipeline.materialize(f(spark, out, str(tmp_path)), name)
    want = [(None, clean[0]), (7, clean[1]), (2, names[0]), (9, clean[2]), (None, names[1])]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)


def test_a_toxic_row_takes_no_other_row_of_its_id_along(spark, tmp_path, docs):
    bad, good = "vrakzul gnorbith slumfex drabnok", ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliet", "kilo", "lima"]
    text = lambda k: " ".join(good[(k * j + k // 12 + j * j) % 12] + "abcdefgh"[(k + j) % 8] for j in range(1, 40))
    rows = [(k, text(k) + (f" {bad}" if k % 3 == 0 else "")) for k in range(240)]
    spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(240)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    more = [(None, text(1001)), (None, text(1002) + f" {bad}"), (900, text(1003)), (900, text(1004) + f" {bad}")]
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.not_toxic(spark, docs(rows + more), str(tmp_path)).collect()}
    assert [r in kept for r in more] == [True, False, True, False]


def test_columns_of_the_user_with_inner_names_stay(spark, docs):
    df = docs([(1, "one two three four five six"), (2, "one two three four five six")]).selectExpr("*", "1 as _row", "2 as _none", "3 as _id", "4 as _hash", "5 as __row", "6 as k")
    got = corpus_pipeline.near_duplicates(spark, df, "")
    assert got.columns == df.columns
    assert [(r.doc_id, r._row, r._none, r._id, r._hash, r["__row"], r.k) for r in got.collect()] == [(1, 1, 2, 3, 4, 5, 6)]
