import datetime as dt
import json
import random
import time
from functools import partial

import pytest
from pyspark.sql import functions as F

from ledgerlens import schemas
from ledgerlens.functions.fields import FIELDS, Field
from ledgerlens.operators import hybrid, labels, model, score, split, stats
from ledgerlens.plans import cli, report
from ledgerlens.sources import readers
from ledgerlens.streaming import ingest

D = dt.date
FIELD = [Field("income", "Income", "income_statement", "duration", concepts=("A", "B")), Field("assets", "Assets", "balance_sheet", "instant", concepts=("C",))]


@pytest.fixture
def filings(spark):
    return spark.createDataFrame([("f1", 1, "Acme", "AC", D(2024, 12, 31), D(2025, 2, 1), "acc1"), ("f2", 2, "Beta", "BE", D(2024, 6, 30), D(2024, 8, 1), "acc2")], "doc_id string, cik long, company string, ticker string, report_date date, filing_date date, accession string")


def facts(spark, rows):
    return spark.createDataFrame([(c, concept, "USD", s, e, v, a, "10-K", 2024, "FY", k) for k, (c, concept, s, e, v, a) in enumerate(rows)], schemas.FACTS)


def test_labels(spark, filings):
    y = (D(2024, 1, 1), D(2024, 12, 31))
    rows = [
        (1, "A", *y, 5.0, "acc1"), (1, "A", *y, 6.0, "acc1"), (1, "B", *y, 7.0, "acc1"), (1, "B", D(2023, 1, 1), D(2023, 12, 31), 4.0, "acc1"), (1, "B", D(2024, 10, 1), D(2024, 12, 31), 2.0, "acc1"),
        (1, "B", *y, 99.0, "other"), (1, "C", D(2024, 12, 1), y[1], 8.0, "acc1"), (1, "C", None, y[1], 9.0, "acc1"), (2, "A", D(2024, 4, 1), D(2024, 6, 30), 1.0, "acc2"), (2, "B", *y, 1.0, "x"),
    ]
    truth, misses, coverage = labels.build_labels(filings, facts(spark, rows), FIELD)
    assert {(r.doc_id, r.field, r.concept, r.true_value) for r in truth.collect()} == {("f1", "income", "B", 7.0), ("f1", "assets", "C", 9.0)}
    assert {(r.doc_id, r.field, r.reason) for r in misses.collect()} == {("f2", "income", "no_annual_duration"), ("f2", "assets", "no_concept_present")}
    assert {(r.doc_id, r.fields_found, r.complete) for r in coverage.collect()} == {("f1", 2, True), ("f2", 0, False)}
    every = {(r.field, str(r.period_end), r.value) for r in labels.all_period_values(facts(spark, rows), FIELD).where("cik = 1").collect()}
    assert every == {("income", "2024-12-31", 5.0), ("income", "2024-12-31", 6.0), ("income", "2024-12-31", 7.0), ("income", "2023-12-31", 4.0), ("income", "2024-12-31", 99.0), ("assets", "2024-12-31", 9.0)}


def predictions(spark, rows):
    return spark.createDataFrame(rows, schemas.PREDICTIONS)


def test_hybrid_runs_are_whole_or_pooled(spark):
    rules = predictions(spark, [("d", "a", "rules", None, 1.0, "ok", 0.5, 0.0, 0.0, 0.0), ("d", "b", "rules", None, None, "row_not_found", 0.5, 0.0, 0.0, 0.0), ("e", "a", "rules", None, None, "row_not_found", 0.5, 0.0, 0.0, 0.0)])
    m = predictions(spark, [("d", f, "llm", f"run{k}", 2.0, "ok", 1.0, 10.0, 1.0, 0.1) for f in "ab" for k in (1, 2)])
    whole = {(r.doc_id, r.field, r.run_label, r.predicted, r.seconds) for r in hybrid.combine(rules, m).collect()}
    assert whole == {("d", "a", "run1", 1.0, 0.5), ("d", "a", "run2", 1.0, 0.5), ("d", "b", "run1", 2.0, 1.5), ("d", "b", "run2", 2.0, 1.5), ("e", "a", "run1", None, 0.5), ("e", "a", "run2", None, 0.5)}
    pooled = sorted(((r.doc_id, r.field, r.run_label) for r in hybrid.combine(rules, m, whole_runs=False).collect()), key=str)
    assert pooled == [("d", "a", None), ("d", "b", "run1"), ("d", "b", "run2"), ("e", "a", None)]
    assert {r.doc_id: r.fields for r in hybrid.gaps(rules).collect()} == {"d": ["b"], "e": ["a"]}


def test_costs_join_by_run(spark):
    s = predictions(spark, [("d", "a", "llm", f"run{k}", 1.0, "ok", 1.0, 1.0, 1.0, 1.0) for k in (1, 2)])
    assert {r.seconds for r in score.attach_costs(s, s).collect()} == {1.0}
    assert {r.seconds for r in score.attach_costs(s, s, per_run=False).collect()} == {2.0}


def test_labels_of_tables_laid_out_by_company_shuffle_nothing(spark, tmp_path):
    rng = random.Random(3)
    rows = [(c, rng.choice(["A", "B", "C", "X"]), "USD", None if rng.random() < 0.4 else D(2023, 1, 1), rng.choice([D(2023, 12, 31), D(2022, 12, 31)]), float(rng.randrange(3)), f"a{c}-{rng.randrange(4)}", "10-K", 2023, "FY", k) for c in range(30) for k in range(rng.randrange(25))]
    facts = spark.createDataFrame(rows, schemas.FACTS)
    index = spark.createDataFrame([(c, f"n{c}", "t", "10-K", D(2024, 2, 1), rng.choice([D(2023, 12, 31), D(2022, 12, 31)]), f"a{c}-{k}", "x.htm", 1, f"d{c}-{k}") for c in range(32) for k in range(3)], schemas.FILINGS)
    plain = [sorted(map(str, df.collect())) for df in labels.build_labels(index, facts, FIELD)]
    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        facts, index = (readers.save_by_company(df, str(tmp_path / n), 4) for df, n in ((facts, "facts"), (index, "filings")))
        made = labels.build_labels(index, facts, FIELD)
        for df in made[:2]:
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan and "SinglePartition" not in plan
        assert [sorted(map(str, df.collect())) for df in made] == plain and plain[0] and plain[1]
    finally:
        spark.conf.set(setting, before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_replies(spark):
    replies = ['say {"a": "1,5$", "b": true} ok', '{"a": 2.5}', "{oops}", "[1]", None, '{"a": {"x": 1}, "b": "no"}']
    got = spark.createDataFrame([(r,) for r in replies], "reply string").select(model.parse_reply(F.col("reply"), ["a", "b"]).alias("p")).collect()
    assert [(r.p.status, r.p["values"].a, r.p["values"].b) for r in got] == [("ok", 15.0, None), ("ok", 2.5, None), ("unparseable_response", None, None), ("unparseable_response", None, None), ("unparseable_response", None, None), ("ok", None, None)]


def test_densest_window_takes_the_first_best(spark):
    text = "x" * 30 + "net sales net sales" + "y" * 60
    got = spark.range(1).select(model.densest_window(F.lit(text), 25, 10).alias("w")).first().w
    best = max(range(0, len(text) - 25 + 1, 10), key=lambda s: (text[s : s + 25].count("net sales"), -s))
    assert got == text[best : best + 25]


def plain_start(text, budget, stride, words):
    low = text.lower()
    starts = range(0, max(len(text) - budget, 0) + 1, stride)
    return max(starts, key=lambda s: (sum(low[s : s + budget].count(w) for w in words), -s))


def test_densest_window_of_words_that_overlap(spark):
    rng = random.Random(1)
    words = ("aa", "aba", "ab", "b", "net", "İ".lower(), "banana b")
    texts = ["".join(rng.choice(["a", "b", "A", "net ", "c", "İ", "banana b", "é"]) for _ in range(rng.randrange(400))) for _ in range(120)]
    for budget, stride in ((30, 7), (31, 40), (1, 1), (500, 3)):
        assert [model.densest_start(t, budget, stride, words) for t in texts] == [plain_start(t, budget, stride, words) for t in texts]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None, ""])], "k int, t string")
    got = {r.k: r.w for r in df.select("k", model.densest_window(F.col("t"), 30, 7, words).alias("w")).collect()}
    assert got == {k: t[(s := plain_start(t, 30, 7, words)) : s + 30] for k, t in enumerate(texts)} | {len(texts): None, len(texts) + 1: ""}


def test_densest_window_is_linear():
    one = ("word net sales of the year, total assets and " * 24_000)[:1_000_000]
    took = []
    for n in (1, 4):
        began = time.monotonic()
        model.densest_start(one * n, 1_000_000, 200, model.VOCABULARY)
        took.append(time.monotonic() - began)
    assert took[1] < 2 and took[1] < 12 * took[0]


def test_retries():
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise model.Failed(503, wait=100.0 if len(calls) == 1 else None)
        return "x", 1, 1

    assert model.with_retries(call, sleep=waits.append) == ("x", 1, 1) and waits[0] == 60.0 and 2 <= waits[1] <= 4
    with pytest.raises(model.Failed):
        model.with_retries(lambda: (_ for _ in ()).throw(model.Failed(400)))


CLIENT = partial(model.StubProvider, {"Broken": None, "Acme": '{"income": 5, "assets": null}'})


def test_model_run_scored_and_reported(spark, filings):
    filings = filings.withColumn("company", F.when(F.col("cik") == 2, "Broken").otherwise(F.col("company")))
    prepared = spark.createDataFrame([("f1", 0, 0, 0, "text", []), ("f2", 0, 0, 0, None, None)], schemas.PREPARED)
    rates = readers.pricing(spark, {"stub": (2.0, 1.0)})
    got = model.run_model(prepared, filings, CLIENT, rates, runs=2, fields=FIELD, store=lambda df: df.cache())
    cells = {(r.doc_id, r.field, r.run_label): (r.predicted, r.status, r.usd) for r in got.collect()}
    assert len(cells) == 8 and cells["f1", "income", "run1"][:2] == (5.0, "ok") and cells["f1", "assets", "run2"][1] == "llm_no_answer" and cells["f2", "income", "run1"][1] == "llm_error"
    priced = got.where("usd is not null").first()
    assert priced.usd == pytest.approx((priced.input_tokens * 2 + priced.output_tokens) / 1e6)
    only = spark.createDataFrame([("f1", ["income"])], "doc_id string, fields array<string>")
    routed = model.run_model(prepared, filings, CLIENT, rates, fields=FIELD, only=only).collect()
    assert [(r.doc_id, r.field, r.predicted) for r in routed] == [("f1", "income", 5.0)] and routed[0].input_tokens == 2 * priced.input_tokens
    truth = spark.createDataFrame([("f1", 1, "Acme", "AC", D(2024, 12, 31), D(2025, 2, 1), "acc1", "income", "A", "USD", 5.0), ("f1", 1, "Acme", "AC", D(2024, 12, 31), D(2025, 2, 1), "acc1", "assets", "C", "USD", 9.0)], schemas.TRUTH)
    rules = predictions(spark, [("f1", "income", "rules", None, 7.0, "ok", 0.0, 0.0, 0.0, 0.0), ("f1", "assets", "rules", None, None, "row_not_found", 0.0, 0.0, 0.0, 0.0)])
    splits = spark.createDataFrame([(1, "dev")], "cik long, split string")
    periods = spark.createDataFrame([(1, "income", D(2023, 12, 31), 7.0)], schemas.ALL_PERIODS)
    scored = report.evaluate(rules, got, truth, periods, splits).cache()
    tables = report.build_report(scored, scored.select("doc_id", "field", "method", "seconds"), prepared)
    assert {(r.method, r.outcome) for r in tables["failure_breakdown"].collect()} == {("rules", "wrong_period"), ("rules", "not_found"), ("llm", "correct"), ("llm", "not_found"), ("hybrid", "wrong_period"), ("hybrid", "not_found")}
    assert all(df.columns and df.collect() is not None for df in tables.values())
    assert {r.method: r.cells for r in tables["accuracy_overall_dev"].collect()} == {"rules": 2, "llm": 4, "hybrid": 4}


def test_split_and_samples(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 20)
    a, b = (split.group_split(df.repartition(n), "k", 7, 8, (3,)).collect() for n in (1, 5))
    assert sorted(a) == sorted(b) and sum(r.split == "dev" for r in a) == 8 and next(r.split for r in a if r.k == 3) == "dev"
    picks = split.sample_per_group(df, ["k"], 2, 1, ["id"])
    assert picks.count() == 40
    assert stats.digest(df, ["id", "k"]) == stats.digest(df.repartition(7), ["id", "k"]) != stats.digest(df.where("id > 0"), ["id", "k"])


def test_readers_and_stages(spark, tmp_path):
    for name in ("submissions", "facts", "pages"):
        (tmp_path / "in" / name).mkdir(parents=True)
    recent = {"accessionNumber": ["a1", "a2", "a3"], "form": ["10-K", "10-K", "8-K"], "filingDate": ["2024-02-01", "2024-05-01", "2024-06-01"], "reportDate": ["2023-12-31", "2023-12-31", "2024-05-31"], "primaryDocument": ["x.htm", "y.htm", "z.htm"]}
    (tmp_path / "in/submissions/CIK0000000007.json").write_text(json.dumps({"name": "Acme", "tickers": ["AC"], "filings": {"recent": recent}}))
    fact = {"start": "2023-01-01", "end": "2023-12-31", "val": 1.2e9, "accn": "a1", "form": "10-K", "fy": 2023, "fp": "FY"}
    (tmp_path / "in/facts/7.json").write_text(json.dumps({"cik": 7, "facts": {"us-gaap": {"Revenues": {"units": {"USD": [fact]}}}}}))
    table = "".join(f"<tr><td>{a}</td><td>{b}</td><td>{c}</td></tr>" for a, b, c in [("", 2023, 2022), ("Total revenues", "1,200", "1,000"), ("Cost of sales", 700, 600), ("Gross profit", 500, 400), ("Net income", 90, 80)])
    (tmp_path / "in/pages/0000000007_a1.htm").write_bytes(f"<p>Caf\xe9</p><p>Consolidated Statements of Income (in millions)</p><table>{table}</table>".encode("latin-1"))
    took = cli.run("all", str(tmp_path / "in"), str(tmp_path / "out"), spark)
    assert list(took) == list(cli.STAGES)
    index = spark.read.parquet(f"{tmp_path}/out/index").collect()
    assert [(r.doc_id, r.accession, str(r.filing_date)) for r in index] == [("0000000007_a1", "a1", "2024-02-01")]
    cell = spark.read.parquet(f"{tmp_path}/out/scored").where("field = 'revenue'").first()
    assert cell.predicted == cell.true_value == 1.2e9 and cell.outcome == "correct"
    back = readers.csv_table(spark, f"{tmp_path}/out/csv/accuracy_overall", "method string, cells long, correct long, accuracy double, ci_low double, ci_high double").first()
    assert (back.method, back.cells, back.correct) == ("rules", 1, 1)
    pages = readers.raw_pages(spark, f"{tmp_path}/in/pages")
    assert "Café" in pages.first().html
    assert readers.document_status(spark.read.parquet(f"{tmp_path}/out/index"), pages).first().doc_status == "ok"


def test_overflow_pages_of_a_history(spark, tmp_path):
    recent = {"accessionNumber": ["a9"], "form": ["10-K"], "filingDate": ["2024-02-01"], "reportDate": ["2023-12-31"], "primaryDocument": ["x.htm"], "isInlineXBRL": [1]}
    older = {"accessionNumber": ["a1", "a2"], "form": ["10-K", "10-Q"], "filingDate": ["2020-02-01", "2020-05-01"], "reportDate": ["2019-12-31", "2020-03-31"]}
    (tmp_path / "CIK0000000007.json").write_text(json.dumps({"name": "Acme", "tickers": ["AC", "AD"], "filings": {"recent": recent, "files": [{"name": "CIK0000000007-submissions-001.json"}]}}))
    (tmp_path / "CIK0000000007-submissions-001.json").write_text(json.dumps(older))
    (tmp_path / "CIK0000000007-submissions-002.json").write_text(json.dumps(older))  # not named by the history
    (tmp_path / "CIK0000000008.json").write_text(json.dumps({"name": "None", "tickers": [], "filings": {"recent": {}, "files": []}}))
    got = sorted((r.cik, r.company, r.ticker, r.accession, r.form, str(r.report_date), r.primary_document, r.is_inline_xbrl) for r in readers.submissions(spark, str(tmp_path)).collect())
    assert got == [(7, "Acme", "AC", "a1", "10-K", "2019-12-31", "", 0), (7, "Acme", "AC", "a2", "10-Q", "2020-03-31", "", 0), (7, "Acme", "AC", "a9", "10-K", "2023-12-31", "x.htm", 1)]


def test_all_stages_with_a_model(spark, tmp_path):
    for name in ("submissions", "facts", "pages"):
        (tmp_path / "in" / name).mkdir(parents=True)
    recent = {"accessionNumber": ["a1"], "form": ["10-K"], "filingDate": ["2024-02-01"], "reportDate": ["2023-12-31"], "primaryDocument": ["x.htm"]}
    (tmp_path / "in/submissions/CIK0000000007.json").write_text(json.dumps({"name": "Acme", "tickers": ["AC"], "filings": {"recent": recent}}))
    fact = {"start": "2023-01-01", "end": "2023-12-31", "val": 1.2e9, "accn": "a1", "form": "10-K", "fy": 2023, "fp": "FY"}
    (tmp_path / "in/facts/7.json").write_text(json.dumps({"cik": 7, "facts": {"us-gaap": {"Revenues": {"units": {"USD": [fact]}}}}}))
    (tmp_path / "in/pages/0000000007_a1.htm").write_text("<p>no table here</p>")
    cli.run("all", str(tmp_path / "in"), str(tmp_path / "out"), spark, runs=2, make_provider=lambda: model.StubProvider({"Acme": '{"revenue": "1,200,000,000"}'}), rates={"stub": (1.0, 2.0)})
    scored = spark.read.parquet(f"{tmp_path}/out/scored")
    got = sorted((r.method, r.run_label or "", r.outcome) for r in scored.where("field = 'revenue'").collect())
    assert got == [("hybrid", "run1", "correct"), ("hybrid", "run2", "correct"), ("llm", "run1", "correct"), ("llm", "run2", "correct"), ("rules", "", "not_found")]
    assert "seconds" not in scored.columns and spark.read.parquet(f"{tmp_path}/out/latency").count() == scored.count()
    timings = {r.stage: r for r in spark.read.schema(cli.TIMINGS).json(f"{tmp_path}/out/run_timings").collect()}
    assert set(timings) == {*cli.STAGES, "total"}
    assert timings["prepare"].seen == {"parsed": 1, "broken": 0, "tables": 0, "ix_facts_removed": 0} and timings["prepare"].failures == dict.fromkeys(readers.FAILURES, 0)
    assert timings["rules"].failures["statement_not_found"] == len(FIELDS) and timings["rules"].rows == 2 * len(FIELDS) and timings["index"].bytes > 0
    assert timings["labels"].failures["no_concept_present"] == len(FIELDS) - 1
    assert spark.read.parquet(f"{tmp_path}/out/predictions_rules").where("seconds <= 0").count() == 0


def test_densest_window_by_blocks(spark):
    import random

    rng = random.Random(1)
    words = ("alpha", "beta", "stockholders", "aa")
    texts = ["", "alpha", *[" ".join(rng.choice([*words, "x", "yy", "zzz"]) for _ in range(rng.randrange(400))) for _ in range(40)]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    for budget, stride in ((100, 20), (100, 33), (20, 50), (64, 64)):
        got = {r.i: r.w for r in df.select("i", model.densest_window(F.col("t"), budget, stride, words).alias("w")).collect()}
        for i, x in enumerate(texts):
            starts = range(0, max(len(x) - budget, 0) + 1, stride)
            best = max(starts, key=lambda s: (sum(x[s : s + budget].lower().count(w) for w in words), -s))
            assert got[i] == x[best : best + budget]


def test_deep_nesting_is_parsed():
    from ledgerlens.sources import html

    page = "<div>" * 100_000 + "<table><tr><td>a</td><td>1</td></tr></table>" + "</div>" * 100_000
    assert html.parse_page("<p>above</p>" + page)["tables"][0]["rows"] == [["a", "1"]]


def test_dotenv(tmp_path, monkeypatch):
    monkeypatch.setenv("KEPT", "old")
    monkeypatch.delenv("FRESH", raising=False)
    (tmp_path / ".env").write_text("# note\nKEPT=new\nFRESH='v'\n")
    assert readers.dotenv(str(tmp_path / ".env")) == {"KEPT": "old", "FRESH": "v"}


def test_stream_extracts_each_document_once(spark, tmp_path):
    from test_extract import INCOME

    row = ("d", 0, 0, 0, "t", [(0, INCOME, "Consolidated statements of income", "income_statement", 1, None)], D(2024, 12, 31), dt.datetime(2025, 1, 1))
    spark.createDataFrame([row, row], schemas.PREPARED + ", report_date date, seen timestamp").write.parquet(f"{tmp_path}/in")
    stream = ingest.prepared_stream(spark, f"{tmp_path}/in")
    q = ingest.extract_stream(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    q.awaitTermination(120)
    out = spark.read.parquet(f"{tmp_path}/out").where("field = 'revenue'").collect()
    assert [(r.doc_id, r.predicted) for r in out] == [("d", 1200.0)]
