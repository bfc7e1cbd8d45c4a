"""What is not done twice: parsing of stored pages, calls that were answered."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerlens import schemas
from ledgerlens.operators import model
from ledgerlens.plans import cli
from ledgerlens.plans.measure import Measured, save
from ledgerlens.sources import html, readers, store

PAGE = "<p>{0}</p><table><tr><td>a{0}</td><td>{0}</td></tr></table>"


def pages(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, html string")


def test_only_new_pages_are_parsed(spark, tmp_path):
    path = str(tmp_path / "store")
    one = pages(spark, [(f"d{k}", PAGE.format(k)) for k in range(6)] + [("empty", None), ("d1", PAGE.format(1)), (None, "<p>x</p>")])
    got, counted = store.prepare(one, path)
    assert counted == {"parsed": 7, "broken": 0, "tables": 6, "ix_facts_removed": 0}
    again, counted = store.prepare(one, path)
    assert counted["parsed"] == 0
    want = sorted(map(str, html.prepare(one.where("doc_id is not null").distinct()).collect()))
    assert sorted(map(str, got.select(*html.prepare(one).columns).collect())) == sorted(map(str, again.select(*html.prepare(one).columns).collect())) == want
    two = pages(spark, [("d1", PAGE.format(1)), ("d2", PAGE.format("new")), ("d9", PAGE.format(9))])  # one kept, one changed, one more
    got, counted = store.prepare(two, path)
    assert counted["parsed"] == 2 and counted["tables"] == 2
    assert {r.doc_id: r.tables[0].rows[0][1] for r in got.collect()} == {"d1": "1", "d2": "new", "d9": "9"}
    assert store.prepare(two, path, once=True)[1]["parsed"] == 3  # another parser
    store.compact(spark, path, str(tmp_path / "small"), store.keyed(two))
    assert store.stored(spark, str(tmp_path / "small"), store.version()).count() == 3
    assert store.prepare(two, str(tmp_path / "small"))[1]["parsed"] == 0


def test_a_batch_that_broke_off_is_written_again(spark, tmp_path):
    path = str(tmp_path / "store")
    df = pages(spark, [("a", PAGE.format(1)), ("b", PAGE.format(2))])
    store.prepare(df, path)
    [batch] = [x for x in os.listdir(f"{path}/parser=1") if x.startswith("batch=")]
    for x in os.listdir(f"{path}/parser=1/{batch}"):  # as if the job had ended before its files were there
        os.remove(f"{path}/parser=1/{batch}/{x}")
    got, counted = store.prepare(df, path)
    assert counted["parsed"] == 2 and got.count() == 2 and len([x for x in os.listdir(f"{path}/parser=1") if x.startswith("batch=")]) == 1


def counting(folder):
    """A provider that writes a line for each call, gives up the worker at one document and refuses another while a file is there."""

    class Counting:
        def complete(self, system, user, most, temperature):
            with open(f"{folder}/calls", "a") as f:
                f.write(user.split("Annual report of ")[1].split(" for")[0] + "\n")
            if "Doc13 " in user and os.path.exists(f"{folder}/break"):
                raise SystemExit
            if "Doc7 " in user and os.path.exists(f"{folder}/refuse"):
                raise model.Failed(400)
            return json.dumps({"revenue": 5}), 10, 2

    return Counting


def test_a_restart_asks_only_what_is_not_answered(spark, tmp_path):
    folder = str(tmp_path)
    n = 24
    filings = spark.createDataFrame([(f"f{k}", k, f"Doc{k}") for k in range(n)], "doc_id string, cik long, company string").withColumn("report_date", F.lit("2024-12-31").cast("date"))
    prepared = spark.createDataFrame([(f"f{k}", 0, 0, 0, "text", []) for k in range(n)], schemas.PREPARED)
    rates = readers.pricing(spark, {"stub": (1.0, 1.0)})
    calls = lambda: open(f"{folder}/calls").read().split()
    ask = lambda settings=None: model.run_model(prepared, filings, counting(folder), rates, settings, runs=2, ledger=f"{folder}/ledger")
    for name in ("break", "refuse"):
        open(f"{folder}/{name}", "w").close()
    few = model.ask.__defaults__
    model.ask.__defaults__ = (2,)  # calls of a task
    try:
        with pytest.raises(Exception, match="SystemExit|abort|fail|crash|exited"):
            ask()
        os.remove(f"{folder}/break")
        before = len(calls())
        kept = model.read_ledger(spark, f"{folder}/ledger/replies").where("error is null").count()
        assert 0 < kept < 2 * n
        ask()
        assert len(calls()) - before == 2 * n - kept  # with the two that are refused
        os.remove(f"{folder}/refuse")
        before = len(calls())
        got = ask()
        assert calls()[before:] == ["Doc7", "Doc7"]  # failed calls are asked again
        cells = got.where("field = 'revenue'").collect()
        assert len(cells) == 2 * n and {(r.status, r.predicted) for r in cells} == {("ok", 5.0)}
        assert len(calls()) == before + 2  # reading the result asks nothing
        ask(model.Settings(temperature=0.5))
        assert len(calls()) == before + 2 + 2 * n  # other settings are other calls
    finally:
        model.ask.__defaults__ = few


def test_failures_of_documents_by_kind(spark):
    index = spark.createDataFrame([(x,) for x in ("ok", "gone", "none", "pdf", "twice")], "doc_id string")
    landed = spark.createDataFrame([("ok", "<p>", 3), ("none", "", 0), ("pdf", "%PDF-1.4", 8), ("twice", "<p>", 3), ("twice", "<p>", 3), ("other", "<p>", 3)], "doc_id string, html string, doc_bytes long")
    got = {r.doc_id: (r.doc_status, r.doc_bytes) for r in readers.document_status(index, landed).collect()}
    assert got == {"ok": ("ok", 3), "gone": ("failed: missing", 0), "none": ("failed: empty", 0), "pdf": ("failed: not_html", 8), "twice": ("failed: ambiguous", 3)}
    assert dict(readers.document_status(index, landed.drop("html")).select("doc_id", "doc_status").collect())["pdf"] == "ok"


def test_saving_counts_without_another_scan(spark, tmp_path):
    seen, made = Measured(), spark.sparkContext.accumulator(0)

    def touched(it):
        for batch in it:
            made.add(batch.num_rows)
            yield batch

    df = spark.range(100).mapInArrow(touched, "id long")
    save(df, str(tmp_path / "a"), seen, failures={"odd": F.col("id") % 2 == 1, "never": F.col("id") < 0}, seen={"total": F.sum("id")})
    save(spark.range(5), str(tmp_path / "b"), seen, failures={"odd": F.col("id") == 1})
    assert (seen.rows, seen.failures, seen.seen) == (105, {"odd": 51, "never": 0}, {"total": 4950}) and seen.bytes > 500
    assert made.value == 100


def test_earlier_answers_do_not_leak_into_a_run_without_a_model(spark, tmp_path):
    for name in ("submissions", "facts", "pages"):
        (tmp_path / "in" / name).mkdir(parents=True)
    recent = {"accessionNumber": ["a1"], "form": ["10-K"], "filingDate": ["2024-02-01"], "reportDate": ["2023-12-31"], "primaryDocument": ["x.htm"]}
    (tmp_path / "in/submissions/CIK0000000007.json").write_text(json.dumps({"name": "Acme", "tickers": ["AC"], "filings": {"recent": recent}}))
    fact = {"start": "2023-01-01", "end": "2023-12-31", "val": 1.2e9, "accn": "a1", "form": "10-K", "fy": 2023, "fp": "FY"}
    (tmp_path / "in/facts/7.json").write_text(json.dumps({"cik": 7, "facts": {"us-gaap": {"Revenues": {"units": {"USD": [fact]}}}}}))
    (tmp_path / "in/pages/0000000007_a1.htm").write_text("<p>no table here</p>")
    methods = lambda: {r.method for r in spark.read.parquet(f"{tmp_path}/out/scored").select("method").distinct().collect()}
    run = lambda stage, **k: cli.run(stage, str(tmp_path / "in"), str(tmp_path / "out"), spark, runs=1, **k)
    run("all", make_provider=model.StubProvider)
    assert methods() == {"rules", "llm", "hybrid"}
    run("all")
    assert methods() == {"rules"}
    run("score")
    assert methods() == {"rules", "llm", "hybrid"}
