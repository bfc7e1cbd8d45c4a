"""python -m ledgerlens.plans.cli STAGE --in FOLDER --out FOLDER: index, labels, prepare, rules, model, score, report or all.

FOLDER/in holds submissions/, facts/ and pages/; each stage reads what the stages before have written.
What each stage took, wrote and failed at goes to run_timings. A provider for the model stage is given to `run`.
"""

from __future__ import annotations

import argparse
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.fields import FIELDS
from ..operators import extract, labels, model, split
from ..session import session
from ..sources import readers, store
from . import report
from .measure import Measured, save

STAGES = ("index", "labels", "prepare", "rules", "model", "score", "report")
TIMINGS = "stage string, seconds double, rows long, bytes long, failures map<string,long>, seen map<string,long>"
COST = ("input_tokens", "output_tokens", "usd")


def run(stage: str, source: str, out: str, spark: SparkSession | None = None, runs: int = 3, make_provider: Callable[[], model.Provider] | None = None, settings: model.Settings | None = None, rates: dict[str, tuple[float | None, float | None]] | None = None, buckets: int = 16) -> dict[str, float]:
    """Seconds of each stage. runs: how often the model is asked, to see how its answers vary.

    Without a provider, `all` leaves the model out, earlier answers too, and the stage alone asks a stub. Pages that were parsed and
    calls that were answered before are not parsed or asked again. run_timings has, for each stage, the seconds, rows, bytes and
    failures by kind that its own writing jobs saw.
    """
    began_at = uuid.uuid4().hex
    spark = spark or session()
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    done: dict[str, tuple[float, Measured]] = {}
    for s in STAGES if stage == "all" else (stage,):
        began, seen = time.monotonic(), Measured()
        keep = lambda df, name, seen=seen, **watched: save(df, f"{out}/{name}", seen, **watched)
        if s == "index":
            index = readers.filing_index(readers.submissions(spark, f"{source}/submissions")).orderBy("company", "report_date")
            keep(index, "index")
        elif s == "labels":
            facts = readers.save_by_company(readers.company_facts(spark, f"{source}/facts"), f"{out}/facts", buckets)
            filings = readers.save_by_company(read("index"), f"{out}/filings", buckets)
            truth, misses, covered = labels.build_labels(filings, facts)
            keep(truth, "truth")
            keep(misses, "misses", failures={k: F.col("reason") == k for k in labels.REASONS})
            keep(covered, "coverage")
            keep(labels.all_period_values(facts), "all_periods")
            keep(split.group_split(read("index"), "cik", seed=0, n_dev=10), "split")
        elif s == "prepare":
            pages = readers.raw_pages(spark, f"{source}/pages")
            keep(readers.document_status(read("index"), pages), "document_status", failures={k: readers.failed(k) for k in readers.FAILURES})
            parsed = store.prepare(pages, f"{out}/prepared_store")[1]
            seen.add(parsed["parsed"], 0, {}, parsed)
            keep(store.keyed(pages).select(*store.KEY).distinct(), "prepared_keys")
        elif s == "rules":
            found = keep(extract.extract(prepared(spark, out), read("index")).drop("unit"), "rules_found", failures={k: F.col("status") == k for k in scoring.UNRESOLVED})
            each = (time.monotonic() - began) / max(1, found.select("doc_id").distinct().count()) / len(FIELDS)  # the stage's time, shared out
            keep(found.withColumn("seconds", F.lit(each)).withColumns({c: F.lit(0.0) for c in COST}), "predictions_rules")
        elif s == "model" and (make_provider or stage == "model"):
            asked = settings or model.Settings()
            prices = readers.pricing(spark, rates or {asked.model: (None, None)})
            answers = model.run_model(prepared(spark, out), read("index"), make_provider or model.StubProvider, prices, asked, runs, ledger=f"{out}/model_ledger")
            keep(answers, "predictions_model", failures={k: F.col("status") == k for k in ("llm_error", "unparseable_response", "llm_no_answer")})
            keep(spark.createDataFrame([(began_at,)], "run string"), "model_run")
        elif s == "score":
            scored = report.evaluate(read("predictions_rules"), model_answers(spark, out, None if stage == "score" else began_at), read("truth"), read("all_periods"), read("split"))
            write_scored(keep, scored)
        elif s == "report":
            for name, df in report.build_report(read("scored"), read("latency"), prepared(spark, out)).items():
                readers.export_csv(df, f"{out}/csv/{name}")
        done[s] = (round(time.monotonic() - began, 2), seen)
    timings = [(k, t, m.rows, m.bytes, m.failures, m.seen) for k, (t, m) in done.items()]
    timings.append(("total", round(sum(t for t, _ in done.values()), 2), sum(m.rows for _, m in done.values()), sum(m.bytes for _, m in done.values()), {}, {}))
    spark.createDataFrame(timings, TIMINGS).coalesce(1).write.mode("overwrite").json(f"{out}/run_timings")
    return {k: t for k, (t, _) in done.items()}


def prepared(spark: SparkSession, out: str) -> DataFrame:
    """The prepared documents of the last `prepare`, from the store."""
    return store.current(store.stored(spark, f"{out}/prepared_store", store.version()), spark.read.parquet(f"{out}/prepared_keys"))


def model_answers(spark: SparkSession, out: str, run: str | None) -> DataFrame | None:
    """The answers of the model stage, which is optional: those of this run of all stages only, or of the last one if run is None."""
    try:
        of = spark.read.parquet(f"{out}/model_run").first().run
    except AnalysisException:
        return None
    return spark.read.parquet(f"{out}/predictions_model") if run in (None, of) else None


def write_scored(keep: Callable[[DataFrame, str], DataFrame], scored: DataFrame) -> None:
    """The scored cells without their seconds, which go to a table of their own: all that was decided is then the same in every run."""
    both = keep(scored, "scored_timed")
    keep(both.select("doc_id", "field", "method", "seconds"), "latency")
    keep(both.drop("seconds"), "scored")


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("stage", choices=(*STAGES, "all"))
    p.add_argument("--in", dest="source", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--runs", type=int, default=3)
    a = p.parse_args()
    for stage, s in run(a.stage, a.source, a.out, runs=a.runs).items():
        print(f"{stage}: {s:.1f} s")


if __name__ == "__main__":
    main()
