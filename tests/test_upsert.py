import datetime as dt

import pytest

from ledgerlens.streaming import upsert
from test_extract import INCOME

D = dt.date


@pytest.fixture
def land(spark, tmp_path):
    before = {k: spark.conf.get(k) for k in upsert.SETTINGS}
    for k, v in upsert.SETTINGS.items():
        spark.conf.set(k, v)
    n = [0]

    def land(rows):
        """rows: (cik, filing date, accession, factor of the printed figures); one file, then one run of the query to its end."""
        n[0] += 1
        table = lambda x: (0, [[c if k == 0 or not c.replace(",", "").isdigit() or (len(c) == 4 and c[:2] in ("19", "20")) else str(int(c.replace(",", "")) * x) for k, c in enumerate(r)] for r in INCOME], "Consolidated statements of income", "income_statement", 1, None)
        made = [(f"d{a}", 0, 0, 0, "t", [table(x)], c, D(2024, 12, 31), f, a) for c, f, a, x in rows]
        if made:
            spark.createDataFrame(made, upsert.FILED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run(settle_ms=10**12):
        q = upsert.upsert_stream(upsert.changes(upsert.filed_stream(spark, f"{tmp_path}/in"), settle_ms), f"{tmp_path}/out", f"{tmp_path}/check")
        assert q.awaitTermination(240)
        return spark.read.parquet(f"{tmp_path}/out/changes")

    yield land, run, str(tmp_path / "out")
    for k, v in before.items():
        spark.conf.set(k, v)


def revenue(spark, out):
    return sorted((r.cik, r.version, r.predicted) for r in upsert.latest(spark, out).where("field = 'revenue'").collect())


def test_corrections_come_late_and_after_a_restart(spark, land):
    put, run, out = land
    put([(1, D(2025, 2, 1), "a1", 1), (2, D(2025, 3, 1), "b2", 1), (2, D(2025, 3, 1), "b1", 7)])  # of one day, the later accession counts
    run()
    base = {c: v for c, _, v in revenue(spark, out)}
    assert [(c, v) for c, v, _ in revenue(spark, out)] == [(1, "2025-02-01 a1"), (2, "2025-03-01 b2")] and base[1]
    put([(1, D(2025, 9, 1), "a9", 3), (2, D(2025, 1, 1), "b0", 5)])  # a late correction, and an older version that comes late
    told = run()
    assert revenue(spark, out) == [(1, "2025-09-01 a9", 3 * base[1]), (2, "2025-03-01 b2", base[2])]
    put([(1, D(2025, 5, 1), "a5", 4), (1, D(2025, 9, 1), "a9", 3)])  # older than what counts, and the same again
    told = run()
    assert revenue(spark, out)[0] == (1, "2025-09-01 a9", 3 * base[1])
    assert sorted((r.cik, r.version, r.kind) for r in told.collect()) == [(1, "2025-02-01 a1", "upsert"), (1, "2025-09-01 a9", "correction"), (2, "2025-03-01 b2", "upsert")]


def test_a_key_settles(spark, land):
    put, run, out = land
    put([(1, D(2025, 2, 1), "a1", 1)])
    run(settle_ms=0)
    put([(5, D(2025, 2, 1), "c1", 1)])  # any later batch lets timers run out
    told = run(settle_ms=0)
    assert ("final", 1) in {(r.kind, r.cik) for r in told.collect()}
    assert {c for c, _, _ in revenue(spark, out)} == {1, 5}
