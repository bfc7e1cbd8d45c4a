import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import nearby


def agree(p, v, unit):
    if unit == "USD/shares" and abs(p - v) <= 0.005:
        return True
    return abs(p) <= 0.005 if v == 0 else abs(p - v) / abs(v) <= 0.005


def brute(rows, values):
    return sorted(((k, e, p, u, e is not None and p is not None and any(x == k and y is not None and y != e and v is not None and agree(p, v, u) for x, y, v in values)) for k, e, p, u in rows), key=str)


def found(spark, rows, values):
    df = spark.createDataFrame(rows, "k string, e int, p double, u string").repartition(3)
    vs = spark.createDataFrame(values, "k string, ve int, v double")
    return sorted(map(tuple, nearby.with_other_period(df, vs, ["k"], "e", "p", F.col("u"), "hit", "ve", "v").collect()), key=str)


def test_near_zero(spark):
    values = [("a", 1, 0.004), ("a", 2, 0.001), ("a", 3, 0.0), ("b", 1, -0.003), ("b", 2, 0.0), ("c", 1, 0.0)]
    rows = [("a", 1, 0.004, "USD"), ("a", 3, 0.0, "USD"), ("b", 1, -0.005, "USD"), ("b", 1, -0.0051, "USD"), ("c", 1, 0.0, "USD"), ("c", 2, 0.0, "USD"), ("c", 2, -0.0, "USD")]
    assert found(spark, rows, values) == brute(rows, values)
    assert ("a", 1, 0.004, "USD", True) in found(spark, rows, values)


@pytest.mark.parametrize("seed", range(4))
def test_against_all_pairs(spark, seed):
    rng = random.Random(seed)

    def value():
        base = rng.choice([0.0, 0.001, 0.0049, 0.005, 0.0051, 0.1, 0.995, 1.0, 1.005, 2.0, 100.0, 1e9, 1e300, 5e-324])
        return rng.choice([-1, 1, 1]) * base * (1 + rng.choice([0, 0.004999, 0.005, 0.0050001, 0.0100, 0.0049]) * rng.choice([-1, 1])) + rng.choice([0, 0, 0.001, -0.0049])

    values = [(rng.choice("abc"), rng.randrange(4), value()) for _ in range(60)] + [("a", None, 5.0), ("a", 1, None), (None, 1, 5.0)]
    rows = [(rng.choice("abcd"), rng.choice([None, 0, 1, 2, 3, 9]), rng.choice([None, value(), value(), rng.choice(values)[2]]), rng.choice(["USD", "USD/shares"])) for _ in range(400)]
    assert found(spark, rows, values) == brute(rows, values)


def test_a_hot_key_gives_no_row_more(spark):
    """One key, one band, all values different: the index keeps two values of a side."""
    values = spark.range(20_000).selectExpr("'k' as k", "cast(id % 500 as int) as e", "1000 + id / 1e5 as v")
    index = nearby.period_index(values, ["k"], "e", "v")
    assert index.agg(F.max(F.size("_near"))).first()[0] <= 8
    out = nearby.with_other_period(values, values, ["k"], "e", "v", F.lit("USD"))
    assert out.count() == 20_000 and out.where("other_period").count() == 20_000


def test_empty_tables(spark):
    rows = spark.createDataFrame([("a", 1, 1.0, "USD")], "k string, e int, p double, u string")
    none = spark.createDataFrame([], "k string, ve int, v double")
    assert not nearby.with_other_period(rows, none, ["k"], "e", "p", F.col("u"), "hit", "ve", "v").first().hit
    assert nearby.with_other_period(rows.where("false"), none, ["k"], "e", "p", F.col("u"), "hit", "ve", "v").count() == 0


def shuffles(df):
    """Exchanges by a key in the plan that ran, without broadcasts and counts of cells."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    return [x.strip() for x in final.splitlines() if "Exchange hashpartitioning" in x]


def own(spark, rows, hot):
    df = spark.createDataFrame(rows, "k string, e int, p double, q double, u string").repartition(3)
    out = nearby.with_other_periods(df, ["k"], "e", {"hit": ("p", F.col("u")), "share": ("q", F.lit("USD/shares"))}, hot)
    assert out.columns == ["k", "e", "p", "q", "u", "hit", "share"]
    return sorted(str(tuple(r)) for r in out.collect())


@pytest.mark.parametrize("hot", [0, 60, nearby.HOT])
@pytest.mark.parametrize("seed", range(3))
def test_own_rows_against_all_pairs(spark, seed, hot):
    """Sorted, looked up, or some keys each: zeros of both signs, ties, runs of one period, nulls, NaN and infinities."""
    rng = random.Random(seed)

    def value():
        base = rng.choice([0.0, -0.0, 0.001, 0.0049, 0.005, 0.0051, 0.1, 0.995, 1.0, 1.005, 2.0, 100.0, 1e9, 1e300, 5e-324])
        return rng.choice([-1, 1, 1]) * base * (1 + rng.choice([0, 0.004999, 0.005, 0.0050001, 0.0100, 0.0049]) * rng.choice([-1, 1])) + rng.choice([0, 0, 0.001, -0.0049])

    odd = [None, float("inf"), float("-inf"), float("nan")]
    one = lambda: rng.choice(odd) if rng.random() < 0.1 else value()
    rows = [(rng.choice("aaaaaabcdefgh"), rng.choice([None, 0, 1, 2, 2, 2, 2]), one(), one(), rng.choice(["USD", "USD/shares"])) for _ in range(160)] + [(None, k, 1.0, 1.0, "USD") for k in range(3)]
    safe = lambda p, v, u: abs(p) < 1e308 and abs(v) < 1e308 and agree(p, v, u)
    hit = lambda k, e, x, u, at: k is not None and e is not None and x is not None and any(r[0] == k and r[1] not in (None, e) and r[at] is not None and safe(x, r[at], u) for r in rows)
    want = [(k, e, p, q, u, hit(k, e, p, u, 2), hit(k, e, q, "USD/shares", 3)) for k, e, p, q, u in rows]
    assert own(spark, rows, hot) == sorted(map(str, want))


def test_near_zero_query_shuffles_rows_once(spark, sf_dir):
    """Two values of a row are asked about; before, each went to bands of its own, ten rows for a value."""
    from ledgerlens.plans import catalogue

    found = shuffles(catalogue.wrong_period_near_zero(spark, sf_dir))
    assert len(found) == 1 and "l_partkey" in found[0]


def test_price_query_shuffles_rows_once(spark, sf_dir):
    from ledgerlens.plans import catalogue

    found = shuffles(catalogue.wrong_period_exists(spark, sf_dir))
    assert len(found) == 1 and "l_partkey" in found[0]
