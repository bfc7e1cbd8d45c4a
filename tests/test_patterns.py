import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.fields import FIELDS, first_match
from ledgerlens.operators import patterns, split


@pytest.mark.parametrize(
    ("pattern", "want"),
    [("^total assets$", "total assets"), ("net income", "net income"), (".*copper", ""), ("ab*c", "a"), ("ab+c", "ab"), ("ab?", "a"), ("ab{2}", "a"), (r"a\\.b", "a.b"), (r"a\\db", "a"), ("a|b", ""), ("total (a|b)", "total "), ("x[ab|c]", "x"), ("(?i)abc", ""), ("", ""), ("a\\", "a"), (r"cash \\(used", "cash (used"), ("a$|b", "")],
)
def test_literal_prefix(pattern, want):
    assert patterns.literal_prefix(pattern.replace("\\\\", "\\")) == want


def listed(n, rng):
    words = "total net cash income assets sales of and (used) equity share per other".split()
    made = []
    while len(made) < n:
        w = [rng.choice(words) for _ in range(rng.randrange(1, 4))]
        body = re.escape(" ".join(w)) + rng.choice(["", "$", ".*", " .*x?", "s?$", f" {rng.randrange(500)}$"])
        made.append(rng.choice(["^", "", "", "(?:a )?" if rng.random() < 0.02 else "", ".*" if rng.random() < 0.01 else ""]) + body)
    return tuple(made), [" ".join(rng.choice([*words, str(rng.randrange(500)), "x", "sales"]) for _ in range(rng.randrange(5))) for _ in range(300)]


def test_as_the_case_form(spark):
    ps, labels = listed(150, random.Random(4))
    df = spark.createDataFrame([(k, x) for k, x in enumerate([*labels, None, "", labels[0]])], "k int, label string")
    want = {r.k: r.p for r in df.select("k", first_match(F.col("label"), ps).alias("p")).collect()}
    got = {r.k: r.priority for r in patterns.first_matches(df, "label", ps).collect()}
    assert got == want and len({*want.values()}) > 15
    for f in FIELDS:
        found = patterns.first_matches(df, "label", f.row_patterns)
        assert {r.k: r.priority for r in found.collect()} == {r.k: r.p for r in df.select("k", first_match(F.col("label"), f.row_patterns).alias("p")).collect()}


def test_five_thousand_patterns(spark):
    ps, labels = listed(5000, random.Random(5))
    compiled = [re.compile(f"^(?:{p})") for p in ps]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(labels)], "k int, label string").repartition(4)
    got = {r.k: r.priority for r in patterns.first_matches(df, "label", ps).collect()}
    assert got == {k: next((i for i, c in enumerate(compiled) if c.search(x)), None) for k, x in enumerate(labels)}


def test_no_patterns_and_no_rows(spark):
    df = spark.createDataFrame([("a",)], "label string")
    assert patterns.first_matches(df, "label", ()).first().priority is None
    assert patterns.first_matches(df.where("false"), "label", ("a",)).count() == 0


def test_group_split_without_a_single_task(spark):
    from pyspark.sql import Window

    df = spark.range(3000).selectExpr("id % 997 as g").unionByName(spark.createDataFrame([(None,)], "g long"))
    for n, pinned in ((0, ()), (1, ()), (100, (5, 6)), (1, (5, 6, 7)), (997, ()), (2000, (3,))):
        by = F.xxhash64("g", F.lit(9))
        first = F.when(F.col("g").isin(*pinned), 0).otherwise(1) if pinned else F.lit(1)
        want = df.select("g").distinct().withColumn("split", F.when(F.row_number().over(Window.orderBy(first, by, "g")) <= n, "dev").otherwise("test"))
        got = split.group_split(df, "g", 9, n, pinned)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, split.group_split(df, "g", 9, n, pinned, by).collect())) == sorted(map(str, want.collect()))
