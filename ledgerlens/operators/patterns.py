"""Labels against pattern lists of any length.

A CASE of thousands of patterns is tried from its top for every label. Here patterns are looked up by the literal
text that they begin with: a label's beginnings of a few lengths meet the patterns in an equi-join, and only those
that share one are tried. Patterns without a literal beginning stay a CASE. Each distinct label is looked up once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import first_match

#: Lengths to which literal beginnings are cut, so that a label has as many keys at most.
LENGTHS = (1, 2, 4, 8, 12, 16, 24, 32)
_SPECIAL, _REPEAT = ".[](){}*+?^$|\\", "*?{"


def literal_prefix(pattern: str) -> str:
    """Text that every match of the pattern begins with; empty where that cannot be told simply."""
    p = pattern.removeprefix("^")
    depth, k = 0, 0
    while k < len(p):  # a choice between whole patterns has no beginning in common
        if p[k] == "\\":
            k += 1
        elif p[k] in "([":
            depth += 1
        elif p[k] in ")]":
            depth -= 1
        elif p[k] == "|" and depth <= 0:
            return ""
        k += 1
    out, k = [], 0
    while k < len(p):
        c, size = p[k], 1
        if c == "\\":
            if k + 1 == len(p) or p[k + 1].isalnum():
                break
            c, size = p[k + 1], 2
        elif c in _SPECIAL:
            break
        if p[k + size : k + size + 1] and p[k + size] in _REPEAT:
            break
        out.append(c)
        k += size
    return "".join(out)


def first_matches(df: DataFrame, label: str, patterns: tuple[str, ...], name: str = "priority") -> DataFrame:
    """`df` with `name`: the number of the first pattern that matches at the label's start, or null; as fields.first_match.

    The list of patterns is the user's and goes to every task. Null labels match nothing.
    """
    spark = df.sparkSession
    cut = lambda x: x[: max((n for n in LENGTHS if n <= len(x)), default=0)]
    keyed = [(cut(literal_prefix(p)), k, f"^(?:{p})") for k, p in enumerate(patterns)]
    loose = [k for key, k, _ in keyed if not key]
    case = first_match(F.col("_label"), tuple(patterns[k] for k in loose))
    if loose:
        case = F.get(F.array(*map(F.lit, loose)), case)  # back to the numbers of the whole list
    labels = df.select(F.col(f"`{label}`").alias("_label")).where("_label is not null").distinct()
    index = spark.createDataFrame([r for r in keyed if r[0]], "_begin string, _k int, _pattern string")
    begins = F.transform(F.filter(F.array(*map(F.lit, LENGTHS)), lambda n: n <= F.length("_label")), lambda n: F.substring(F.col("_label"), F.lit(1), n))
    tried = labels.select("_label", F.explode(begins).alias("_begin")).join(F.broadcast(index), "_begin").where(F.rlike("_label", F.col("_pattern")))
    found = tried.groupBy("_label").agg(F.min("_k").alias("_k"))
    told = labels.join(found, "_label", "left").select("_label", F.least("_k", case).alias("_found"))
    return df.join(told, F.col(f"`{label}`") == F.col("_label"), "left").drop("_label").withColumnRenamed("_found", name)
