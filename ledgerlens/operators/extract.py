"""Rule extraction: from prepared documents to one answer for each field.

Everything is a narrow projection over the nested tables: features of each table are computed once,
the table of each statement is the least by (captioned?, -score, index), and the fields' label
patterns are CASE chains of literals, so that no regular expression is compiled for a row. The one
shuffle brings a document's tables together, and carries only the candidates' rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import captions, figures, headers
from ..functions.columns import once
from ..functions.fields import FIELDS, Field, first_match, matches_any

# Words that mark a statement's rows, least scores, what is no section heading.
ANCHORS = {
    "income_statement": ("cost of", "gross margin", "gross profit", "operating expenses", "net income", "net earnings", "per share", "income tax", "revenue", "net sales"),
    "balance_sheet": ("total assets", "total current liabilities", "total current assets", "retained earnings", "accumulated deficit", "goodwill", "total liabilities and", "common stock", "accounts payable"),
    "cash_flow": ("operating activities", "investing activities", "financing activities", "depreciation", "amortization", "net cash"),
}
CAPTION_BONUS, LEAST_SCORE, LEAST_COMPARATIVE_ROWS, PER_SHARE_MOST = 4, 4, 3, 1000.0
CAPTION_LIKE = r"(?i)(thousand|million|billion|except|par value|in dollars|unaudited)"
HEADER_LIKE = r"(?i)((19|20)\d{2}|january|february|march|april|may|june|july|august|september|october|november|december)"


def table_features(tables: DataFrame, dash_as_zero: bool = False) -> DataFrame:
    """tables: one row for each table, with rows, preamble and statement. Adds labels, figures, headings, dates, years, comparative and interim."""
    out = tables.withColumn("figures", F.transform("rows", lambda r: figures.row_figures(r, dash_as_zero)))
    out = out.withColumn("labels", F.transform("rows", figures.row_label))
    heading = lambda label, k: F.when((label != "") & (F.size(F.get("figures", k)) == 0) & ~label.rlike(CAPTION_LIKE) & ~label.rlike(HEADER_LIKE), label)
    out = out.withColumn("_own", F.transform("labels", heading))
    def carried(own: Column) -> Column:
        """Each heading as often as there are rows until the next one; no list is copied for a row."""
        places = F.filter(F.sequence(F.lit(0), F.size(own)), lambda k: (k < F.size(own)) & F.get(own, k).isNotNull())
        below = lambda at: F.transform(at, lambda k, i: F.array_repeat(F.get(own, k), F.coalesce(F.get(at, i + 1), F.size(own)) - k))
        return once(places, lambda at: F.flatten(F.concat(F.array(F.array_repeat(F.lit(""), F.coalesce(F.get(at, 0), F.size(own)))), below(at))))

    return (
        out.withColumn("headings", once(F.col("_own"), carried))
        .withColumn("dates", headers.header_dates(F.col("rows")))
        .withColumn("years", headers.header_years(F.col("rows")))
        .withColumn("comparative", F.size(F.filter("figures", lambda v: F.size(v) >= 2)))
        .withColumn("interim", captions.is_interim(F.col("rows")))
        .drop("_own")
    )


def table_score(statement: str) -> Column:
    words = F.array_join("labels", " | ")
    score = F.when(F.col("statement") == statement, CAPTION_BONUS).otherwise(0)
    for a in ANCHORS[statement]:
        score += words.contains(a).cast("int")
    return score - F.when(F.col("preamble").rlike(captions.NOTE_LANGUAGE), CAPTION_BONUS).otherwise(0)


def _uncaptioned(statement: str) -> Column:
    return F.coalesce(F.col("statement") != statement, F.lit(True))


def _table() -> Column:
    return F.struct("index", "labels", "figures", "headings", "dates", "years", "scale", "rows", "preamble")


def pick_statements(features: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, wanted, table): the best table for each statement, of those that compare periods, are not interim and score enough."""
    ranked = [F.struct(F.lit(s).alias("wanted"), table_score(s).alias("score"), _uncaptioned(s).alias("uncaptioned")) for s in ANCHORS]
    able = features.where((F.col("comparative") >= LEAST_COMPARATIVE_ROWS) & ~F.col("interim"))
    each = able.withColumn("_c", F.explode(F.array(*ranked))).where(F.col("_c.score") >= LEAST_SCORE)
    order = F.struct(F.col("_c.uncaptioned"), -F.col("_c.score"), F.col("index"))
    return each.groupBy(key, F.col("_c.wanted").alias("wanted")).agg(F.min_by(_table(), order).alias("table"))


def statement_tables(tables: DataFrame, dash_as_zero: bool = False, key: str = "doc_id") -> DataFrame:
    """pick_statements(table_features(tables)), with only what ranks a table computed for all of them, and the rest for those picked.

    tables: one row for each table; a document's tables are never held together.
    """
    comparative = F.size(F.filter("rows", lambda r: F.size(figures.row_figures(r, dash_as_zero)) >= 2))
    able = tables.where(~captions.is_interim(F.col("rows"))).where(comparative >= LEAST_COMPARATIVE_ROWS)
    labelled = able.withColumn("labels", F.transform("rows", figures.row_label))
    scored = labelled.select(key, F.struct("index", "rows", "preamble", "statement", "scale").alias("_raw"), *[F.struct(_uncaptioned(s).alias("uncaptioned"), (-table_score(s)).alias("minus"), "index").alias(f"_{s}") for s in ANCHORS])
    enough = {s: F.when(F.col(f"_{s}.minus") <= -LEAST_SCORE, F.col(f"_{s}")) for s in ANCHORS}
    best = scored.groupBy(key).agg(*[F.min_by("_raw", order).alias(s) for s, order in enough.items()])
    each = best.select(key, F.inline(F.array(*[F.struct(F.lit(s).alias("wanted"), F.col(s).alias("_raw")) for s in ANCHORS]))).where("_raw is not null")
    return table_features(each.select(key, "wanted", "_raw.*"), dash_as_zero).select(key, "wanted", _table().alias("table"))


def _hits(f: Field, t: Column) -> Column:
    """Rows that print the field, as structs by (priority, row, label); headings decide only if no label does."""
    rows = F.transform(t["labels"], lambda label, k: F.struct(label.alias("label"), F.get(t["headings"], k).alias("heading"), F.get(t["figures"], k).alias("figures"), k.alias("row")))
    vetoed = lambda r: matches_any(r["label"], f.exclude_patterns) | ((r["heading"] != "") & matches_any(r["heading"], f.section_exclude_patterns))
    usable = F.filter(rows, lambda r: (F.size(r["figures"]) > 0) & ~vetoed(r))
    made = lambda priority, r, label: F.struct(priority.alias("priority"), r["row"].alias("row"), label.alias("label"), r["figures"].alias("figures"))
    ranked = lambda rows: F.filter(rows, lambda h: h["priority"].isNotNull())
    named = lambda usable: ranked(F.transform(F.filter(usable, lambda r: r["label"] != ""), lambda r: made(first_match(r["label"], f.row_patterns), r, r["label"])))
    if not f.section_patterns:
        return F.array_sort(named(usable))
    n = len(f.row_patterns)
    below = lambda usable: ranked(F.transform(F.filter(usable, lambda r: r["heading"] != ""), lambda r: made(first_match(r["heading"], f.section_patterns) + n, r, F.concat(F.lit("[section] "), r["heading"]))))
    first = lambda rows: once(rows["label"], lambda names: F.transform(F.array_distinct(names), lambda x: F.get(rows, (F.array_position(names, x) - 1).cast("int"))))
    return F.array_sort(once(usable, lambda u: once(named(u), lambda found: F.when(F.size(found) > 0, found).otherwise(once(below(u), first)))))


def _viable(f: Field, hits: Column, column: Column, scale: Column) -> Column:
    """Hits whose figure in the period's column is one that the field can have."""
    value = lambda h: F.get(h["figures"], column["index"]) * (scale if f.scaled else F.lit(1))
    fits = lambda v: (F.abs(v) <= PER_SHARE_MOST) if f.unit == "USD/shares" else F.lit(True) if f.negative_ok else (v >= 0)
    return F.filter(F.transform(hits, lambda h: F.struct(h["label"].alias("label"), value(h).alias("value"))), lambda x: x["value"].isNotNull() & fits(x["value"]))


def _answer(f: Field, t: Column, column: Column, hits: Column, viable: Column) -> Column:
    best = F.get(viable, 0)
    found = column["index"].isNotNull()
    status = (
        F.when(t.isNull(), "statement_not_found").when(~found, "column_unresolved").when(F.size(hits) == 0, "row_not_found").when(F.size(viable) == 0, "no_value_in_row").otherwise("ok")
    )
    return F.struct(
        F.lit(f.key).alias("field"),
        F.lit(f.unit).alias("unit"),
        status.alias("status"),
        F.when(found, best["value"]).alias("predicted"),
        t["index"].alias("table_index"),
        F.when(found, F.coalesce(best["label"], F.get(hits, 0)["label"])).alias("matched_label"),
        F.when(found, t["scale"]).alias("scale"),
        column["index"].alias("column_index"),
        F.when(t.isNotNull(), column["basis"]).alias("column_basis"),
    )


def extract(prepared: DataFrame, periods: DataFrame, fields: list[Field] = FIELDS, dash_as_zero: bool = False) -> DataFrame:
    """One row for each document of `periods` (doc_id, report_date) and field.

    prepared: doc_id and tables (see schemas.PREPARED). A document without tables gets
    statement_not_found; tables without rows, or with null cells, are allowed. Columns, hits and values are
    projections of their own, each read more than once by the next, so that none is merged into it.
    """
    tables = prepared.select("doc_id", F.inline("tables")).where("rows is not null")
    return read_fields(statement_tables(tables, dash_as_zero), periods, fields)


def read_fields(picked: DataFrame, periods: DataFrame, fields: list[Field] = FIELDS) -> DataFrame:
    """The answers that `extract` gives, from the tables of `statement_tables`."""
    by_statement = picked.groupBy("doc_id").pivot("wanted", list(ANCHORS)).agg(F.first("table"))
    wide = periods.select("doc_id", "report_date").join(by_statement, "doc_id", "left")
    n = range(len(fields))
    wide = wide.withColumns({f"_column_{s}": headers.resolve_column(F.col(s)["dates"], F.col(s)["years"], F.col("report_date")) for s in ANCHORS} | {f"_hits_{k}": _hits(fields[k], F.col(fields[k].statement)) for k in n})
    at = lambda k: F.col(f"_column_{fields[k].statement}")
    wide = wide.withColumns({f"_viable_{k}": _viable(fields[k], F.col(f"_hits_{k}"), at(k), F.col(fields[k].statement)["scale"]) for k in n})
    answers = F.array(*[_answer(fields[k], F.col(fields[k].statement), at(k), F.col(f"_hits_{k}"), F.col(f"_viable_{k}")) for k in n])
    return wide.select("doc_id", F.inline(answers)).withColumn("method", F.lit("rules"))
