"""Queries of the extraction path over printed tables that are made of the driver's tables, with their SQL.

A nation is a document, a customer one of its tables, an order a printed row: its priority gives the label
and its key the figures. The cells are printed as filings print them (notes, dots, split parentheses, dollar
signs, commas), and the SQL states what they say.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import figures, headers
from ..functions.fields import Field
from ..operators import extract
from .registry import query, t

#: Priority and parity of the order's key: the printed label, and how it reads.
LABELS = {
    ("1-URGENT", 0): ("Total assets", "total assets"), ("1-URGENT", 1): ("Retained  Earnings ......", "retained earnings"),
    ("2-HIGH", 0): ("Net income (3)", "net income"), ("2-HIGH", 1): ("Cost of sales", "cost of sales"),
    ("3-MEDIUM", 0): ("Current items:", "current items"), ("3-MEDIUM", 1): ("Current items:", "current items"),
    ("4-NOT SPECIFIED", 0): ("Goodwill (12)", "goodwill"), ("4-NOT SPECIFIED", 1): ("Common stock:", "common stock"),
    ("5-LOW", 0): ("Operating activities", "operating activities"), ("5-LOW", 1): ("Depreciation ....", "depreciation"),
}
STATEMENTS = {"BUILDING": "balance_sheet", "AUTOMOBILE": "income_statement", "MACHINERY": "cash_flow"}
FIELDS = [
    Field("assets", "", "balance_sheet", "instant", negative_ok=False, row_patterns=("total assets", "goodwill", "retained .*"), exclude_patterns=("common.*",)),
    Field("income", "", "income_statement", "duration", scaled=False, row_patterns=("cost of .*", "net income")),
    Field("section", "", "cash_flow", "instant", row_patterns=("no such row",), section_patterns=("current items",)),
]


def _orders_with_cells(spark, d):
    """Orders and their customers, with the cells that each prints. A heading has no figures, every third other row one, the rest two."""
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    label = F.lit(None).cast("string")
    for (priority, parity), (shown, _) in LABELS.items():
        label = F.when((F.col("o_orderpriority") == priority) & (F.col("o_orderkey") % 2 == parity), shown).otherwise(label)
    key = F.col("o_orderkey")
    one, two = F.format_number(key * 37, 0), F.format_number(key * 41 + 5, 0)
    first = F.when(key % 4 == 0, F.array(F.lit("$"), F.lit("("), one, F.lit(")"))).otherwise(F.array(one, F.lit("")))
    second = F.when(key % 3 == 0, F.array().cast("array<string>")).when(key % 5 == 0, F.array(F.concat(F.lit("("), two), F.lit(")"))).otherwise(F.array(F.lit("$"), two))
    cells = F.when(F.col("o_orderpriority") == "3-MEDIUM", F.array(label)).otherwise(F.concat(F.array(F.lit(""), label), first, second))
    return o.withColumn("cells", cells)


def _document_and_table():
    return F.col("c_nationkey").cast("string").alias("doc_id"), F.col("c_custkey").cast("int").alias("index")


def printed_rows(spark, d):
    """(doc_id, index, o_orderkey, cells): the row of each order."""
    return _orders_with_cells(spark, d).select(*_document_and_table(), "o_orderkey", "cells")


def printed_tables(spark, d):
    """(doc_id, index, rows, preamble, statement, scale): a header of years, for some an interim line, then the rows."""
    by = ("c_custkey", "c_nationkey", "c_mktsegment")  # as the join has dealt them, so that no row is shuffled again
    rows = _orders_with_cells(spark, d).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "cells"))).alias("r")).select(*_document_and_table(), "c_mktsegment", "r")
    statement = F.lit(None).cast("string")
    for segment, name in STATEMENTS.items():
        statement = F.when(F.col("c_mktsegment") == segment, name).otherwise(statement)
    header = F.array(F.array(F.lit(""), F.lit("1996"), F.lit("(1995)")))
    interim = F.when(F.col("index") % 11 == 0, F.array(F.array(F.lit("Three Months Ended")))).otherwise(F.array().cast("array<array<string>>"))
    preamble = F.when(F.col("index") % 7 == 0, "The following table shows").otherwise("Results")
    return rows.select("doc_id", "index", F.concat(header, interim, "r.cells").alias("rows"), preamble.alias("preamble"), statement.alias("statement"), F.when(F.col("index") % 2 == 0, 1000).otherwise(1).cast("long").alias("scale"))


_LABEL_SQL = "case " + " ".join(f"when o_orderpriority = '{p}' and o_orderkey % 2 = {k} then '{read}'" for (p, k), (_, read) in LABELS.items()) + " end"
_STATEMENT_SQL = "case " + " ".join(f"when c_mktsegment = '{k}' then '{v}'" for k, v in STATEMENTS.items()) + " end"
_ROWS = f"""with r as (select cast(c_nationkey as varchar) as doc_id, cast(c_custkey as int) as idx, c_mktsegment, o_orderkey, {_LABEL_SQL} as label, o_orderpriority = '3-MEDIUM' as is_heading,
case when o_orderpriority <> '3-MEDIUM' then cast(case when o_orderkey % 4 = 0 then -1 else 1 end * o_orderkey * 37 as double) end as v0,
case when o_orderpriority <> '3-MEDIUM' and o_orderkey % 3 <> 0 then cast(case when o_orderkey % 5 = 0 then -1 else 1 end * (o_orderkey * 41 + 5) as double) end as v1
from orders join customer on o_custkey = c_custkey)"""


@query(f"{_ROWS} select o_orderkey, label, cast((v0 is not null)::int + (v1 is not null)::int as int) as n, v0, v1 from r")
def row_labels_and_figures(spark, d):
    found = printed_rows(spark, d).select("o_orderkey", figures.row_label(F.col("cells")).alias("label"), figures.row_figures(F.col("cells")).alias("f"))
    return found.select("o_orderkey", "label", F.size("f").alias("n"), F.get("f", 0).alias("v0"), F.get("f", 1).alias("v1"))


@query("""select o_orderkey, cast(case when o_orderkey % 3 = 0 then 0 else 2 end as int) as n_dates, case when o_orderkey % 3 <> 0 then strftime(o_orderdate, '%Y-%m-%d') end as first_date,
case when o_orderkey % 3 <> 0 then strftime(o_orderdate - interval 1 year, '%Y-%m-') || '05' end as second_date,
cast(case when o_orderkey % 3 = 0 then year(o_orderdate) end as int) as first_year, cast(case when o_orderkey % 3 = 0 then year(o_orderdate) - 1 end as int) as second_year from orders""")
def header_dates_and_years(spark, d):
    o = t(spark, d, "orders")
    day, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    dates = F.array(F.lit(""), F.concat(F.lit("As of "), F.date_format(day, "MMMM d, yyyy")), F.lit("$"), F.concat(F.date_format(F.add_months(day, -12), "MMM"), F.lit(". 5 "), (F.year(day) - 1).cast("string")))
    years = F.array(F.lit(""), F.concat(F.lit("( "), F.year(day).cast("string"), F.lit(" )")), (F.year(day) - 1).cast("string"))
    rows = F.array(F.array(F.lit("In millions")), F.when(key % 3 == 0, years).otherwise(dates), F.array(F.lit("x"), F.lit("1901"), F.lit("May 1, 1902")))
    made = o.select(key, rows.alias("rows")).select("o_orderkey", headers.header_dates(F.col("rows")).alias("dates"), headers.header_years(F.col("rows")).alias("years"))
    late = F.col("o_orderkey") % 3 == 0  # the last row has a year and a date too; the first row that has one decides for each
    return made.select(
        "o_orderkey", F.when(late, F.size("dates") - 1).otherwise(F.size("dates")).cast("int").alias("n_dates"), F.when(~late, F.get("dates", 0)).alias("first_date"), F.when(~late, F.get("dates", 1)).alias("second_date"),
        F.when(late, F.get("years", 0)).alias("first_year"), F.when(late, F.get("years", 1)).alias("second_year"),
    )


@query(f"""{_ROWS}, z as (select *, case when is_heading then label end as own from r)
select doc_id, idx as "index", o_orderkey, coalesce(last_value(own ignore nulls) over (partition by idx order by o_orderkey rows between unbounded preceding and current row), case when idx % 11 = 0 then 'three months ended' else '' end) as heading from z""")
def running_heading(spark, d):
    """The heading above each row, and the order that the row prints."""
    keys = printed_rows(spark, d).groupBy("doc_id", "index").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    made = extract.table_features(printed_tables(spark, d)).join(keys, ["doc_id", "index"])
    above = F.size("headings") - F.size("keys")
    each = made.select("doc_id", "index", F.inline(F.arrays_zip(F.col("keys").alias("o_orderkey"), F.slice("headings", above + 1, F.size("keys")).alias("heading"))))
    return each.select("doc_id", "index", "o_orderkey", "heading")


_PICKED = f"""{_ROWS}, f as (select doc_id, idx, any_value({_STATEMENT_SQL}) as statement, count(v1) + 1 as comparative, idx % 11 = 0 as interim, case when idx % 7 = 0 then 4 else 0 end as note,
bool_or(label = 'total assets')::int + bool_or(label = 'retained earnings')::int + bool_or(label = 'goodwill')::int + bool_or(label = 'common stock')::int as b,
bool_or(label = 'net income')::int + bool_or(label = 'cost of sales')::int as i, bool_or(label = 'operating activities')::int + bool_or(label = 'depreciation')::int as c from r group by doc_id, idx),
s as (select doc_id, idx, wanted, statement is distinct from wanted as uncaptioned, case wanted when 'balance_sheet' then b when 'income_statement' then i else c end + case when statement = wanted then 4 else 0 end - note as score
from f cross join (values ('income_statement'), ('balance_sheet'), ('cash_flow')) w(wanted) where comparative >= 3 and not interim),
picked as (select doc_id, wanted, idx, score from (select *, row_number() over (partition by doc_id, wanted order by uncaptioned, -score, idx) as k from s where score >= 4) where k = 1)"""


@query(f'{_PICKED} select doc_id, wanted, idx as "index" from picked')
def best_candidate_argmin(spark, d):
    """The table of each statement: captioned ones first, then the best score, then the first."""
    return extract.pick_statements(extract.table_features(printed_tables(spark, d))).select("doc_id", "wanted", "table.index")


@query(f"""{_PICKED}, periods as (select distinct cast(n_nationkey as varchar) as doc_id, cast(1994 + n_nationkey % 4 as int) as y from nation),
wanted as (select doc_id, field, idx, case y when 1994 then null when 1995 then 1 else 0 end as col, case y when 1994 then 'header_year_no_match' when 1997 then 'header_fiscal_year_label' else 'header_year' end as basis
from periods cross join (values ('assets', 'balance_sheet'), ('income', 'income_statement'), ('section', 'cash_flow')) x(field, statement) left join picked using (doc_id) where picked.wanted = statement
union all select doc_id, field, null, case y when 1994 then null when 1995 then 1 else 0 end, null from periods cross join (values ('assets', 'balance_sheet'), ('income', 'income_statement'), ('section', 'cash_flow')) x(field, statement)
where not exists (select 1 from picked p where p.doc_id = periods.doc_id and p.wanted = statement)),
h0 as (select w.doc_id, field, w.idx, w.col, w.basis, o_orderkey, label, is_heading, case when col = 1 then v1 when col = 0 then v0 end * case when field <> 'income' and w.idx % 2 = 0 then 1000 else 1 end as v,
last_value(case when is_heading then label end ignore nulls) over (partition by w.doc_id, field order by o_orderkey rows between unbounded preceding and current row) as heading from wanted w left join r on r.idx = w.idx),
h1 as (select *, case when is_heading then null when field = 'assets' then case label when 'total assets' then 0 when 'goodwill' then 1 when 'retained earnings' then 2 end
when field = 'income' then case label when 'cost of sales' then 0 when 'net income' then 1 end
when field = 'section' and heading is not null and row_number() over (partition by doc_id, field, heading is not null and not is_heading order by o_orderkey) = 1 then 1 end as priority from h0),
a as (select doc_id, field, any_value(idx) as idx, any_value(col) as col, any_value(basis) as basis, count(priority) as hits, count(priority) filter (v is not null and (field <> 'assets' or v >= 0)) as viable,
arg_min(case when field = 'section' then '[section] current items' else label end, priority * 1000000000 + o_orderkey) filter (priority is not null) as first_label,
arg_min(case when field = 'section' then '[section] current items' else label end, priority * 1000000000 + o_orderkey) filter (priority is not null and v is not null and (field <> 'assets' or v >= 0)) as best_label,
arg_min(v, priority * 1000000000 + o_orderkey) filter (priority is not null and v is not null and (field <> 'assets' or v >= 0)) as best from h1 group by doc_id, field)
select doc_id, field, case when idx is null then 'statement_not_found' when col is null then 'column_unresolved' when hits = 0 then 'row_not_found' when viable = 0 then 'no_value_in_row' else 'ok' end as status,
case when idx is not null and col is not null then best end as predicted, idx as table_index, case when idx is not null and col is not null then coalesce(best_label, first_label) end as matched_label,
basis as column_basis from a""")
def extracted_answers(spark, d):
    """Rule extraction of three fields from every nation's tables, for a report year that the header has, lacks or nearly has."""
    prepared = printed_tables(spark, d).groupBy("doc_id").agg(F.collect_list(F.struct("index", "rows", "preamble", "statement", "scale")).alias("tables"))
    n = F.col("n_nationkey")
    periods = t(spark, d, "nation").select(n.cast("string").alias("doc_id"), F.make_date((1994 + n % 4).cast("int"), F.lit(12), F.lit(31)).alias("report_date"))
    return extract.extract(prepared, periods, FIELDS).select("doc_id", "field", "status", "predicted", "table_index", "matched_label", "column_basis")
