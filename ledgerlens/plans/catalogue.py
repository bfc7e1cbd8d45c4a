"""Queries over the driver's tables, one or more for each operator, each with the same query in DuckDB's SQL.

The tables hold no filings, so operators run on the nearest shape: labels of documents are the
truth, simple functions of a document's columns are the predictions, orders and line items are
filings and facts, events are a call log.
"""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import figures, headers, scoring, sql
from ..functions.fields import Field, first_match, matches_any
from ..operators import hybrid, labels, model, nearby, patterns, score, split, stats
from ..sources import html, readers
from ..streaming import ingest
from . import report
from .registry import ORACLES, QUERIES, query, t  # noqa: F401

# ---- scans, projections, filters -------------------------------------------------------------


@query("""select o_orderkey, o_custkey, o_totalprice, cast(o_orderdate as date) as order_date from orders
where o_orderstatus = 'F' and o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1997-01-01'""")
def scan_project_filter(spark, d):
    o = t(spark, d, "orders").where("o_orderstatus = 'F' and o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1997-01-01'")
    return o.select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("order_date"))


@query("select printf('%010d_%s', c_custkey, c_name) as doc_id, substr(sha256(c_name), 1, 12) as cache_key from customer")
def key_format(spark, d):
    return t(spark, d, "customer").select(readers.document_key("c_custkey", "c_name").alias("doc_id"), F.substring(F.sha2("c_name", 256), 1, 12).alias("cache_key"))


@query("""select printf('%010d_%s', o_custkey, accession) as doc_id, o_custkey as cik, report_date, filing_date, accession from (select *, row_number() over (partition by o_custkey, report_date order by filing_date, accession) as k
from (select o_custkey, cast(date_trunc('year', o_orderdate) as date) as report_date, cast(o_orderdate as date) as filing_date, cast(o_orderkey as varchar) as accession from orders
where o_orderstatus = 'F' and year(o_orderdate) between 1993 and 1996 and o_orderkey % 5 <> 0)) where k = 1""")
def earliest_per_key(spark, d):
    """Orders as filings: the status is the form, the order's year the period, every fifth has no HTML document."""
    day = F.to_date("o_orderdate")
    name = F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 5 == 0, ".txt").when(F.col("o_orderkey") % 2 == 0, ".HTM").otherwise(".html"))
    filings = t(spark, d, "orders").select(F.col("o_custkey").alias("cik"), F.col("o_orderstatus").alias("form"), F.trunc(day, "year").alias("report_date"), day.alias("filing_date"), F.col("o_orderkey").cast("string").alias("accession"), name.alias("primary_document"))
    return readers.filing_index(filings, "F", (1993, 1996)).select("doc_id", "cik", "report_date", "filing_date", "accession")


# ---- HTML and text ---------------------------------------------------------------------------

#: Tags of the pages put in the place of machine tags.
_MACHINE = (("<title", "<ix:header"), ("</title>", "</ix:header>"), ("<h1", "<ix:hidden"), ("</h1>", "</ix:hidden>"), ("<p", "<ix:nonFraction"), ("</p>", "</ix:nonFraction>"), ("<a ", "<xbrli:unit "), ("</a>", "</xbrli:unit>"))


def _machine_sql() -> str:
    out = "html"
    for a, b in _MACHINE:
        out = f"replace({out}, '{a}', '{b}')"
    return out


@query(rf"""select page_id, len(regexp_extract_all(tagged, '(?i)<ix:nonfraction\b')) as figures, regexp_replace(regexp_replace(regexp_replace(regexp_replace(tagged, '(?is)<ix:header\b.*?</ix:header>', ' ', 'g'), '(?is)<ix:hidden\b.*?</ix:hidden>', ' ', 'g'),
'</?ix:[a-zA-Z]+\b[^>]*>', '', 'g'), '</?(xbrli|xbrldi|link|xlink|iso4217|xbrl):[a-zA-Z]+\b[^>]*>', '', 'g') as body from (select page_id, {_machine_sql()} as tagged from pages)""")
def html_strip(spark, d):
    tagged = F.col("html")
    for a, b in _MACHINE:
        tagged = F.replace(tagged, F.lit(a), F.lit(b))
    return t(spark, d, "pages").select("page_id", tagged.alias("tagged")).select("page_id", html.tagged_figures(F.col("tagged")).alias("figures"), html.strip_markup(F.col("tagged")).alias("body"))


@query(r"""select page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) as title, cast(len(regexp_extract_all(html, '<p[ >]')) as bigint) as n_paragraphs,
cast(len(regexp_extract_all(html, '<a ')) as bigint) as n_links from pages""")
def html_title_counts(spark, d):
    count = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return t(spark, d, "pages").select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), count("<p[ >]").alias("n_paragraphs"), count("<a ").alias("n_links"))


@query("""select doc_id, cast(pos - 1 as int) as pos, line from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents) where line <> ''""")
def nested_lines_explode(spark, d):
    return t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("line <> ''")


@query(r"""with v as (select doc_id, list_filter(list_transform(regexp_extract_all(text, '[0-9][0-9,]*(?:\.[0-9]+)?'), lambda f: try_cast(replace(f, ',', '') as double)), lambda x: x is not null) as v from documents)
select doc_id, cast(len(v) as bigint) as n_figures, list_reduce(list_prepend(cast(0 as double), v), lambda a, b: a + b) as total from v""")
def figures_in_text(spark, d):
    """Every figure of every text, added up in printed order, so that both engines add the same numbers."""
    v = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0)), figures.parse_figure), lambda x: x.isNotNull())
    return t(spark, d, "documents").select("doc_id", F.size(v).cast("long").alias("n_figures"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("""select l_orderkey, l_linenumber, case (l_orderkey + l_linenumber) % 9 when 0 then p when 1 then -p when 2 then p when 3 then -p when 4 then p when 5 then -p when 8 then p end as figure
from (select l_orderkey, l_linenumber, round(l_extendedprice, 2) as p from lineitem)""")
def parse_figure_literals(spark, d):
    """Prices printed as filings print figures: with commas, in parentheses, behind a dollar sign; a percentage and an empty cell are none."""
    p, shape = F.format_number("l_extendedprice", 2), (F.col("l_orderkey") + F.col("l_linenumber")) % 9
    bare = F.replace(p, F.lit(","), F.lit(""))
    printed = [p, F.concat(F.lit("("), p, F.lit(")")), F.concat(F.lit("$ "), p), F.concat(F.lit("-"), bare), F.concat(F.lit("(-"), p, F.lit(")")), F.concat(F.lit("($"), p, F.lit(")")), F.concat(p, F.lit("%")), F.lit(""), F.concat(F.lit(" \u00a0"), p, F.lit("  "))]
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", figures.parse_figure(F.get(F.array(*printed), shape.cast("int"))).alias("figure"))


#: What a caption says, and the scale that it means (0: the table's own cells decide); titles and their statements.
_CAPTIONS = (("(In millions, except share data)", 1_000_000), ("(in thousands)", 1_000), ("shares in thousands, dollars in millions", 1_000_000), ("no scale", 0), ("$ in billions of euros", 1_000_000_000), ("Shares in Thousands", 0))
_TITLES = (("CONSOLIDATED STATEMENTS OF\nINCOME", "income_statement"), ("Consolidated  Balance Sheets", "balance_sheet"), ("consolidated statements of cash flows", "cash_flow"), ("Notes", None))
_CELLS = (("Thousands", 1_000), ("of the year", 1), ("in million", 1_000_000))


def _cases(pairs, of: str) -> str:
    return f"case {of} " + " ".join(f"when {k} then {v!r}" if isinstance(v, str) else f"when {k} then {v}" for k, (_, v) in enumerate(pairs) if v is not None) + " end"


@query(f"""select cast(page_id as varchar) as doc_id, cast(case when {_cases(_CAPTIONS, "page_id % 6")} > 0 then {_cases(_CAPTIONS, "page_id % 6")} else {_cases(_CELLS, "page_id // 6 % 3")} end as bigint) as scale,
{_cases(_TITLES, "page_id // 18 % 4")} as statement, cast(2 as int) as n_rows from pages""")
def scale_detect(spark, d):
    """Scale and statement of a table that stands behind each page's own markup, prepared as any page is."""
    pick = lambda pairs, of: F.get(F.array(*[F.lit(x) for x, _ in pairs]), of.cast("int"))
    k = F.col("page_id")
    caption, title, cell = pick(_CAPTIONS, k % 6), pick(_TITLES, F.floor(k / 18) % 4), pick(_CELLS, F.floor(k / 6) % 3)
    made = F.concat(F.col("html"), F.lit("<div>"), title, F.lit("</div>\n<p>"), caption, F.lit("</p><table><tr><td>"), cell, F.lit("</td><td>1996</td></tr><tr><td>Total</td><td>7</td></table>"))
    found = html.prepare(t(spark, d, "pages").select("page_id", made.alias("made")), "page_id", "made").select("doc_id", F.element_at("tables", -1).alias("t"))
    return found.select("doc_id", "t.scale", "t.statement", F.size("t.rows").alias("n_rows"))


@query("""with y as (select o_custkey, list(distinct cast(year(o_orderdate) as int) order by cast(year(o_orderdate) as int) desc) as years, max(o_orderkey) as k from orders group by o_custkey),
p as (select *, cast(1993 + k % 7 as int) as wanted from y)
select o_custkey, wanted, cast(case when list_contains(years, wanted) then list_position(years, wanted) - 1 when abs(years[1] - wanted) <= 1 then 0 end as int) as column_index,
case when list_contains(years, wanted) then 'header_year' when abs(years[1] - wanted) <= 1 then 'header_fiscal_year_label' else 'header_year_no_match' end as basis from p""")
def header_year_column(spark, d):
    y = t(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set(F.year("o_orderdate")), False).alias("years"), F.max("o_orderkey").alias("k"))
    wanted = (1993 + F.col("k") % 7).cast("int")
    c = headers.resolve_column(F.array().cast("array<string>"), F.col("years"), F.make_date(F.col("wanted"), F.lit(12), F.lit(31)))
    return y.withColumn("wanted", wanted).select("o_custkey", "wanted", c["index"].alias("column_index"), c["basis"].alias("basis"))


_ORDERED = ("^economy .*steel", "^(large|medium) ", ".*brass$", "^standard", ".*plated")
_VETO = (".*copper.*", "^small burnished")


@query("select p_partkey, p_type, cast(case when " + " or ".join(f"regexp_matches(lower(p_type), '^(?:{p})')" for p in _VETO) + " then null " + " ".join(f"when regexp_matches(lower(p_type), '^(?:{p})') then {k}" for k, p in enumerate(_ORDERED)) + " end as int) as priority from part")
def label_priority(spark, d):
    label = F.lower("p_type")
    return t(spark, d, "part").select("p_partkey", "p_type", F.when(~matches_any(label, _VETO), first_match(label, _ORDERED)).alias("priority"))


@query("select p_partkey, cast(dense_rank() over (order by lower(p_type)) - 1 as int) as priority from part")
def pattern_index(spark, d):
    """Every type of part is a pattern; labels are types with their brands. Types are as many as the trade knows, not as parts."""
    part = t(spark, d, "part").select("p_partkey", F.lower(F.concat_ws(" ", "p_type", "p_brand")).alias("label"))
    kinds = tuple(sorted(r.k for r in t(spark, d, "part").select(F.lower("p_type").alias("k")).distinct().collect()))
    return patterns.first_matches(part, "label", tuple(f"^{k} .*$" for k in kinds)).select("p_partkey", "priority")


@query("""select cast(page_id as bigint) as page_id, cast(r as int) as row_index, cast(c as int) as cell_index, case when r = 0 then case when c = 0 then 'page' else 'letters' end when c = 0 then cast(page_id as varchar) else cast(length(html) as varchar) end as cell
from pages cross join range(2) x(r) cross join range(2) y(c)""")
def page_cells(spark, d):
    """The table function in SQL, over pages with a table behind their own markup."""
    sql.register(spark)
    cell = lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))
    rows = [F.lit("<table><tr><td>page</td><th>letters</th></tr><tr>"), cell(F.col("page_id").cast("string")), cell(F.length("html").cast("string")), F.lit("</tr></table>")]
    t(spark, d, "pages").select("page_id", F.concat("html", *rows).alias("made")).createOrReplaceTempView("made_pages")
    return spark.sql("select page_id, row_index, cell_index, cell from page_cells(table(made_pages), 'page_id', 'made')")


# ---- labels from facts -----------------------------------------------------------------------

_FACT_FIELDS = [
    Field("first", "", "", "instant", concepts=("RF", "AF")),
    Field("second", "", "", "instant", concepts=("NO", "RF", "NF")),
    Field("third", "", "", "duration", concepts=("NO", "AF")),
]


def _filings(spark, d):
    o = t(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("doc_id"), F.col("o_custkey").alias("cik"), F.col("o_orderpriority").alias("company"), F.col("o_orderstatus").alias("ticker"),
        F.to_date("o_orderdate").alias("report_date"), F.to_date("o_orderdate").alias("filing_date"), F.col("o_orderkey").cast("string").alias("accession"),
    )


def _facts(spark, d):
    """Line items as facts of their order: even lines end at the order's date, every third line starts some time before its end."""
    j = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    end = F.when(F.col("l_linenumber") % 2 == 0, F.to_date("o_orderdate")).otherwise(F.to_date("l_shipdate"))
    days = (250 + (F.col("l_partkey") % 200)).cast("int")
    return j.select(
        F.col("o_custkey").alias("cik"), F.concat("l_returnflag", "l_linestatus").alias("concept"), F.lit("USD").alias("unit"),
        F.when(F.col("l_linenumber") % 4 != 2, F.date_sub(end, days)).alias("start"), end.alias("end"), F.col("l_quantity").alias("val"), F.col("l_orderkey").cast("string").alias("accn"),
        F.lit("10-K").alias("form"), F.col("l_linenumber").cast("long").alias("ordinal"),
    )


_FACTS_SQL = """with filings as (select cast(o_orderkey as varchar) as doc_id, o_custkey as cik, cast(o_orderdate as date) as report_date from orders),
f0 as (select o_custkey as cik, l_returnflag || l_linestatus as concept, case when l_linenumber % 2 = 0 then cast(o_orderdate as date) else cast(l_shipdate as date) end as e,
l_linenumber, l_partkey, l_quantity as val, cast(l_orderkey as varchar) as accn from lineitem join orders on l_orderkey = o_orderkey),
facts as (select *, case when l_linenumber % 4 <> 2 then e - cast(250 + l_partkey % 200 as int) end as s from f0),
concepts(field, duration, position, concept) as (values ('first', false, 0, 'RF'), ('first', false, 1, 'AF'), ('second', false, 0, 'NO'), ('second', false, 1, 'RF'), ('second', false, 2, 'NF'), ('third', true, 0, 'NO'), ('third', true, 1, 'AF')),
m as (select doc_id, field, position, concept, duration, val, l_linenumber, accn = doc_id as same, accn = doc_id and e = report_date as ends, s is null as open, coalesce(e - s between 300 and 400, false) as yearly
from filings join facts using (cik) join concepts using (concept)),
g as (select doc_id, field, position, concept, duration, count(*) filter (same) as n_same, count(*) filter (ends) as n_ends, count(*) filter (ends and yearly) as n_year, count(*) filter (ends and open) as n_open,
count(distinct round(val, 6)) filter (ends and yearly) as d_year, count(distinct round(val, 6)) filter (ends and open) as d_open, count(distinct round(val, 6)) filter (ends) as d_ends,
arg_min(val, l_linenumber) filter (ends and yearly) as v_year, arg_min(val, l_linenumber) filter (ends and open) as v_open, arg_min(val, l_linenumber) filter (ends) as v_ends from m group by all),
r as (select *, case when n_same = 0 then 'no_fact_in_filing' when n_ends = 0 then 'no_period_end_match' when duration and n_year = 0 then 'no_annual_duration'
when (case when duration then d_year when n_open > 0 then d_open else d_ends end) > 1 then 'conflicting_values' else 'ok' end as reason, case when duration then v_year when n_open > 0 then v_open else v_ends end as v from g),
b as (select doc_id, field, arg_min(concept, position) filter (reason = 'ok') as concept, arg_min(v, position) filter (reason = 'ok') as v, arg_min(reason, position) as reason from r group by 1, 2),
cells as (select doc_id, fields.field, concept, v, coalesce(reason, 'no_concept_present') as reason from filings cross join (values ('first'), ('second'), ('third')) fields(field) left join b using (doc_id, field))
"""


@query(_FACTS_SQL + "select doc_id, field, concept, v as true_value from cells where v is not null")
def ordered_concept_first_match(spark, d):
    return labels.build_labels(_filings(spark, d), _facts(spark, d), _FACT_FIELDS)[0].select("doc_id", "field", "concept", "true_value")


@query(_FACTS_SQL + "select reason, count(*) as cells from cells where v is null group by reason")
def fact_miss_reasons(spark, d):
    return labels.miss_reasons(labels.build_labels(_filings(spark, d), _facts(spark, d), _FACT_FIELDS)[1])


@query(_FACTS_SQL + "select field, concept, count(*) as filings, round_even(count(*) / sum(count(*)) over (partition by field), 4) as share from cells where v is not null group by field, concept")
def concept_match_share(spark, d):
    return labels.concept_match_counts(labels.build_labels(_filings(spark, d), _facts(spark, d), _FACT_FIELDS)[0])


@query(_FACTS_SQL + "select doc_id, count(v) as fields_found, count(v) = 3 as complete from cells group by doc_id")
def label_coverage(spark, d):
    return labels.build_labels(_filings(spark, d), _facts(spark, d), _FACT_FIELDS)[2].select("doc_id", "fields_found", "complete")


@query(_FACTS_SQL + "select distinct cik, field, e as period_end, val as value from facts join concepts using (concept) where case when duration then yearly else open end".replace("yearly", "coalesce(e - s between 300 and 400, false)").replace("open", "s is null"))
def all_period_distinct(spark, d):
    return labels.all_period_values(_facts(spark, d), _FACT_FIELDS)


@query("""select l_orderkey, l_linenumber, date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) as days from lineitem join orders on l_orderkey = o_orderkey
where date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) between 30 and 90""")
def annual_duration(spark, d):
    j = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.datediff("l_shipdate", "o_orderdate").cast("long")
    return j.where(days.between(30, 90)).select("l_orderkey", "l_linenumber", days.alias("days"))


@query("select c_custkey, coalesce(n, 0) as fields_found, coalesce(n, 0) >= 10 as complete from customer left join (select o_custkey, count(*) as n from orders group by 1) on c_custkey = o_custkey")
def coverage(spark, d):
    n = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("fields_found"))
    out = t(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").fillna(0, ["fields_found"])
    return out.withColumn("complete", F.col("fields_found") >= 10)


@query("select user_id % 10 as bucket, event_type, count(*) as n, round_even(count(*) / sum(count(*)) over (partition by user_id % 10), 4) as share from events group by 1, 2")
def match_share(spark, d):
    return stats.with_share(t(spark, d, "events").groupBy((F.col("user_id") % 10).alias("bucket"), "event_type").agg(F.count("*").alias("n")), "n", ["bucket"])


# ---- predictions over documents: scoring, routing, statistics --------------------------------


def _agree(p: str, v: str) -> str:
    return f"(case when {v} = 0 then abs({p}) <= 0.005 else abs({p} - {v}) / abs({v}) <= 0.005 end)"


def _scaled(p: str, v: str) -> str:
    near = " or ".join(f"abs({p} / {v} - 1e{k}) <= 0.005 * greatest(abs({p} / {v}), 1e{k})" for k in scoring.POWERS)
    return f"({p} <> 0 and {v} <> 0 and ({near}))"


_GIVEN = """cells as (select doc_id, field, cast(v as double) as true_value, cast(substr(source, 4) as bigint) as cik, date '2024-01-01' + cast(doc_id % 5 as int) as report_date
from (select doc_id, 'quality' as field, quality as v from labels union all select doc_id, 'toxic', toxic from labels) join documents using (doc_id)),
periods as (select distinct cast(substr(source, 4) as bigint) as cik, field, date '2024-01-01' + cast(doc_id % 5 as int) as period_end, cast(2 + doc_id % 3 as double) as value from documents cross join (values ('quality'), ('toxic')) f(field)),
rules as (select doc_id, field, cast(null as varchar) as run_label, cast(case when n_chars % 7 = 6 then null when n_chars % 7 = 5 then 3.0 when n_chars % 7 = 4 then 10.0 when n_chars % 7 = 3 then 0.0 when n_chars % 7 = 2 then 0.4 else 1.0 end as double) as predicted,
case when n_chars % 7 <> 6 then 'ok' when n_chars % 2 = 0 then 'row_not_found' else 'no_value_in_row' end as status, cast(n_chars % 4 as double) / 4 as seconds, cast(0 as double) as input_tokens, cast(0 as double) as output_tokens, cast(0 as double) as usd
from documents cross join (values ('quality'), ('toxic')) f(field)),
model as (select doc_id, field, 'run' || k as run_label, case when (doc_id + k) % 11 = 0 then null else cast((doc_id + k) % 3 as double) end as predicted, case when (doc_id + k) % 11 = 0 then 'llm_no_answer' else 'ok' end as status,
cast(doc_id % 8 as double) / 8 + k as seconds, cast(n_chars as double) as input_tokens, cast(doc_id % 16 as double) as output_tokens, cast(n_chars as double) / 1024 as usd
from documents cross join (values ('quality'), ('toxic')) f(field) cross join (values (1), (2), (3)) r(k))"""


def _scored(source: str, method: str) -> str:
    """Scored cells from a table of predictions, as a CTE named `scored`."""
    return f"""others as (select cik, field, period_end, value from periods),
joined as (select c.*, p.run_label, p.predicted, coalesce(p.status, 'not_attempted') as status, p.seconds, p.input_tokens, p.output_tokens, p.usd from cells c left join {source} p using (doc_id, field)),
past as (select distinct j.cik, j.field, j.report_date, j.predicted from joined j join others o on j.cik = o.cik and j.field = o.field and o.period_end <> j.report_date where j.predicted is not null and {_agree("j.predicted", "o.value")}),
scored as (select j.*, '{method}' as method, case when j.predicted is null then case when status in ('no_value_in_row', 'unparseable_response') then 'parse_error' else 'not_found' end
when {_agree("j.predicted", "true_value")} then 'correct' when {_scaled("j.predicted", "true_value")} then 'scaling_error' when past.predicted is not null then 'wrong_period' else 'wrong_row' end as outcome
from joined j left join past on j.cik = past.cik and j.field = past.field and j.report_date = past.report_date and j.predicted = past.predicted)"""


_HYBRID = """abst as (select *, predicted is null or status in ('statement_not_found', 'row_not_found', 'column_unresolved', 'no_value_in_row', 'not_attempted') as gap from rules),
runs as (select distinct run_label from model),
filled as (select m.doc_id, m.field, m.run_label, m.predicted, m.status, m.seconds + a.seconds as seconds, m.input_tokens + a.input_tokens as input_tokens, m.output_tokens + a.output_tokens as output_tokens, m.usd + a.usd as usd
from model m join abst a on m.doc_id = a.doc_id and m.field = a.field and a.gap),
hybrid as (select a.doc_id, a.field, r.run_label, a.predicted, a.status, a.seconds, a.input_tokens, a.output_tokens, a.usd from abst a cross join runs r where not gap union all select * from filled
union all select a.doc_id, a.field, r.run_label, a.predicted, a.status, a.seconds, a.input_tokens, a.output_tokens, a.usd from abst a cross join runs r where gap and not exists (select 1 from filled f where f.doc_id = a.doc_id and f.field = a.field and f.run_label = r.run_label))"""


def _fields(spark):
    return F.broadcast(spark.createDataFrame([("quality",), ("toxic",)], "field string"))


def _documents(spark, d):
    """Without the text, which none of these queries reads."""
    return t(spark, d, "documents").select("doc_id", "lang", "n_chars", F.substring("source", 4, 9).cast("bigint").alias("cik"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 5).cast("int")).alias("report_date"))


def truth_cells(spark, d):
    long = t(spark, d, "labels").unpivot("doc_id", ["quality", "toxic"], "field", "v")
    return long.join(_documents(spark, d), "doc_id").select("doc_id", "field", F.col("v").cast("double").alias("true_value"), "cik", "report_date", F.lit("USD").alias("unit"))


def period_values(spark, d):
    return _documents(spark, d).crossJoin(_fields(spark)).select("cik", "field", F.col("report_date").alias("period_end"), (2 + F.col("doc_id") % 3).cast("double").alias("value")).distinct()


def rules_predictions(spark, d):
    r = F.col("n_chars") % 7
    value = F.when(r == 6, None).when(r == 5, 3.0).when(r == 4, 10.0).when(r == 3, 0.0).when(r == 2, 0.4).otherwise(1.0)
    status = F.when(r != 6, "ok").when(F.col("n_chars") % 2 == 0, "row_not_found").otherwise("no_value_in_row")
    zero = F.lit(0.0)
    return _documents(spark, d).crossJoin(_fields(spark)).select(
        "doc_id", "field", F.lit("rules").alias("method"), F.lit(None).cast("string").alias("run_label"), value.alias("predicted"), status.alias("status"), ((F.col("n_chars") % 4) / 4.0).alias("seconds"),
        zero.alias("input_tokens"), zero.alias("output_tokens"), zero.alias("usd"),
    )


def model_predictions(spark, d):
    runs = F.broadcast(spark.createDataFrame([(1,), (2,), (3,)], "k int"))
    gone = (F.col("doc_id") + F.col("k")) % 11 == 0
    return _documents(spark, d).crossJoin(_fields(spark)).crossJoin(runs).select(
        "doc_id", "field", F.lit("llm").alias("method"), F.concat(F.lit("run"), "k").alias("run_label"), F.when(~gone, ((F.col("doc_id") + F.col("k")) % 3).cast("double")).alias("predicted"),
        F.when(gone, "llm_no_answer").otherwise("ok").alias("status"), ((F.col("doc_id") % 8) / 8.0 + F.col("k")).alias("seconds"), F.col("n_chars").cast("double").alias("input_tokens"),
        (F.col("doc_id") % 16).cast("double").alias("output_tokens"), (F.col("n_chars") / 1024.0).alias("usd"),
    )


def _score(spark, d, which):
    p = {"rules": rules_predictions, "llm": model_predictions, "hybrid": lambda s, x: hybrid.combine(rules_predictions(s, x), model_predictions(s, x))}[which](spark, d)
    return score.score(p, truth_cells(spark, d), period_values(spark, d), which)


@query(f"with {_GIVEN}, {_scored('rules', 'rules')} select doc_id, field, predicted, status, true_value, outcome, outcome = 'correct' as correct from scored")
def left_outer_score(spark, d):
    return _score(spark, d, "rules").select("doc_id", "field", "predicted", "status", "true_value", "outcome", "correct")


@query(f"with {_GIVEN}, answered as (select * from rules where status = 'ok') select c.doc_id, c.field, 'rules' as method, coalesce(status, 'not_attempted') as status from cells c left join answered using (doc_id, field)")
def fill_method(spark, d):
    """Cells without a prediction get the method's name and a status of their own."""
    return score.score(rules_predictions(spark, d).where("status = 'ok'"), truth_cells(spark, d), period_values(spark, d), "rules").select("doc_id", "field", "method", "status")


@query(f"with {_GIVEN}, {_scored('model', 'llm')} select method, field, outcome, count(*) as cells, round_even(count(*) / sum(count(*)) over (partition by method, field), 4) as share from scored group by 1, 2, 3")
def classify_outcomes(spark, d):
    return stats.failure_breakdown(_score(spark, d, "llm"))


_HYBRID_CELLS = "doc_id, field, run_label, predicted, status, seconds, input_tokens, output_tokens, usd"


@query(f"with {_GIVEN}, {_HYBRID} select {_HYBRID_CELLS} from hybrid")
def hybrid_combine(spark, d):
    return hybrid.combine(rules_predictions(spark, d), model_predictions(spark, d)).select(*_HYBRID_CELLS.split(", "))


@query(f"with {_GIVEN}, {_HYBRID}, once as (select {_HYBRID_CELLS} from abst where not gap union all select {_HYBRID_CELLS} from filled union all select {_HYBRID_CELLS} from abst a where gap and not exists (select 1 from filled f where f.doc_id = a.doc_id and f.field = a.field)) select run_label, count(*) as cells, count(predicted) as answered from once group by run_label")
def hybrid_combine_pooled(spark, d):
    out = hybrid.combine(rules_predictions(spark, d), model_predictions(spark, d), whole_runs=False)
    return out.groupBy("run_label").agg(F.count("*").alias("cells"), F.count("predicted").alias("answered"))


@query(f"with {_GIVEN}, {_HYBRID} select doc_id, string_agg(field, ',' order by field) as fields from abst where gap group by doc_id")
def gaps_per_document(spark, d):
    return hybrid.gaps(rules_predictions(spark, d)).select("doc_id", F.array_join("fields", ",").alias("fields"))


_WILSON = """count(*) as n, sum(c) as correct, sum(c) / count(*) as accuracy"""


def _wilson_sql(rows: str, by: str, n: str = "n") -> str:
    low = f"(p + 3.8416 / (2 * {n}) {{s}} 1.96 * sqrt(p * (1 - p) / {n} + 3.8416 / (4 * {n} * {n}))) / (1 + 3.8416 / {n})"
    return f"""select {by}, {n}, correct, round(p, 9) as accuracy, round(greatest(0, {low.format(s='-')}), 9) as ci_low, round(least(1, {low.format(s='+')}), 9) as ci_high
from (select {by}, count(*) as {n}, count(*) filter (correct) as correct, count(*) filter (correct) / count(*) as p from {rows} group by {by})"""


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, 9) for c in names})


@query(f"with {_GIVEN}, {_scored('rules', 'rules')}, s as (select s.*, outcome = 'correct' as correct, lang from scored s join documents using (doc_id)) " + _wilson_sql("s", "lang, field"))
def wilson_by_group(spark, d):
    s = _score(spark, d, "rules").join(_documents(spark, d).select("doc_id", "lang"), "doc_id")
    return _rounded(stats.accuracy(s, "lang", "field"), "accuracy", "ci_low", "ci_high")


def _all_methods(spark, d):
    rules, answers = rules_predictions(spark, d), model_predictions(spark, d)
    return report.evaluate(rules, answers, truth_cells(spark, d), period_values(spark, d), group_holdout_table(spark, d))


def _union_scored() -> str:
    parts = []
    for source, method in (("rules", "rules"), ("model", "llm"), ("hybrid", "hybrid")):
        cte = _scored(source, method)
        for name in ("others", "joined", "past", "scored"):
            cte = cte.replace(f"{name} as (", f"{name}_{method} as (").replace(f" {name} j ", f" {name}_{method} j ").replace(f" {name} o ", f" {name}_{method} o ")
        cte = cte.replace("left join past on", f"left join past_{method} past on")
        parts.append(cte)
    union = " union all ".join(f"select doc_id, cik, field, run_label, method, outcome, outcome = 'correct' as correct, seconds, input_tokens, usd from scored_{m}" for m in stats.METHODS)
    return f"{_GIVEN}, {_HYBRID}, {', '.join(parts)}, every_method as ({union})"


_HOLDOUT = "holdout as (select cik, case when k <= 8 then 'dev' else 'test' end as split from (select cik, row_number() over (order by case when cik = 3 then 0 else 1 end, cik * 7919 % 101, cik) as k from (select distinct cast(substr(source, 4) as bigint) as cik from documents)))"
_ALL = f"with {_union_scored()}, {_HOLDOUT}, s as (select * from every_method left join holdout using (cik))"


def group_holdout_table(spark, d):
    """Sources into eight of dev and the rest; an arithmetic order in place of the library's hash, so that SQL can follow."""
    return split.group_split(_documents(spark, d), "cik", 0, 8, pinned=(3,), order=F.col("cik") * 7919 % 101)


@query(f"with {_HOLDOUT} select split, count(*) as documents, count(distinct cik) as sources from documents join holdout on cast(substr(source, 4) as bigint) = cik group by split")
def group_holdout(spark, d):
    docs = split.attach_split(_documents(spark, d), group_holdout_table(spark, d), "cik")
    return docs.groupBy("split").agg(F.count("*").alias("documents"), F.count_distinct("cik").alias("sources"))


@query(f"{_ALL} " + _wilson_sql("s", "method", "cells"))
def overall_accuracy(spark, d):
    return _rounded(stats.accuracy(_all_methods(spark, d), "method", n="cells"), "accuracy", "ci_low", "ci_high")


@query(f"{_ALL} select method, split, count(*) as cells, round(avg(correct::int), 9) as accuracy from s group by grouping sets ((method, split), (method))")
def grouping_sets_summary(spark, d):
    return _rounded(stats.split_summary(_all_methods(spark, d)), "accuracy")


@query(f"{_ALL} select method, " + ", ".join(f"round(count(*) filter (outcome = '{o}') / count(*), 9) as {o}" for o in scoring.OUTCOMES) + " from s group by method")
def outcome_pivot(spark, d):
    return _rounded(stats.outcome_mix(_all_methods(spark, d)), *scoring.OUTCOMES)


@query(f"""{_ALL}, l as (select method, sum(seconds) as seconds from s group by method),
b as (select method, count(distinct doc_id) as filings, count(*) as cells, count(*) filter (correct) as correct, count(*) filter (outcome <> 'not_found') as answered, sum(usd) as usd, coalesce(sum(input_tokens), 0) as tokens from s group by method)
select method, filings, cells, correct, round(answered / cells, 9) as answer_rate, round(correct / answered, 9) as precision_when_answering, round(seconds / filings, 9) as seconds_per_filing,
round(case when usd > 0 then usd / filings end, 9) as usd_per_filing, round(case when usd > 0 then usd / correct end, 9) as usd_per_correct_field, round(tokens / filings, 9) as input_tokens_per_filing from b join l using (method)""")
def cost_summary(spark, d):
    s = _all_methods(spark, d)
    names = ("answer_rate", "precision_when_answering", "seconds_per_filing", "usd_per_filing", "usd_per_correct_field", "input_tokens_per_filing")
    return _rounded(stats.cost_summary(s, s.select("method", "seconds")), *names).select("method", "filings", "cells", "correct", *names)


@query(f"""{_ALL}, r as (select method, run_label, count(*) as cells, avg(correct::int) as a from s where run_label is not null group by 1, 2)
select method, run_label, cells, round(a, 9) as accuracy, round(min(a) over w, 9) as min, round(max(a) over w, 9) as max, round(avg(a) over w, 9) as mean, round(stddev_samp(a) over w, 9) as std, round(max(a) over w - min(a) over w, 9) as spread
from r window w as (partition by method)""")
def run_variation(spark, d):
    return _rounded(stats.run_variation(_all_methods(spark, d)), "accuracy", "min", "max", "mean", "std", "spread")


@query(f"""{_ALL}, w as (select *, row_number() over (partition by method, outcome order by doc_id * 7919 % 10007, doc_id, field, run_label nulls first) as k from s where not correct)
select method, outcome, doc_id, field, run_label from w where k <= 4""")
def stratified_sample(spark, d):
    """The four of each method and outcome that a report shows; by an arithmetic order in place of the hash."""
    wrong = _all_methods(spark, d).where("not correct")
    return split.sample_per_group(wrong, ["method", "outcome"], 4, 0, ["doc_id", "field", "run_label"], order=F.col("doc_id") * 7919 % 10007).select("method", "outcome", "doc_id", "field", "run_label")


_PRICES = "rates(model, rate_in, rate_out) as (values ('click', 0.5, 2.0), ('view', 0.25, 1.0), ('error', null, 1.0))"


@query(f"""with {_PRICES} select event_id, event_type, cast(json_extract(props, '$.k') as double) as input_tokens, cast(json_extract(props, '$.k') as double) / 1e6 * rate_in + user_id / 1e6 * rate_out as usd
from events left join rates on event_type = model""")
def price_lookup(spark, d):
    rates = readers.pricing(spark, {"click": (0.5, 2.0), "view": (0.25, 1.0), "error": (None, 1.0)})
    e = t(spark, d, "events").withColumn("model", F.col("event_type")).join(rates, "model", "left").withColumn("input_tokens", F.get_json_object("props", "$.k").cast("double"))
    cost = model.usd(F.col("input_tokens"), F.col("user_id").cast("double"), F.col("usd_per_million_input"), F.col("usd_per_million_output"))
    return e.select("event_id", "event_type", "input_tokens", cost.alias("usd"))


@query("""select l_orderkey, l_linenumber, exists (select 1 from lineitem o where o.l_partkey = l.l_partkey and (o.l_orderkey <> l.l_orderkey) and abs(l.l_extendedprice - o.l_extendedprice) / o.l_extendedprice <= 0.005) as other_period from lineitem l""")
def wrong_period_exists(spark, d):
    line = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return nearby.with_other_periods(line, ["l_partkey"], "l_orderkey", {"other_period": ("l_extendedprice", F.lit("USD"))}).select("l_orderkey", "l_linenumber", "other_period")


@query(f"""with v as (select l_orderkey as o, l_linenumber as n, l_partkey as p, l_discount * l_tax * (case when l_linenumber % 3 = 0 then -1 else 1 end) as money, l_quantity % 5 / 100 as per_share from lineitem)
select o as l_orderkey, n as l_linenumber, exists (select 1 from v x where x.p = v.p and x.o <> v.o and {_agree("v.money", "x.money")}) as other_period,
exists (select 1 from v x where x.p = v.p and x.o <> v.o and (abs(v.per_share - x.per_share) <= 0.005 or {_agree("v.per_share", "x.per_share")})) as other_share from v""")
def wrong_period_near_zero(spark, d):
    """Zeros, values under the absolute tolerance and of either sign, and values per share."""
    line = t(spark, d, "lineitem")
    money = F.col("l_discount") * F.col("l_tax") * F.when(F.col("l_linenumber") % 3 == 0, -1).otherwise(1)
    rows = line.select("l_orderkey", "l_linenumber", "l_partkey", money.alias("money"), (F.col("l_quantity") % 5 / 100).alias("per_share"))
    checks = {"other_period": ("money", F.lit("USD")), "other_share": ("per_share", F.lit("USD/shares"))}
    return nearby.with_other_periods(rows, ["l_partkey"], "l_orderkey", checks).select("l_orderkey", "l_linenumber", "other_period", "other_share")


@query(f"""select l_orderkey, l_linenumber, {_scaled('(l_extendedprice * pow(10, l_partkey % 11 - 5))', '(l_extendedprice * (1 + l_discount / 20))')} as is_scaling_error from lineitem where l_extendedprice > 0""")
def scaling_error(spark, d):
    price = F.col("l_extendedprice")
    wrong = scoring.scaling_error(price * F.pow(F.lit(10.0), F.col("l_partkey") % 11 - 5), price * (1 + F.col("l_discount") / 20))
    return t(spark, d, "lineitem").where("l_extendedprice > 0").select("l_orderkey", "l_linenumber", wrong.alias("is_scaling_error"))


# ---- windows over rows, prompts, replies -----------------------------------------------------


@query("""select conv_id, turn, (select string_agg(x.role || ': ' || x.text, ' // ' order by x.turn) from conversations x where x.conv_id = c.conv_id and x.k between c.k - 2 and c.k + 2) as nearby
from (select *, row_number() over (partition by conv_id order by turn) as k from conversations) c""".replace("from conversations x", "from (select *, row_number() over (partition by conv_id order by turn) as k from conversations) x"))
def context_rows(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, 2)
    shown = F.collect_list(F.concat_ws(": ", "role", "text")).over(w)
    return t(spark, d, "conversations").select("conv_id", "turn", F.array_join(shown, " // ").alias("nearby"))


_TERMS = ("the", "de", "and", "er")


@query("""with s as (select doc_id, lower(text) as low, text, unnest(generate_series(0, greatest(length(text) - 400, 0), 200)) as start from documents),
c as (select doc_id, text, start, """ + " + ".join(f"(length(substr(low, start + 1, 400)) - length(replace(substr(low, start + 1, 400), '{w}', ''))) // {len(w)}" for w in _TERMS) + """ as score from s)
select doc_id, arg_max(substr(text, cast(start + 1 as bigint), 400), score * 1000000 - start) as excerpt from c group by doc_id""")
def densest_window(spark, d):
    return t(spark, d, "documents").select("doc_id", model.densest_window(F.col("text"), 400, 200, _TERMS).alias("excerpt"))


@query("""select conv_id, '[caption] ' || min(role) || chr(10) || string_agg(role || ' | ' || text, chr(10) order by turn) as prompt from conversations group by conv_id""")
def render_and_prompt(spark, d):
    rows = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("r"), F.min("role").alias("c"))
    table = F.transform("r", lambda x: F.array(x["role"], x["text"]))
    return rows.select("conv_id", model.render_table(F.col("c"), table).alias("prompt"))


#: Replies around an event's properties: plain, in prose, with other fields, or no object at all.
_REPLY_SQL = """case event_id % 7 when 0 then props when 1 then 'The answer: ' || props || ' as asked' when 2 then '[1, 2]' when 3 then '{broken ' || props when 4 then '{"k": null, "b": "$1,0' || user_id % 90 + 10 || '.5"}' when 5 then '{"k": true, "b": "x"}' else '' end"""


@query(r"""with j as (select event_id, try_cast(nullif(regexp_extract(reply, '(?s)\{.*\}', 0), '') as json) as v from (select event_id, """ + _REPLY_SQL + r""" as reply from events)),
k as (select event_id, v, coalesce(json_type(v) = 'OBJECT', false) as ok from j),
f as (select event_id, ok, case when json_type(v, '$.k') <> 'BOOLEAN' then v ->> '$.k' end as k, case when json_type(v, '$.b') <> 'BOOLEAN' then v ->> '$.b' end as b from k)
select event_id, case when ok then 'ok' else 'unparseable_response' end as status, case when ok then try_cast(replace(replace(trim(k), ',', ''), '$', '') as double) end as k, case when ok then try_cast(replace(replace(trim(b), ',', ''), '$', '') as double) end as b from f""")
def parse_json_response(spark, d):
    p, user = F.col("props"), (F.col("user_id") % 90 + 10).cast("string")
    shapes = [p, F.concat(F.lit("The answer: "), p, F.lit(" as asked")), F.lit("[1, 2]"), F.concat(F.lit("{broken "), p), F.concat(F.lit('{"k": null, "b": "$1,0'), user, F.lit('.5"}')), F.lit('{"k": true, "b": "x"}'), F.lit("")]
    reply = F.get(F.array(*shapes), (F.col("event_id") % 7).cast("int"))
    return t(spark, d, "events").select("event_id", model.parse_reply(reply, ["k", "b"]).alias("p")).select("event_id", "p.status", "p.values.k", "p.values.b")


_ASKED = [Field("words", "Number of words", "", "instant"), Field("rate", "Rate", "", "instant", unit="USD/shares")]


def _asked_documents(spark, d):
    """Conversations as documents: their turns are the text, the first role is the company, the number the report date."""
    turns = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("r"))
    text = F.array_join(F.transform("r", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")
    company = F.when(F.col("conv_id") % 5 != 0, F.get("r", 0)["role"])
    return turns.select(F.col("conv_id").cast("string").alias("doc_id"), text.alias("text"), company.alias("company"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 300).cast("int")).alias("report_date"))


_ASKED_SQL = """with c as (select cast(conv_id as varchar) as doc_id, string_agg(role || ': ' || text, chr(10) order by turn) as text, case when conv_id % 5 <> 0 then arg_min(role, turn) end as company, date '2024-01-01' + cast(conv_id % 300 as int) as report_date from conversations group by conv_id),
w as (select doc_id, unnest(range(0, greatest(length(text) - 900, 0) + 1, 300)) as start, text from c),
s as (select doc_id, text, start, (select sum((length(x) - length(replace(x, v, ''))) // length(v)) from (values ('the'), ('ion')) t(v)) as score from (select *, lower(substr(text, start + 1, 900)) as x from w)),
b as (select doc_id, arg_max(substr(text, cast(start + 1 as bigint), 900), score * 1000000 - start) as context, any_value(length(text) > 900) as truncated from s group by doc_id)
"""


@query(_ASKED_SQL + """select doc_id, truncated, 'Annual report of ' || coalesce(company, 'an unnamed company') || ' for the period that ended on ' || strftime(report_date, '%Y-%m-%d') || '.
Read these values of that period from the report below:
- words: Number of words, in full units of money
- rate: Rate, per share as printed
Reply with a single JSON object that has those names as keys. A value that the report does not print is null.

=== report ===
' || context || '
=== end of report ===' as prompt from c join b using (doc_id)""")
def user_prompt(spark, d):
    """What a model is asked for each document, its text cut to the densest 900 letters."""
    docs = _asked_documents(spark, d)
    found = model.contexts(docs.select("doc_id", "text"), model.Settings(char_budget=900), stride=300, vocabulary=("the", "ion"))
    return docs.join(found, "doc_id").select("doc_id", "truncated", model.prompt(F.col("company"), F.col("report_date"), F.col("context"), _ASKED).alias("prompt"))


def _counting():
    """A provider that reads the report: it answers with the number of its words, and the share of them that are long."""

    class Counting:
        def complete(self, system, user, max_tokens, temperature):
            words = user.split("=== report ===\n")[1].split("\n=== end of report ===")[0].split()
            if len(words) % 10 == 0:
                raise model.Failed(400)
            answer = json.dumps({"words": f"{len(words):,}", "rate": None if len(words) % 3 == 0 else len(words) / 8})
            return f"Here it is: {answer}", len(words), 2

    return Counting()


@query(r"""with c as (select cast(conv_id as varchar) as doc_id, string_agg(role || ': ' || text, chr(10) order by turn) as text from conversations group by conv_id),
n as (select doc_id, len(regexp_extract_all(text, '[^\s]+')) as n from c)
select doc_id, field, run_label, case when n % 10 = 0 then null when field = 'words' then cast(n as double) when n % 3 <> 0 then n / 8 end as predicted,
case when n % 10 = 0 then 'llm_error' when field = 'rate' and n % 3 = 0 then 'llm_no_answer' else 'ok' end as status, case when n % 10 <> 0 then n / 2 end as input_tokens, case when n % 10 <> 0 then (n / 1e6 * 3.0 + 2 / 1e6 * 5.0) / 2 end as usd
from n cross join (values ('words'), ('rate')) f(field) cross join (values ('run1'), ('run2')) r(run_label)""")
def model_stub(spark, d):
    """A model run whole: contexts, prompts, calls of two runs, replies, prices. The provider counts words, so that SQL can tell the answers."""
    docs = _asked_documents(spark, d)
    found = model.run_model(docs.select("doc_id", "text"), docs.drop("text"), _counting, readers.pricing(spark, {"stub": (3.0, 5.0)}), model.Settings(), runs=2, fields=_ASKED)
    return found.select("doc_id", "field", "run_label", "predicted", "status", "input_tokens", "usd")


_PARTS = ", ".join(f"cast(sum(cast('0x' || substr(h, {1 + 15 * k}, 15) as ubigint)) as varchar) as s{k}" for k in range(4))


@query(f"select event_type, count(*) as n, {_PARTS} from (select event_type, sha256(event_id || chr(31) || user_id || chr(31) || event_type) as h from events) group by event_type")
def digest_rows(spark, d):
    out = stats.digest_parts(t(spark, d, "events"), ["event_id", "user_id", "event_type"], "event_type")
    return out.select("event_type", "n", *[F.col(f"s{k}").cast("string").alias(f"s{k}") for k in range(4)])


@query("select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def event_windows(spark, d):
    w = ingest.event_windows(t(spark, d, "events"))
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""with g as (select user_id, ts, case when ts - lag(ts) over w < interval 30 minute then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, strftime(max(ts) + interval 30 minute, '%Y-%m-%d %H:%M:%S') as "end", count(*) as n from s group by user_id, k""")
def user_sessions(spark, d):
    s = ingest.user_sessions(t(spark, d, "events"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return s.select("user_id", day("start"), day("end"), "n")


@query()
def prepare_html(spark, d):
    return html.prepare(t(spark, d, "pages"), "page_id", "html").select("doc_id", "raw_chars", "stripped_chars", F.size("tables").alias("n_tables"), F.length("text").alias("n_text"))
