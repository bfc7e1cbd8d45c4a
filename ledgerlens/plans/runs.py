"""Queries of what surrounds a run: what was landed, parsed before, asked for and paid, and what its failures looked like."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators import extract, failures, model, score
from ..sources import readers, store
from . import statements
from .catalogue import _ASKED, _GIVEN, _asked_documents, _counting, _score, model_predictions
from .registry import ORACLES, query, t


@query(f"""with {_GIVEN}, total as (select doc_id, field, sum(usd) as pooled_usd from model group by all)
select c.doc_id, c.field, m.run_label, m.seconds, m.input_tokens, m.output_tokens, m.usd, pooled_usd from cells c left join model m using (doc_id, field) left join total using (doc_id, field)""")
def attached_costs(spark, d):
    """Scored cells with what they cost, by run, and with a cell's total in each of its runs."""
    names = ("seconds", "input_tokens", "output_tokens", "usd")
    costs = model_predictions(spark, d)
    one = score.attach_costs(_score(spark, d, "llm").drop(*names), costs)
    both = score.attach_costs(one.withColumnRenamed("usd", "run_usd"), costs, per_run=False)
    one_by_run = one.select("doc_id", "field", "run_label", *names)
    return one_by_run.join(both.select("doc_id", "field", "run_label", F.col("usd").alias("pooled_usd")), ["doc_id", "field", "run_label"], "left")


@query("""select cast(c_custkey as varchar) as doc_id, case when c_custkey % 5 = 0 then 'failed: missing' when c_custkey % 7 = 0 then 'failed: ambiguous' when c_custkey % 11 = 0 then 'failed: empty' when c_custkey % 13 = 0 then 'failed: not_html' else 'ok' end as doc_status,
cast(case when c_custkey % 5 = 0 or c_custkey % 11 = 0 and c_custkey % 7 <> 0 then 0 when c_custkey % 7 = 0 and c_custkey % 11 = 0 then 0 when c_custkey % 13 = 0 then strlen(c_name) else strlen(c_name) + 3 end as bigint) as doc_bytes from customer""")
def document_statuses(spark, d):
    """An index of customers against landed pages: some are missing, landed twice, empty or no HTML."""
    c = t(spark, d, "customer")
    k = F.col("c_custkey")
    page = F.when(k % 11 == 0, "").when(k % 13 == 0, F.col("c_name")).otherwise(F.concat(F.lit("<p>"), "c_name"))
    copies = F.when(k % 5 == 0, 0).when(k % 7 == 0, 2).otherwise(1)
    landed = c.select(k.cast("string").alias("doc_id"), page.alias("html"), F.explode(F.array_repeat(F.lit(1), copies)).alias("copy")).withColumn("doc_bytes", F.octet_length("html").cast("long"))
    return readers.document_status(c.select(k.cast("string").alias("doc_id")), landed).select("doc_id", "doc_status", "doc_bytes")


@query("""with l as (select o_custkey, max(o_orderkey) as k from orders group by o_custkey)
select cast(o_orderkey as varchar) as doc_id, substr(o_orderpriority, 1, 4) as text, cast(o_orderkey % 3 as int) as n_tables from orders join l on o_orderkey = k""")
def last_samples(spark, d):
    """The last filing of each ticker: its statement tables, and the beginning of its text."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.col("o_custkey").cast("string").alias("ticker"), F.date_add(F.lit("1970-01-01").cast("date"), F.col("o_orderkey").cast("int")).alias("report_date"), "o_orderpriority", "o_orderkey")
    named = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(i.alias("index"), F.when(i < F.col("o_orderkey") % 3, "balance_sheet").alias("statement")))
    made = o.select("doc_id", F.col("o_orderpriority").alias("text"), named.alias("tables"))
    return readers.cut_samples(made, o.select("doc_id", "ticker", "report_date"), 4).select("doc_id", "text", F.size("tables").alias("n_tables"))


@query(r"""with c as (select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) as text from conversations group by conv_id),
n as (select conv_id, len(regexp_extract_all(text, '[^\s]+')) as n from c where conv_id % 3 <> 2), f as (select *, unnest(case when conv_id % 3 = 0 then ['words'] else ['rate', 'words'] end) as field from n)
select cast(conv_id as varchar) as doc_id, field, case when n % 10 = 0 then null when field = 'words' then cast(n as double) when n % 3 <> 0 then n / 8 end as predicted,
case when n % 10 <> 0 then n / (case when conv_id % 3 = 0 then 1.0 else 2.0 end) end as input_tokens from f""")
def routed_asks(spark, d):
    """A model asked only for the cells that were left: documents without any are not called, a call's cost is shared by its fields."""
    docs = _asked_documents(spark, d)
    k = F.col("doc_id").cast("long") % 3
    only = docs.where(k != 2).select("doc_id", F.when(k == 0, F.array(F.lit("words"))).otherwise(F.array(F.lit("rate"), F.lit("words"))).alias("fields"))
    found = model.run_model(docs.select("doc_id", "text"), docs.drop("text"), _counting, readers.pricing(spark, {"stub": (3.0, 5.0)}), model.Settings(), only=only, fields=_ASKED)
    return found.select("doc_id", "field", "predicted", "input_tokens")


@query(f"""{statements._ROWS}, ans as ({ORACLES["extracted_answers"]}),
lab as (select idx, label, row_number() over (partition by idx order by o_orderkey) + 1 as pos from r union all select distinct idx, '1996', 1 from r),
found as (select doc_id, field, min(pos) as spot from ans join lab on idx = table_index and label = replace(matched_label, '[section] ', '') group by all)
select doc_id, field, table_index as statement_table, case when spot is not null then (select string_agg(label, ' // ' order by pos) from lab where idx = table_index and pos between spot - 2 and spot + 2)
else (select substr(string_agg(label, ' // ' order by pos), 1, 400) from lab where idx = table_index) end as nearby_rows from ans a left join found using (doc_id, field)""")
def failure_notes(spark, d):
    """The labels around the row that each answer was read from, or the table's first labels."""
    picked = extract.statement_tables(statements.printed_tables(spark, d))
    n = F.col("n_nationkey")
    periods = t(spark, d, "nation").select(n.cast("string").alias("doc_id"), F.make_date((1994 + n % 4).cast("int"), F.lit(12), F.lit(31)).alias("report_date"))
    answers = extract.read_fields(picked, periods, statements.FIELDS)
    return failures.annotate_from(answers, picked, statements.FIELDS).select("doc_id", "field", "statement_table", "nearby_rows")


@query("select cast(page_id as varchar) as doc_id, page_id % 2 = 0 as reused from pages")
def stored_pages(spark, d):
    """Pages prepared in two runs over one store: the second parses only what the first has not."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}"
    path = f"{shared.rstrip('/')}/prepared-{uuid.uuid4().hex}"
    pages = t(spark, d, "pages").select(F.col("page_id").cast("string").alias("doc_id"), "html")
    even = F.col("doc_id").cast("long") % 2 == 0
    store.prepare(pages.where(even), path)
    before = [r.batch for r in store.stored(spark, path, store.version()).select("batch").distinct().collect()]
    store.prepare(pages, path)
    return store.stored(spark, path, store.version()).select("doc_id", F.col("batch").isin(before).alias("reused"))
