"""The tables of the library, as DDL."""

TABLE = "struct<index:int,rows:array<array<string>>,preamble:string,statement:string,scale:bigint,scale_phrase:string>"
PREPARED = f"doc_id string, ix_facts_removed bigint, raw_chars bigint, stripped_chars bigint, text string, tables array<{TABLE}>"
SAMPLE = PREPARED + ", sample_meta struct<company:string,ticker:string,report_date:string,accession:string,doc_url:string>"
TRUTH = "doc_id string, cik bigint, company string, ticker string, report_date date, filing_date date, accession string, field string, concept string, unit string, true_value double"
FACTS = "cik bigint, concept string, unit string, start date, end date, val double, accn string, form string, fy int, fp string, ordinal bigint"
FILINGS = "cik bigint, company string, ticker string, form string, filing_date date, report_date date, accession string, primary_document string, is_inline_xbrl int, doc_id string"
PREDICTIONS = "doc_id string, field string, method string, run_label string, predicted double, status string, seconds double, input_tokens double, output_tokens double, usd double"
ALL_PERIODS = "cik bigint, field string, period_end date, value double"
PRICING = "model string, usd_per_million_input double, usd_per_million_output double"
COMPANY_FACTS = "map<string,map<string,struct<units:map<string,array<struct<start:string,end:string,val:double,accn:string,form:string,fy:int,fp:string>>>>>>"
_FILED = "accessionNumber:array<string>,form:array<string>,filingDate:array<string>,reportDate:array<string>,primaryDocument:array<string>,isInlineXBRL:array<int>"
#: A history's main page, or (with the arrays at the top) one of the overflow pages that it names.
SUBMISSIONS = f"name string, tickers array<string>, filings struct<recent:struct<{_FILED}>,files:array<struct<name:string>>>, " + ", ".join(x.replace(":", " ", 1) for x in _FILED.split(",") if x)
