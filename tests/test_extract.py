import datetime as dt
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from ledgerlens import schemas
from ledgerlens.functions import captions, figures, headers, scoring
from ledgerlens.functions.fields import FIELDS, load
from ledgerlens.operators import extract, failures
from ledgerlens.sources import html


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def row(cells):
    return F.array(*[F.lit(c) for c in cells])


@pytest.mark.parametrize(
    ("cells", "want"),
    [
        (["Sales", "$", "269", "(", "565", ")", "(", "334", ")"], [269.0, -565.0, -334.0]),
        (["Dash", "—", "12"], [12.0]),
        (["Note", "7", "1,250.5", "(3", ")"], [7.0, 1250.5, -3.0]),
        (["(", "x", ")", None, "", "5)"], [5.0]),
        ([], []),
    ],
)
def test_row_figures(spark, cells, want):
    assert one(spark, figures.row_figures(row(cells) if cells else F.array().cast("array<string>"))) == want


def test_dash_can_be_a_zero(spark):
    assert one(spark, figures.row_figures(row(["a", "—", "12"]), dash_as_zero=True)) == [0.0, 12.0]


@pytest.mark.parametrize(
    ("cells", "want"),
    [(["", "$", "Total  Assets (1)"], "total assets"), (["Net income....."], "net income"), (["Diluted Net Income Per Share 1"], "diluted net income per share"), (["Cash: "], "cash"), (["2024"], "2024"), (["`Quoted`"], "'quoted'"), (["(", ")"], "")],
)
def test_row_label(spark, cells, want):
    assert one(spark, figures.row_label(row(cells))) == want


def test_clean_cell(spark):
    assert one(spark, figures.clean_cell(F.lit("  a ’b— –c\n"))) == "a 'b -c"


@pytest.mark.parametrize(
    ("caption", "want"),
    [("(In millions, except shares)", 10**6), ("shares in thousands, dollars in millions", 10**6), ("Dollars and Shares in Millions", 1), ("in Billions", 10**9), ("", 1)],
)
def test_scale(spark, caption, want):
    assert one(spark, captions.caption_scale(F.lit(caption))) == want


def test_scale_in_rows(spark):
    rows = F.array(row(["(Millions, except per share)"]), row(["x"]))
    assert one(spark, captions.table_scale(F.lit("no caption"), rows)) == 10**6
    assert one(spark, captions.table_scale(F.lit("in thousands"), rows)) == 10**3


@pytest.mark.parametrize(
    ("text", "want"),
    [("CONSOLIDATED STATEMENTS OF INCOM E", "income_statement"), ("Consolidated Statements of Income then Consolidated Balance Sheets", "balance_sheet"), ("Consolidated Statement of Cash Flows", "cash_flow"), ("Consolidated and Combined Statements of Financial Position", "balance_sheet"), ("Notes", None)],
)
def test_statement_title(spark, text, want):
    assert one(spark, captions.statement_of(F.lit(text))) == want


def test_header_dates_and_years(spark):
    rows = F.array(row(["", "Year"]), row(["", "$", "Sept. 28, 2024", "September 30, 2023", "Foo 1, 2020"]), row(["2019"]))
    assert one(spark, headers.header_dates(rows)) == ["2024-09-28", "2023-09-30"]
    assert one(spark, headers.header_years(rows)) == [2019]
    assert one(spark, headers.header_years(F.array(row(["", "(2024)", "2023"])))) == [2024, 2023]


@pytest.mark.parametrize(
    ("dates", "years", "want"),
    [
        (["2024-12-31", "2023-12-31"], [], (0, "header_full_date")),
        (["2022-12-31"], [2024], (None, "header_date_no_match")),
        ([], [2025, 2024], (1, "header_year")),
        ([], [2023, 2022], (0, "header_fiscal_year_label")),
        ([], [2020], (None, "header_year_no_match")),
        ([], [], (0, "assumed_first_column")),
    ],
)
def test_column_resolution(spark, dates, years, want):
    c = headers.resolve_column(row(dates).cast("array<string>") if dates else F.array().cast("array<string>"), F.array(*map(F.lit, years)).cast("array<int>"), F.lit(dt.date(2024, 12, 31)))
    assert tuple(one(spark, c)) == want


INCOME = [
    ["", "2024", "2023"], ["Net sales", "$", "1,200", "$", "1,100"], ["Cost of sales", "700", "650"], ["Gross profit", "500", "450"], ["Operating income", "200", "(", "20", ")"],
    ["Net income", "150", "90"], ["Earnings per common share, diluted"], ["Continuing operations", "1.10", "0.90"], ["Total per share", "1.50", "0.80"],
]
NOTE = [["", "2024", "2023"], ["Revenue", "9", "8"], ["Cost of revenue", "5", "4"], ["Gross margin", "4", "4"], ["Net income", "1", "1"], ["Income tax", "1", "1"], ["per share", "1", "1"]]
BALANCE = [
    ["", "December 31, 2024", "December 31, 2023"], ["Total current assets", "50", "40"], ["Goodwill", "5", "5"], ["Total assets", "300", "280"], ["Total current liabilities", "30", "20"], ["Total liabilities", "120", "110"],
    ["Retained earnings", "60", "50"], ["Total Acme stockholders' equity", "170", "160"], ["Noncontrolling interest", "10", "10"], ["Total equity", "180", "170"], ["Total liabilities and equity", "300", "280"],
]


@pytest.fixture
def prepared(spark):
    table = lambda i, rows, preamble, statement, scale: (i, rows, preamble, statement, scale, None)
    rows = [
        ("d1", 0, 0, 0, "t", [table(3, NOTE, "The following table summarizes segments", None, 1), table(7, INCOME, "CONSOLIDATED STATEMENTS OF INCOME (in millions)", "income_statement", 10**6), table(9, BALANCE, "Consolidated Balance Sheets", "balance_sheet", 10**6)]),
        ("d2", 0, 0, 0, "t", []),
        ("d3", 0, 0, 0, None, None),
        ("d4", 0, 0, 0, "t", [table(0, [["", "2010", "2009"], *INCOME[1:]], "Consolidated statements of income", "income_statement", 1)]),
    ]
    return spark.createDataFrame(rows, schemas.PREPARED)


def found(spark, prepared, **k):
    periods = prepared.select("doc_id", F.lit("2024-12-31").cast("date").alias("report_date"))
    return {(r.doc_id, r.field): r for r in extract.extract(prepared, periods, **k).collect()}


def test_extraction(spark, prepared):
    got = found(spark, prepared)
    assert len(got) == 4 * len(FIELDS)
    value = lambda f: (got["d1", f].predicted, got["d1", f].status, got["d1", f].table_index)
    assert value("revenue") == (1.2e9, "ok", 7)
    assert value("operating_income") == (2e8, "ok", 7)
    assert value("eps_diluted") == (1.5, "ok", 7) and got["d1", "eps_diluted"].matched_label == "[section] earnings per common share, diluted"
    assert value("total_assets") == (3e8, "ok", 9) and got["d1", "total_assets"].column_basis == "header_full_date"
    assert value("total_liabilities")[0] == 1.2e8
    assert value("stockholders_equity") == (1.7e8, "ok", 9)
    assert value("cash_and_equivalents")[:2] == (None, "row_not_found")
    assert value("operating_cash_flow") == (None, "statement_not_found", None)
    assert {got[d, "revenue"].status for d in ("d2", "d3")} == {"statement_not_found"}
    assert got["d4", "revenue"].status == "column_unresolved" and got["d4", "revenue"].column_basis == "header_year_no_match"


def test_same_answers_under_any_partitioning(spark, prepared):
    from ledgerlens.operators import stats

    periods = prepared.select("doc_id", F.lit("2024-12-31").cast("date").alias("report_date"))
    digests = {stats.digest(extract.extract(prepared.repartition(n), periods.repartition(n)), ["doc_id", "field", "predicted", "status"]) for n in (1, 8)}
    assert len(digests) == 1


def test_escaped_patterns_need_a_backslash(spark):
    from ledgerlens.functions.fields import first_match

    f = next(f for f in FIELDS if f.key == "stockholders_equity")
    assert one(spark, first_match(F.lit("total acme stockholders' equity (deficit)"), f.row_patterns)) is None
    assert one(spark, first_match(F.lit("total stockholders' equity (deficit)"), f.row_patterns)) == 9


def test_fields_from_a_file(tmp_path):
    (tmp_path / "f.json").write_text('{"fields": {"a": {"label": "A", "statement": "cash_flow", "period_type": "instant", "row_patterns": ["^a$"], "more": 1}}}')
    assert load(str(tmp_path / "f.json"))[0].row_patterns == ("^a$",)


def test_failure_context(spark, prepared):
    sample = spark.createDataFrame([("d1", "revenue", "rules", "net sales"), ("d1", "net_income", "rules", "nowhere")], "doc_id string, field string, method string, matched_label string")
    got = {r.field: r for r in failures.annotate(sample, prepared).collect()}
    assert got["revenue"].read_row == "Net sales | $ | 1,200 | $ | 1,100" and got["revenue"].nearby_rows == "2024 // net sales // cost of sales // gross profit"
    assert got["net_income"].read_row is None and got["net_income"].nearby_rows.startswith("2024 // net sales")


PAGE = """<html><head><style>x</style></head><body><ix:header>hidden 9<ix:nonFraction>1</ix:nonFraction></ix:header>
<p>CONSOLIDATED BALANCE SHEETS</p><p>(in thousands)</p><table><tr><td>Item</td><td>2024<sup>1</sup><tr><td>Total assets</td><td>$</td><td><ix:nonFraction name="a">5,000</ix:nonFraction></td></tr>
<tr><td> </td></tr><tr><td><table><tr><td>inner</td><td>1</td></tr></table></td></tr></table><script>var a = "<td>";</script></body></html>"""


def test_html_preparation(spark):
    pages = spark.createDataFrame([("p", PAGE), ("q", None), ("r", "")], "doc_id string, html string")
    got = {r.doc_id: r for r in html.prepare(pages).collect()}
    p = got["p"]
    assert p.ix_facts_removed == 2 and "hidden" not in p.text and "var a" not in p.text and p.stripped_chars < p.raw_chars == len(PAGE)
    assert [t.rows for t in p.tables] == [[["Item", "2024"], ["Total assets", "$", "5,000"], ["inner 1"]], [["inner", "1"]]]
    assert p.tables[0].statement == "balance_sheet" and p.tables[0].scale == 1000
    assert not got["q"].tables and not got["r"].tables


def test_preamble_counts_text_once_or_as_elements_too():
    page = "<div><p><b>Title</b></p><table><tr><td>1</td></tr></table></div>"
    assert html.parse_page(page)["tables"][0]["preamble"] == "Title Title Title"
    assert html.parse_page(page, once=True)["tables"][0]["preamble"] == "Title"


@pytest.mark.parametrize(
    ("p", "v", "unit", "want"),
    [(100.4, 100.0, "USD", "correct"), (1.004, 1.0, "USD/shares", "correct"), (0.001, 0.0, "USD", "correct"), (1e5, 100.0, "USD", "scaling_error"), (1e6, 100.0, "USD", "wrong_row"), (-1e5, 100.0, "USD", "wrong_row"), (80.0, 100.0, "USD", "wrong_period"), (None, 1.0, "USD", "not_found")],
)
def test_outcomes(spark, p, v, unit, want):
    got = one(spark, scoring.classify(F.lit(p).cast("double"), F.lit("ok"), F.lit(v), F.lit(unit), F.lit(p == 80.0)))
    assert got == want
    assert one(spark, scoring.classify(F.lit(None).cast("double"), F.lit("no_value_in_row"), F.lit(v), F.lit(unit), F.lit(False))) == "parse_error"


def test_wilson(spark):
    low, high = scoring.wilson(F.lit(154), F.lit(160))
    assert (one(spark, low), one(spark, high)) == pytest.approx((0.9206091783691167, 0.982702312729603), abs=1e-12)
    assert one(spark, scoring.wilson(F.lit(0), F.lit(0))[0]) is None


class _Events(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.seen = []

    def handle_starttag(self, tag, attrs):
        self.seen.append(("start", tag))

    def handle_endtag(self, tag):
        self.seen.append(("end", tag))

    def handle_data(self, data):
        self.seen.append(("data", data))


def test_plain_pages_read_as_the_standard_parser_reads_them():
    rng = random.Random(2)
    parts = [
        "<p>", "</p>", "<TD class='a b' x=1 y>", "</Td >", "<br/>", "<br />", "<img src=\"a>b\" alt='<'/>", "text ", "a &amp; b", "&nbsp", "&#8212;&lt", "<!-- c > -->", "<!DOCTYPE html>", "\n", "é 漢",
        "<", "a < b", "<a href=x/>", "</>", "<!-->", "<!-- a -- b -->", "<?pi x?>", "<script>if (a<b) </script>", "<style>x", "<title>T</title>", "<td", "<p a=\"1\"b>", "<![CDATA[x]]>", "</p x>", "<ix:a k=v>", "<p / a>", "<title>a &amp; b</title>", "<TITLE x='1'>b</TITLE>", "<title></title>", "<style>p { a: b & c }</style>", "<Script>x &lt; y</Script >", "<script>x</SCRIPT>", "<scripted>", "<textarea>\n x</textarea>", "<title/>", "<style />", "<xmp>a</xmp>", "<x\x0by>", "<p a\x0bb=1>",
    ]
    plain = 0
    for k in range(4000):
        page = "".join(rng.choice(parts[: 15 if k % 2 else len(parts)]) for _ in range(rng.randrange(12)))
        one, two = _Events(), _Events()
        html.read_page(page, one)
        two.feed(page)
        two.close()
        assert one.seen == two.seen, page
        plain += html._tokens(page) is not None
    assert plain > 1000


def test_statement_tables_are_those_of_all_features(spark, sf_dir):
    """Picked by what ranks a table alone, with nulls among the rows, and with the same features as if all tables had had them."""
    from ledgerlens.plans import statements

    tables = statements.printed_tables(spark, sf_dir)
    odd = tables.limit(20).select("doc_id", (F.col("index") + 100_000).cast("int").alias("index"), F.when(F.col("index") % 2 == 0, F.concat("rows", F.array(F.lit(None).cast("array<string>"), F.array(F.lit(None).cast("string"))))).alias("rows"), "preamble", "statement", "scale")
    tables = tables.unionByName(odd)
    want = extract.pick_statements(extract.table_features(tables))
    got = extract.statement_tables(tables)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 20


def test_failure_notes_gather_no_document(spark, sf_dir):
    """The tables of a document are never one row, and orders are read and their tables ranked once."""
    from ledgerlens.plans import runs

    df = runs.failure_notes(spark, sf_dir)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "collect_list" in plan and "collect_list(struct(index" not in plan
    assert sum("FileScan" in x and "o_orderkey" in x for x in plan.splitlines()) == 1
