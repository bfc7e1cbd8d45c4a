"""The library's functions for SQL: `register(spark)` makes them temporary functions of the session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .figures import NUMBER

_TOLERANCE = 0.005

FUNCTIONS = {
    "parse_figure": rf"""(token string) returns double return case when trim(token) rlike r'{NUMBER}' then
        case when startswith(trim(token), '(') and endswith(trim(token), ')') then -1 else 1 end * try_cast(regexp_replace(trim(token), r'[(),$\s]', '') as double) end""",
    "values_agree": f"""(predicted double, expected double) returns boolean return
        case when expected = 0 then abs(predicted) <= {_TOLERANCE} else abs(predicted - expected) / abs(expected) <= {_TOLERANCE} end""",
    "document_key": "(cik bigint, accession string) returns string return format_string('%010d_%s', cik, accession)",
    "explode_cells": """(cells array<array<string>>) returns table(row_index int, cell_index int, cell string) return
        select r.pos, c.pos, c.col from posexplode(cells) as r(pos, cells) , lateral posexplode(r.cells) as c(pos, col)""",
}


class PageCells:
    """page_cells(TABLE(pages), id, html): a row for each printed cell of the pages' tables, in SQL.

    The columns are told by name; the id keeps its name and type, and other columns of the table are not read. With
    PARTITION BY the pages are dealt out so; null and empty pages give no row.
    """

    @staticmethod
    def analyze(pages: AnalyzeArgument, id: AnalyzeArgument, html: AnalyzeArgument) -> AnalyzeResult:
        if not pages.isTable:
            raise ValueError("page_cells takes a table: page_cells(TABLE(pages), 'page_id', 'html')")
        kinds = {f.name.lower(): f for f in pages.dataType.fields}
        for told in (id, html):
            if not isinstance(told.value, str) or told.value.lower() not in kinds:
                raise ValueError(f"page_cells: no column named {told.value!r}; the table has {', '.join(f.name for f in pages.dataType.fields)}")
        if kinds[html.value.lower()].dataType.simpleString() != "string":
            raise ValueError(f"page_cells: {html.value} is no string")
        own = kinds[id.value.lower()]
        schema = StructType().add(own.name, own.dataType)
        for name in ("table_index", "row_index", "cell_index"):
            schema = schema.add(name, IntegerType())
        return AnalyzeResult(schema.add("cell", StringType()))

    def eval(self, pages: Row, id: str, html: str) -> Iterator[tuple]:
        from ledgerlens.sources.html import parse_page

        at = {n.lower(): k for k, n in enumerate(pages.__fields__)}
        for table in parse_page(pages[at[html.lower()]])["tables"]:
            for r, cells in enumerate(table["rows"]):
                for c, cell in enumerate(cells):
                    yield pages[at[id.lower()]], table["index"], r, c, cell


def register(spark: SparkSession) -> list[str]:
    """The names registered: parse_figure, values_agree, document_key, and the table functions explode_cells and page_cells."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name} {body}")
    spark.udtf.register("page_cells", udtf(PageCells))
    return [*FUNCTIONS, "page_cells"]
