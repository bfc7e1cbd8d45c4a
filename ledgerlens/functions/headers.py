"""Period columns from a table's first rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a header prints a date or a year, and how many rows are looked at.
FULL_DATE = r"\b([A-Za-z]{3,9})\.?\s+(\d{1,2})\s*,?\s*((?:19|20)\d{2})\b"
YEAR_ONLY = r"^\(?\s*((?:19|20)\d{2})\s*\)?$"
MONTHS = "january february march april may june july august september october november december".split()
HEADER_ROWS = 6


def iso_date(cell: Column) -> Column:
    """yyyy-mm-dd of the first date in a cell; the month counts by its first three letters and the day is not checked."""
    part = lambda k: F.regexp_extract(cell, FULL_DATE, k)
    names = F.array(*[F.lit(m[:3]) for m in MONTHS])
    month = F.array_position(names, F.lower(F.substring(part(1), 1, 3)))
    return F.when((part(1) != "") & (month > 0), F.concat_ws("-", part(3), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(2), 2, "0")))


def year_only(cell: Column) -> Column:
    y = F.regexp_extract(cell, YEAR_ONLY, 1)
    return F.when(y != "", y.cast("int"))


def _first_row_with(rows: Column, read) -> Column:
    """What `read` finds in the first of the header rows where it finds anything; an empty array if nowhere."""
    each = F.transform(F.slice(rows, 1, HEADER_ROWS), lambda r: F.filter(F.transform(F.filter(r, lambda c: ~F.coalesce(c, F.lit("")).isin("", "$")), read), lambda x: x.isNotNull()))
    kind = "string" if read is iso_date else "int"
    return F.coalesce(F.get(F.filter(each, lambda x: F.size(x) > 0), 0), F.array().cast(f"array<{kind}>"))


def header_dates(rows: Column) -> Column:
    return _first_row_with(rows, iso_date)


def header_years(rows: Column) -> Column:
    return _first_row_with(rows, year_only)


def resolve_column(dates: Column, years: Column, report_date: Column) -> Column:
    """struct(index, basis): which printed figure of a row belongs to the period; index is null if none does.

    Full dates decide if there are any, then years; a newest year within one of the period's is a
    fiscal-year label; without a header the first column is assumed.
    """
    target = F.date_format(report_date, "yyyy-MM-dd")
    year = F.year(report_date)
    newest = F.array_max(years)
    at = lambda a, x: (F.array_position(a, x) - 1).cast("int")
    made = lambda i, b: F.struct((F.lit(None).cast("int") if i is None else i).alias("index"), F.lit(b).alias("basis"))
    return (
        F.when((F.size(dates) > 0) & F.array_contains(dates, target), made(at(dates, target), "header_full_date"))
        .when(F.size(dates) > 0, made(None, "header_date_no_match"))
        .when((F.size(years) > 0) & F.array_contains(years, year), made(at(years, year), "header_year"))
        .when((F.size(years) > 0) & (F.abs(newest - year) <= 1), made(at(years, newest), "header_fiscal_year_label"))
        .when(F.size(years) > 0, made(None, "header_year_no_match"))
        .otherwise(made(F.lit(0), "assumed_first_column"))
    )
