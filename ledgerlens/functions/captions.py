"""Print scale and statement title from the text around a table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import once

# Scale phrases and what makes one not about money; statement titles without blanks, all in one
# pattern, so that one search finds the last title whatever it names.
SCALE = r"(?i)([a-z ]{0,24}?)\bin\s+(thousands?|millions?|billions?)\b"
CAPTION_SCALE = r"(?i)([a-z ]{0,24}?)\b(?:in\s+)?(thousands?|millions?|billions?)\b"
NOT_MONEY = r"(?i)(share|unit|ounce|barrel|tonne|ton|gallon|pound|euro)s?\s*,?\s*$"
CAPTION_ROWS, CAPTION_CELL = 4, 160
TITLES = r"(?i)consolidated(?:andcombined)?(?:statements?of(?:operations|income|earnings|comprehensiveincome)|balancesheets?|statements?offinancialposition|statements?ofcashflows?)"
INTERIM = r"(?i)(three|six|nine) months ended|quarter ended|quarterly"
NOTE_LANGUAGE = r"(?i)(the following tables?|reconcil|summari[sz]|disaggregat|by reportable segment|by segment|consisted of the following|were as follows)"


def _scale(text: Column, pattern: str) -> Column:
    """The factor of the first phrase about money, or null. Texts without any of the words are not searched for phrases."""

    def first(text: Column) -> Column:
        found = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda q, w: F.struct(q.alias("q"), F.lower(w).alias("w")))
        return F.get(F.filter(found, lambda x: ~x["q"].rlike(NOT_MONEY)), 0)["w"]

    low = F.lower(text)
    named = low.contains("thousand") | low.contains("million") | low.contains("billion")
    factor = lambda w: F.when(w.startswith("thousand"), 1_000).when(w.startswith("million"), 1_000_000).when(w.startswith("billion"), 1_000_000_000).cast("long")
    return F.when(named, once(first(text), factor))


def caption_scale(preamble: Column) -> Column:
    return F.coalesce(_scale(preamble, SCALE), F.lit(1).cast("long"))


def rows_scale(rows: Column) -> Column:
    """From the short cells of the first rows, where "in" may be missing."""
    cells = F.filter(F.flatten(F.slice(rows, 1, CAPTION_ROWS)), lambda c: (F.length(c) > 0) & (F.length(c) <= CAPTION_CELL))
    return F.coalesce(F.get(F.filter(F.transform(cells, lambda c: _scale(c, CAPTION_SCALE)), lambda x: x.isNotNull()), 0), F.lit(1).cast("long"))


def table_scale(preamble: Column, rows: Column) -> Column:
    return once(caption_scale(preamble), lambda s: F.when(s == 1, rows_scale(rows)).otherwise(s))


def statement_in(squeezed: Column) -> Column:
    """The statement that the last title in a text without blanks names, or null."""
    title = F.lower(F.try_element_at(F.regexp_extract_all(squeezed, F.lit(TITLES), F.lit(0)), F.lit(-1)))
    return once(title, lambda t: F.when(t.rlike("cashflows?$"), "cash_flow").when(t.rlike("balancesheets?$|financialposition$"), "balance_sheet").when(t.isNotNull(), "income_statement"))


def statement_of(text: Column) -> Column:
    """The statement that the last title in a text names, or null. Blanks do not count."""
    return statement_in(F.regexp_replace(text, r"(?U)\s+", ""))


def is_interim(rows: Column) -> Column:
    return F.array_join(F.flatten(F.slice(rows, 1, 4)), " ").rlike(INTERIM)
