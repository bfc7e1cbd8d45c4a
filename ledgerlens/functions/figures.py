"""Figures and labels of printed rows, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import once

# What counts as a figure, and the marks that are no cell of their own.
NUMBER = r"^\(?-?\$?\s*\d[\d,]*(\.\d+)?\)?$"
NO_FIGURE = ("", "$")
NO_LABEL = ("", "$", "(", ")", "%")
#: What is taken off a label's end, in this order.
LABEL_ENDS = (
    (r"\(\s*\d{1,2}\s*\)\s*$", ""),
    (r"\s*\.{2,}\s*$", ""),
    (r"[:•]\s*$", ""),
    (r"\s+", " "),
    (r"(?<=[a-z\)])\s+\d{1,2}\s*$", ""),
    (r"\s+", " "),
)
_BLANKS = r"(?U)^\s+|\s+$"


def stripped(c: Column) -> Column:
    """Without blanks at either end, Unicode's too."""
    return F.regexp_replace(c, _BLANKS, "")


def clean_cell(c: Column) -> Column:
    """Blanks joined, typographic quotes plain, a long dash blank, short dashes hyphens."""
    # What each typographic mark reads as.
    plain = F.translate(c, "\u00a0\u2019\u2018\u2014\u2013\u2212", " '' --")
    return stripped(F.regexp_replace(plain, r"(?U)\s+", " "))


def parse_figure(c: Column) -> Column:
    """The number that a token prints, or null. Only a pair of parentheses negates; (-5) is thus 5."""
    bare = F.regexp_replace(c, r"(?U)[(),$\s]", "").try_cast("double")
    figure = r"^(?U:\s*)" + NUMBER[1:-1] + r"(?U:\s*)$"
    return F.when(c.rlike(figure), F.when(c.rlike(r"(?sU)^\s*\(.*\)\s*$"), -bare).otherwise(bare))


def join_split_cells(cells: Column, dash_as_zero: bool = False) -> Column:
    """Tokens of a row with parentheses that stand in cells of their own put back to their figures."""
    present = F.transform(cells, lambda c: F.coalesce(c, F.lit("")))
    if dash_as_zero:
        present = F.transform(present, lambda c: F.when(stripped(c).isin("-", "–", "—"), F.lit("0")).otherwise(c))
    none = F.array().cast("array<string>")

    def put(done: Column, x: Column) -> Column:
        n = F.size(done)
        last = F.element_at(done, F.when(n > 0, -1).otherwise(F.lit(None).cast("int")))
        but_last = F.slice(done, 1, F.greatest(n - 1, F.lit(0)))
        return (
            F.when((x == ")") & (n > 0), F.concat(but_last, F.array(F.concat(last, F.lit(")")))))
            .when((x != "(") & (n > 0) & (F.get(done, n - 1) == "("), F.concat(but_last, F.array(F.concat(F.lit("("), x))))
            .otherwise(F.concat(done, F.array(x)))
        )

    split = lambda tokens: F.array_contains(tokens, "(") | F.array_contains(tokens, ")")
    return once(F.filter(present, lambda c: ~c.isin(*NO_FIGURE)), lambda tokens: F.when(split(tokens), F.aggregate(tokens, none, put)).otherwise(tokens))


def row_figures(cells: Column, dash_as_zero: bool = False) -> Column:
    """The figures of a row in printed order. A dash prints a zero but is no figure, unless dash_as_zero."""
    return F.filter(F.transform(join_split_cells(cells, dash_as_zero), parse_figure), lambda v: v.isNotNull())


def normalise_label(c: Column) -> Column:
    out = F.replace(F.lower(stripped(c)), F.lit("`"), F.lit("'"))
    for pattern, to in LABEL_ENDS:
        out = F.regexp_replace(out, "(?U)" + pattern, to)
    return stripped(out)


def row_label(cells: Column) -> Column:
    """The first cell that is more than a mark, normalised; empty if there is none."""
    cleaned = F.transform(cells, lambda c: stripped(F.coalesce(c, F.lit(""))))
    return F.coalesce(normalise_label(F.get(F.filter(cleaned, lambda c: ~c.isin(*NO_LABEL)), 0)), F.lit(""))
