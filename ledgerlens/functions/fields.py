"""The nine target fields. A user's own list can be read from JSON with `load`."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    key: str
    label: str
    statement: str
    period_type: str
    unit: str = "USD"
    scaled: bool = True
    negative_ok: bool = True
    concepts: tuple[str, ...] = ()
    row_patterns: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    section_patterns: tuple[str, ...] = ()
    section_exclude_patterns: tuple[str, ...] = field(default=())


def load(path: str) -> list[Field]:
    """Fields from a JSON file: {"fields": {key: {...}}}, or the inner object alone; missing lists are empty."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    names = set(Field.__dataclass_fields__)
    return [Field(key=k, **{n: tuple(v) if isinstance(v, list) else v for n, v in x.items() if n in names}) for k, x in found.get("fields", found).items()]


_PER_SHARE = ".*per (common )?share.*"
# Fields, accepted concepts in order of preference, and label patterns in order of priority.
FIELDS = [
    Field(
        "revenue", "Total revenue", "income_statement", "duration", negative_ok=False,
        concepts=("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueNet", "SalesRevenueGoodsNet"),
        row_patterns=(
            "^total net sales$", "^total revenues?$", "^total net revenues?$", "^net revenues?$", "^net sales$", "^net operating revenues$",
            "^total revenues? and other income$", "^revenues?$", "^total sales$", "^operating revenues$",
        ),
        exclude_patterns=(".*cost of.*", _PER_SHARE),
    ),
    Field(
        "operating_income", "Operating income", "income_statement", "duration",
        concepts=("OperatingIncomeLoss",),
        row_patterns=(
            "^operating income$", r"^operating income \(loss\)$", "^income from operations$", "^operating profit$", "^total operating income$",
            r"^operating income \(expense\)$", "^earnings from operations$", "^operating earnings$", "^loss from operations$",
        ),
        exclude_patterns=(_PER_SHARE, ".*segment.*"),
    ),
    Field(
        "net_income", "Net income", "income_statement", "duration",
        concepts=("NetIncomeLoss", "ProfitLoss"),
        row_patterns=(
            r"^net income \(loss\) attributable to (?!.*noncontrolling).*$", "^net income attributable to (?!.*noncontrolling).*$",
            r"^net earnings \(loss\) attributable to (?!.*noncontrolling).*$", "^net earnings attributable to (?!.*noncontrolling).*$",
            "^net income$", "^net earnings$", r"^net income \(loss\)$", r"^net earnings \(loss\)$", "^net loss$", "^consolidated net income$",
        ),
        exclude_patterns=("^less", ".*noncontrolling.*", _PER_SHARE, ".*comprehensive.*"),
        section_exclude_patterns=(_PER_SHARE, ".*earnings per.*"),
    ),
    Field(
        "eps_diluted", "Diluted earnings per share", "income_statement", "duration", unit="USD/shares", scaled=False,
        concepts=("EarningsPerShareDiluted", "IncomeLossFromContinuingOperationsPerDilutedShare"),
        row_patterns=(
            "^diluted$", r"^diluted \(in .*\)$", "^diluted net income per share$", r"^diluted net income \(loss\) per share$", "^diluted earnings per share$",
            "^diluted earnings per common share$", "^diluted net income per share attributable to .*$", "^diluted earnings per share attributable to .*$",
            r"^earnings \(loss\) per share diluted$", "^earnings per share diluted$", r"^earnings \(loss\) per common share diluted$", "^earnings per common share diluted$",
            "^net income per share diluted$", r"^net income \(loss\) per share diluted$", "^earnings per share, diluted$", "^diluted .*per share$",
            "^diluted net earnings per (common )?share$", r"^diluted net earnings \(loss\) per (common )?share$", "^earnings.*per (common )?share.*diluted$",
            "^net (income|earnings).*per (common )?share.*diluted$",
        ),
        exclude_patterns=(".*continuing operations.*", ".*discontinued.*", ".*weighted.average.*", "^average shares.*", ".*shares outstanding.*", ".*effect of dilutive.*", "^basic.*"),
        section_patterns=(
            "^earnings per common share.{0,4}diluted$", "^earnings per share.{0,4}diluted$", "^diluted earnings per (common )?share$",
            "^diluted net income per (common )?share$", "^net income per (common )?share.{0,4}diluted$",
        ),
        section_exclude_patterns=(".*basic.*", ".*continuing operations.*", ".*discontinued.*"),
    ),
    Field(
        "total_assets", "Total assets", "balance_sheet", "instant", negative_ok=False,
        concepts=("Assets",), row_patterns=("^total assets$",), exclude_patterns=(".*current.*", ".*noncurrent.*"),
    ),
    Field(
        "total_liabilities", "Total liabilities", "balance_sheet", "instant", negative_ok=False,
        concepts=("Liabilities",), row_patterns=("^total liabilities$",), exclude_patterns=(".*current.*", ".*and equity.*", ".*and.*holders.? equity.*", ".*noncurrent.*"),
    ),
    Field(
        "stockholders_equity", "Total stockholders equity", "balance_sheet", "instant",
        concepts=("StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"),
        row_patterns=(
            "^total .*(share|stock)holders.? equity$", "^total .*shareowners.? equity$", r"^total .*(share|stock)holders.? equity \\(deficit\\)$",
            r"^total .*(share|stock)holders.? \\(deficit\\) equity$", r"^total (share|stock)holders.? equity \\(deficit\\)$",
            r"^total (share|stock)holders.? \\(deficit\\) equity$", "^equity attributable to .*$", "^total (share|stock)holders.? equity$",
            "^total shareowners.? equity$", r"^total (share|stock)holders.? equity \(deficit\)$", r"^total (share|stock)holders.? \(deficit\) equity$", "^total equity$",
        ),
        exclude_patterns=(".*liabilit.*", ".*noncontrolling.*", ".*redeemable.*"),
    ),
    Field(
        "cash_and_equivalents", "Cash and cash equivalents", "balance_sheet", "instant", negative_ok=False,
        concepts=("CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents"),
        row_patterns=("^cash and cash equivalents$", "^cash and cash equivalents, .*$", "^cash and equivalents$", r"^cash and cash equivalents \(.*\)$", "^cash$"),
        exclude_patterns=(".*restricted.*", ".*end of.*", ".*beginning of.*", ".*marketable.*"),
    ),
    Field(
        "operating_cash_flow", "Net cash from operating activities", "cash_flow", "duration",
        concepts=("NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"),
        row_patterns=(
            "^net cash provided by operating activities$", r"^net cash provided by \(used in\) operating activities$", r"^net cash provided by \(used for\) operating activities$",
            "^cash generated by operating activities$", "^net cash flows from operating activities$", "^net cash from operating activities$", "^cash provided by operating activities$",
            "^net cash provided by operations$", "^total cash provided by operating activities$", "^net cash used in operating activities$", "^cash flows from operating activities$",
            "^total operating activities$", "^net cash flows provided by operating activities$", "^cash flows from operations$", "^net cash generated by operating activities$",
        ),
        exclude_patterns=(".*investing.*", ".*financing.*"),
    ),
]


def first_match(label: Column, patterns: tuple[str, ...]) -> Column:
    """The number of the first pattern that matches at the label's start, or null: one CASE of literal patterns."""
    out = None
    for k, p in enumerate(patterns):
        hit = label.rlike(f"^(?:{p})")
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return F.lit(None).cast("int") if out is None else out


def matches_any(label: Column, patterns: tuple[str, ...]) -> Column:
    return label.rlike("|".join(f"^(?:{p})" for p in patterns)) if patterns else F.lit(False)
