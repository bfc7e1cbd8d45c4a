"""Raw HTML to prepared documents: markup stripped, tables as nested rows, text around them.

One Arrow function parses the pages (there is no built-in for that); tag stripping, scale and title
are Column expressions around it. Broken markup is read as the standard library's parser reads it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import captions

PREAMBLE, TITLE_WINDOW = 900, 3000
#: Pages whose tables are held at once on their way out of a worker.
PAGES = 16
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_DROPPED = {"script", "style", "sup"}


# The machine tags of filings.
def strip_markup(html: Column) -> Column:
    """Without the filer's machine tags: headers and hidden parts go, other tags leave what they enclose."""
    out = F.regexp_replace(html, r"(?is)<ix:header\b.*?</ix:header>", " ")
    out = F.regexp_replace(out, r"(?is)<ix:hidden\b.*?</ix:hidden>", " ")
    out = F.regexp_replace(out, r"</?ix:[a-zA-Z]+\b[^>]*>", "")
    return F.regexp_replace(out, r"</?(xbrli|xbrldi|link|xlink|iso4217|xbrl):[a-zA-Z]+\b[^>]*>", "")


def tagged_figures(html: Column) -> Column:
    return F.regexp_count(html, F.lit(r"(?i)<ix:nonfraction\b")).cast("long")


class _Node:
    """only: the one string that the element encloses, through any number of elements, once `_told` has run."""

    __slots__ = ("kids", "only", "parent", "tag")

    def __init__(self, tag: str, parent: _Node | None):
        self.tag, self.parent, self.kids, self.only = tag, parent, [], None

    def text(self) -> str:
        out, waiting = [], [self]
        while waiting:
            x = waiting.pop()
            if isinstance(x, str):
                if x.strip():
                    out.append(x.strip())
            else:
                waiting.extend(reversed(x.kids))
        return " ".join(out)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", None)
        self.order: list = []  # elements and strings as they begin
        self.dropped = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _DROPPED:
            self.dropped += 1
        if self.dropped:
            return
        if tag in ("td", "th", "tr"):
            self.leave({"td", "th"} if tag != "tr" else {"td", "th", "tr"})
        node = _Node(tag, self.at)
        self.at.kids.append(node)
        self.order.append(node)
        if tag not in _VOID:
            self.at = node

    def leave(self, tags: set[str]) -> None:
        """Close open cells or rows of the innermost table, as their end tags may be missing."""
        x = self.at
        while x is not self.root and x.tag != "table":
            if x.tag in tags:
                self.at = x.parent
            x = x.parent

    def handle_endtag(self, tag: str) -> None:
        if tag in _DROPPED:
            self.dropped = max(0, self.dropped - 1)
            return
        x = self.at
        while x is not self.root and x.tag != tag:
            if x.tag == "table":
                return
            x = x.parent
        if x is not self.root:
            self.at = x.parent

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.at.kids.append(data)
            self.order.append(data)


_ATTRIBUTES = r"""(?:[ \t\n\r\f]+[^\s"'<>/=\x00]+(?:=(?:"[^"]*"|'[^']*'|[^\s"'<>=`/\x00]++(?!/)))?)*[ \t\n\r\f]*"""
#: A run of text, a tag with well-formed attributes, an element whose content is no markup and has none, a
#: comment or a declaration; anything else is for the standard parser.
_TOKEN = re.compile(
    rf"""(?P<text>[^<]+)
    |<(?!(?i:script|style|textarea|title|iframe|noembed|noframes|noscript|plaintext|xmp)[\t\n\r\f />])(?P<start>[a-zA-Z][^\t\n\r\f />\x00]*){_ATTRIBUTES}(?P<empty>/?)>
    |</(?P<end>[a-zA-Z][^\t\n\r\f />\x00]*)[ \t\n\r\f]*>
    |<(?P<raw>(?i:script|style|title|textarea))(?=[\t\n\r\f >]){_ATTRIBUTES}>(?P<inside>[^<]*)</(?P=raw)[ \t\n\r\f]*>
    |<!--(?!-?>)(?:(?!--)[^\x00])*-->
    |<![dD][oO][cC][tT][yY][pP][eE][^<>\[\]"'\x00]*>""".replace("\n    |", "|"),
)


def _tokens(html: str) -> list[re.Match] | None:
    """The page's tokens, or None if it is not made of well-formed ones only."""
    at, out = 0, []
    for m in _TOKEN.finditer(html):
        if m.start() != at:
            return None
        at = m.end()
        out.append(m)
    return out if at == len(html) else None


def read_page(html: str, into: HTMLParser) -> None:
    """Gives `into` the events that its own feed() would, by one regular expression where the page is plain."""
    tokens = _tokens(html)
    if tokens is None:
        into.feed(html)
        into.close()
        return
    start, end, data = into.handle_starttag, into.handle_endtag, into.handle_data
    for m in tokens:
        kind = m.lastgroup
        if kind == "text":
            text = m[0]
            data(unescape(text) if "&" in text else text)
        elif kind == "empty":
            tag = m["start"].lower()
            start(tag, [])
            if m["empty"]:
                end(tag)
        elif kind == "end":
            end(m["end"].lower())
        elif kind == "inside":
            tag, text = m["raw"].lower(), m["inside"]
            start(tag, [])
            if text:
                data(unescape(text) if tag in ("title", "textarea") else text)
            end(tag)


_PLAIN = str.maketrans({"\u00a0": " ", "\u2019": "'", "\u2018": "'", "\u2014": " ", "\u2013": "-", "\u2212": "-"})


def _clean(text: str) -> str:
    return " ".join((text if text.isascii() else text.translate(_PLAIN)).split())


def _told(order: list, once: bool) -> list[str]:
    """The cleaned text of each string, and unless `once` of each element with one string only; else empty."""
    for x in reversed(order):  # what an element encloses comes behind it
        if not isinstance(x, str) and len(x.kids) == 1:
            x.only = x.kids[0] if isinstance(x.kids[0], str) else x.kids[0].only
    texts = (x if isinstance(x, str) else None if once or x.tag == "table" else x.only for x in order)
    return [_clean(t) if t else "" for t in texts]


def _above(told: list[str], places: list[int], most: int) -> Iterator[str]:
    """For each place the text above it, at most its last `most` letters: slices of all text joined once."""
    joined = " ".join(t for t in told if t)
    at, done = 0, 0
    for k in places:
        for t in told[done:k]:
            at += len(t) + 1 if t else 0
        done = k
        yield joined[max(0, at - 1 - most) : max(0, at - 1)]


def _inside(x: _Node, table: _Node) -> bool:
    """Whether the innermost table around x is `table`."""
    while x is not None and x.tag != "table":
        x = x.parent
    return x is table


def parse_page(html: str | None, once: bool = False) -> dict:
    tree = _Tree()
    read_page(html or "", tree)
    found = []
    places = [k for k, x in enumerate(tree.order) if not isinstance(x, str) and x.tag == "table"]
    told = _told(tree.order, once) if places else []
    for index, (k, wide) in enumerate(zip(places, _above(told, places, TITLE_WINDOW), strict=True)):
        table, rows, waiting = tree.order[k], [], [tree.order[k]]
        while waiting:
            x = waiting.pop()
            if x.tag == "tr" and _inside(x.parent, table):
                cells, inner = [], list(reversed(x.kids))
                while inner:
                    y = inner.pop()
                    if isinstance(y, str) or y.tag == "table":
                        continue
                    if y.tag in ("td", "th"):
                        cells.append(_clean(y.text()))
                    inner.extend(reversed(y.kids))
                if any(cells):
                    rows.append(cells)
            waiting.extend(reversed([y for y in x.kids if not isinstance(y, str) and y.tag != "table"]))
        if rows:
            found.append({"index": index, "rows": rows, "preamble": wide[-PREAMBLE:], "wide": wide})
    lines = [" ".join(x.split()) for x in tree.order if isinstance(x, str)]
    return {"text": "\n".join(x for x in lines if x), "tables": found}


_TABLE = pa.struct([("index", pa.int32()), ("rows", pa.list_(pa.list_(pa.string()))), ("preamble", pa.string()), ("wide", pa.string())])


def prepare(pages: DataFrame, id_col: str = "doc_id", html_col: str = "html", once: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Prepared documents (schemas.PREPARED without scale_phrase) of a table of pages, with the columns of `carry` as they are.

    Null and empty pages have no table. A batch of pages is one page if pages have megabytes.
    """
    names = ["doc_id", "ix_facts_removed", "raw_chars", "stripped_chars", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, PAGES):
                batch = whole.slice(k, PAGES)
                made = [parse_page(h, once) for h in batch.column("stripped").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([m["text"] for m in made], pa.string()), pa.array([m["tables"] for m in made], pa.list_(_TABLE))], names=[*names, "text", "found"])

    html = F.col(f"`{html_col}`")
    ready = pages.select(F.col(f"`{id_col}`").cast("string").alias("doc_id"), tagged_figures(html).alias("ix_facts_removed"), F.length(html).cast("long").alias("raw_chars"), strip_markup(html).alias("stripped"), *carry)
    ready = ready.withColumn("stripped_chars", F.length("stripped").cast("long")).select(*names, "stripped")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema if f.name in carry)
    parsed = ready.mapInArrow(run, f"doc_id string, ix_facts_removed long, raw_chars long, stripped_chars long, {kinds + ', ' if kinds else ''}text string, found array<struct<index:int,rows:array<array<string>>,preamble:string,wide:string>>")
    table = lambda t: F.struct(t["index"].alias("index"), t["rows"].alias("rows"), t["preamble"].alias("preamble"), captions.statement_in(F.replace(t["wide"], F.lit(" "), F.lit(""))).alias("statement"), captions.table_scale(t["preamble"], t["rows"]).alias("scale"))
    return parsed.withColumn("tables", F.transform("found", table)).drop("found").select(*[c for c in (*names[:4], "text", "tables", *carry)])
