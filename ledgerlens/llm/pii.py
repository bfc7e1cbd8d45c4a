"""Personal data by weak supervision.

Base spans come from four strict patterns. Wider patterns propose candidates; the labelers vote on
each: the strict pattern, gazetteers (top-level domains, calling and area codes, card issuers,
private address blocks), words around it, and its edges. Votes are counted over all documents by
kind, vote pattern and shape (at most 4 * 3 ** 4 * 24 rows, whatever the corpus); on these counts
expectation-maximisation estimates how reliable each labeler is, and a logistic classifier learns the
posteriors from the votes and the span's own shape. Candidates that it accepts, and that touch no base
span, are added; base spans stay.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, materialize

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    # possessive and behind no digit: the same matches, but no second look at a long run of digits
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
WIDE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?(?:@|[\[(]\s?at\s?[\])])\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|[\[(]\s?dot\s?[\])])\s?[A-Za-z0-9-]{1,63}){1,4}"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20.-][0-9]{4}){3}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[.-][0-9]{4}|00[0-9]{1,3}[\x20-][0-9]{2,4}[\x20-][0-9]{3,8})(?![0-9])"),
}
#: Public registries and plain words.
DOMAINS = set("com org net edu gov mil int info biz io dev app ai co me de fr es it nl be ch at pl se no dk fi uk ie pt eu us ca mx br ar cl au nz jp cn in kr ru ua za".split())
ISSUERS = ("34", "37", "36", "38", "300", "301", "302", "303", "304", "305", "4", "51", "52", "53", "54", "55", "2221", "2720", "6011", "644", "645", "646", "647", "648", "649", "65", "3528", "3589", "62")
AROUND = {
    "email": (re.compile(r"mail|contact|write to|correo|courriel|kontakt", re.I), re.compile(r"git@|regex|pattern", re.I)),
    "ip": (re.compile(r"\bip\b|address|host|server|adresse|dirección", re.I), re.compile(r"version|release|section|chapter|§", re.I)),
    "card": (re.compile(r"card|visa|master|amex|pay|karte|carte|tarjeta", re.I), re.compile(r"isbn|order|tracking|serial|invoice|hash", re.I)),
    "phone": (re.compile(r"phone|call|tel|mobile|fax|anruf|appel|llam", re.I), re.compile(r"isbn|order|serial|invoice|version", re.I)),
}
LABELERS = ("strict", "gazetteer", "context", "edges")
_LOCAL, _DOMAIN = re.compile(r"[A-Za-z0-9._%+-]+"), re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
_ANY = re.compile(r"[0-9@]|[\[(]\s?at\s?[\])]")


#: Features of the classifier, and the share of all votes that the prior of the labelers' rates is worth.
WIDTH, PRIOR = len(KINDS) + 2 * len(LABELERS) + 6, 0.25


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def strict(kind: str, text: str) -> bool:
    """Whether a match of the base pattern counts."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(int(p) <= 255 for p in (x.lstrip("0")[:4] or "0" for x in text.split(".")))
    digits = re.sub("[^0-9]", "", text)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of BASE["email"], found from each @ backwards and forwards, so that time grows with the text alone."""
    done, at = 0, text.find("@")
    while at >= 0:
        before, after = _LOCAL.match(text[done:at][::-1]), _DOMAIN.match(text, at)
        if before and after:
            yield at - before.end(), after.end()
        done = after.end() if before and after else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind in KINDS:
        if {"email": "@", "ip": ".", "card": "", "phone": "+"}[kind] in text:
            found = emails(text) if kind == "email" else ((m.start(), m.end()) for m in BASE[kind].finditer(text) if strict(kind, m.group()))
            out += [(kind, a, e) for a, e in found]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def votes(kind: str, text: str, a: int, e: int) -> tuple[int, ...]:
    """+1, 0 (abstains) or -1 of each labeler."""
    found = text[a:e]
    digits = re.sub("[^0-9]", "", found)
    m = BASE[kind].fullmatch(found)
    first = 1 if m and strict(kind, found) else -1 if kind == "card" and not luhn(digits) else 0
    if kind == "email":
        listed = 1 if re.split(r"[^A-Za-z0-9-]+", found.rstrip(")] "))[-1].lower() in DOMAINS else -1
    elif kind == "ip":
        p = [int(x) for x in found.split(".")]
        listed = -1 if max(p) > 255 or p[0] in (0, 255) else 0 if p[0] in (10, 127) or p[:2] in ([192, 168], [169, 254]) else 1
    elif kind == "card":
        listed = 1 if digits.startswith(ISSUERS) else -1
    else:
        area = digits[:3]
        listed = 1 if found.startswith("00") or (area[0] in "23456789" and area[1:] != "11") else -1
    near = text[max(0, a - 40) : a] + " " + text[e : e + 20]
    good, bad = AROUND[kind]
    context = -1 if bad.search(near) else 1 if good.search(near) else 0
    left, right = text[a - 1 : a], text[e : e + 1]
    joined = (left.isalnum() or left in ("_", "/", "=", "#", "-", "$", "€")) and left != "" or right.isalnum() or (right in ("_", "/", "%") and right != "")
    return first, listed, context, -1 if joined else 1


def shape(text: str) -> str:
    """What the classifier sees of a span besides its votes: a class of its length, how many kinds of separators, whether few different digits."""
    return f"{sum(len(text) >= n for n in (9, 13, 20))}{min(2, len(set(text) & set(' .-()[]')))}{int(len(set(text) & set('0123456789')) <= 3)}"


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str]]:
    """Wide matches with their votes and shape; of those that touch a base span only base spans themselves, which count for the fit."""
    out, own = [], set(base)
    covered = sorted((a, e) for _, a, e in base)
    starts = [a for a, _ in covered]
    reach = list(itertools.accumulate((e for _, e in covered), max))
    for kind in KINDS:
        for m in WIDE[kind].finditer(text):
            a, e = m.span()
            k = bisect.bisect_left(starts, e)
            if (kind, a, e) in own or not k or reach[k - 1] <= a:
                out.append((kind, a, e, "".join("-0+"[v + 1] for v in votes(kind, text, a, e)) + shape(m.group())))
    return out


def fit_reliabilities(counts: dict[tuple[str, str], int], rounds: int = 100) -> tuple[dict[tuple[str, str], float], dict[str, dict[str, float]]]:
    """Posterior of each (kind, vote pattern) and each labeler's accuracy by kind, by expectation-maximisation.

    Each labeler votes +, - or abstains independently given the truth, with its own rates. These are
    smoothed by the prior that a labeler is better than chance, worth PRIOR of the votes, so that classes do not swap.
    """
    posterior, accuracy = {}, {}
    for kind in KINDS:
        rows = [(p, c) for (k, p), c in sorted(counts.items()) if k == kind]
        if not rows:
            continue
        code = np.array([["-0+".index(x) for x in p[: len(LABELERS)]] for p, _ in rows])
        n = np.array([c for _, c in rows], float)
        belief = 1 / (1 + np.exp(-1.5 * (code - 1).sum(1)))  # to begin with, the majority
        for _ in range(rounds):
            yes, no = n * belief, n * (1 - belief)
            prior = (yes.sum() + 1) / (n.sum() + 2)
            score = np.full(len(n), math.log(prior / (1 - prior)))
            for k in range(len(LABELERS)):
                share = PRIOR * n.sum() / 4
                up = np.array([yes[code[:, k] == v].sum() + 1 + (2 + share) * (v == 2) for v in range(3)])
                down = np.array([no[code[:, k] == v].sum() + 1 + (2 + share) * (v == 0) for v in range(3)])
                score += np.log(up / up.sum() / (down / down.sum()))[code[:, k]]
            belief = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        posterior |= {(kind, p): float(b) for (p, _), b in zip(rows, belief, strict=True)}
        accuracy[kind] = {
            name: float((n * belief)[code[:, k] == 2].sum() + (n * (1 - belief))[code[:, k] == 0].sum()) / max(1e-9, float(n[code[:, k] != 1].sum())) for k, name in enumerate(LABELERS)
        }
    return posterior, accuracy


def features(kind: str, pattern: str) -> np.ndarray:
    """Kind, each labeler's vote by sign, and the span's shape."""
    told, form = pattern[: len(LABELERS)], pattern[len(LABELERS) :] or "   "
    seen = [float(form[0] == x) for x in "123"] + [float(form[1] == x) for x in "12"] + [float(form[2] == "1")]
    return np.array([*(float(kind == k) for k in KINDS), *(float(x == s) for x in told for s in "+-"), *seen])


def fit_classifier(posterior: dict[tuple[str, str], float], counts: dict[tuple[str, str], int], rounds: int = 500) -> np.ndarray:
    """Weights of a logistic classifier of spans, with the posteriors as soft labels."""
    width = WIDTH
    if not posterior:
        return np.zeros(width)
    keys = sorted(posterior)
    x = np.stack([features(*k) for k in keys])
    y, n = np.array([posterior[k] for k in keys]), np.array([counts[k] for k in keys], float)
    n = np.sqrt(n) / np.sqrt(n).sum()
    w = np.zeros(width)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (n * (p - y)) + 1e-3 * w
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(width)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def accepts(weights: np.ndarray, kind: str, pattern: str, threshold: float = 0.5) -> bool:
    return 1 / (1 + math.exp(-float(features(kind, pattern) @ weights))) >= threshold


SPAN = "struct<kind:string,start:long,end:long"


def propose(docs: DataFrame) -> DataFrame:
    """(doc_id, text, base, wide) of every row: base spans, and candidates with their vote patterns."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    wide = pa.struct([*span, ("votes", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, more = [], []
            for t in batch.column(1).to_pylist():
                b = base_spans(t) if t and _ANY.search(t) else []
                base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in b])
                more.append([dict(zip(("kind", "start", "end", "votes"), s, strict=True)) for s in (candidates(t, b) if t and _ANY.search(t) else [])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(span)), pa.array(more, pa.list_(wide))], names=["doc_id", "base", "wide"])

    return docs.mapInArrow(run, f"doc_id long, base array<{SPAN}>>, wide array<{SPAN},votes:string>>")


def fit(found: DataFrame) -> np.ndarray:
    """The classifier's weights from the candidates' votes, which are counted by kind, vote pattern and shape (a bounded table)."""
    each = found.select(F.explode("wide").alias("w")).groupBy("w.kind", "w.votes").count()
    counts = {(r.kind, r.votes): r["count"] for r in each.collect()}
    return fit_classifier(fit_reliabilities(counts)[0], counts)


def added(base: list[tuple[str, int, int]], wide: list[tuple[str, int, int, str]], weights: np.ndarray) -> list[tuple[str, int, int]]:
    """The accepted candidates that touch neither a base span nor, in order, one another."""
    good = sorted((a, KINDS.index(k), e) for k, a, e, v in wide if accepts(weights, k, v))
    covered, out, done, at, reach = sorted((a, e) for _, a, e in base), [], 0, 0, 0
    for a, rank, e in good:
        while at < len(covered) and covered[at][0] < e:
            reach, at = max(reach, covered[at][1]), at + 1
        if a >= done and a >= reach:
            out.append((KINDS[rank], a, e))
            done = e
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added) of every row: the spans as (kind, start, end) in code points, end exclusive, by start, then kind.

    Defined cases: null and empty texts have none; spans of different kinds may overlap in base, added
    ones overlap no other; repeated rows each get their result; an empty table gives no rows.
    """
    found = materialize(propose(documents_of(docs, id_col, text_col)), "pii")
    weights = fit(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("base").to_pylist(), batch.column("wide").to_pylist(), strict=True)
            more = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in added([tuple(s.values()) for s in b], [tuple(s.values()) for s in w], weights)] for b, w in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("base"), pa.array(more, pa.list_(_SPAN))], names=["doc_id", "base", "added"])

    return found.mapInArrow(run, f"doc_id long, base array<{SPAN}>>, added array<{SPAN}>>")


def joined(spans: F.Column) -> F.Column:
    """kind:start:end of each span, by start, then kind as listed, comma-joined."""
    rank = F.array(*map(F.lit, KINDS))
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest_columns(spans: DataFrame) -> DataFrame:
    """The contract's columns of personal_data()."""
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return spans.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by [KIND]; what overlaps the span before goes with that."""
    out, at = [], 0
    for a, e, kind in sorted((a, e, k) for k, a, e in spans):
        if e > at:
            out += [text[at:a], f"[{kind.upper()}]"] if a >= at else []
            at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with every span in its text column replaced by [KIND]; all other columns stay.

    The votes are counted first; then each text is replaced where it stands, so ids may be null or
    repeated and no column is added or joined; a null text stays null.
    """
    texts = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    weights = fit(propose(documents_of(texts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            out = []
            for t in batch.column(k).to_pylist():
                if t and _ANY.search(t):
                    base = base_spans(t)
                    t = masked(t, [*base, *added(base, candidates(t, base), weights)])
                out.append(t)
            yield batch.set_column(k, batch.schema.field(k), pa.array(out, batch.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)
