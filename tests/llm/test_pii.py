import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import pii

SAMPLES = [
    "write to jo.e+x@mail.example.com, or a@b, a@b.c.d",
    "host 10.0.0.1 and 256.1.1.1 then 1.2.3.4.5 and 007.8.9.10",
    "card 4111 1111 1111 1111 and 4111111111111112, 5500-0000-0000-0004",
    "call +1 (456) 555-2186 or 456-555-2186 or (456) 555-2186 now",
    "mail: jane (at) example (dot) org, contact bob [at] site.com today",
    "\U0001f600 é +49 30 1234567890 ñ 10.20.30.40",
]


def plain(text):
    """The contract's base spans, written out again."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        n = [int(c) for c in m.group() if c in "0123456789"]
        odd = sum(n[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in n[-2::-2])
        if 14 <= len(n) <= 19 and odd % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return [f"{k}:{a}:{e}" for a, _, k, e in sorted(out)]


def check(rows, got):
    for i, t in rows:
        want, r = plain(t or ""), got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in pii.KINDS]
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans) and len(spans) == len(want) + r.n_added
        keys = [(int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])) for s in spans]
        assert keys == sorted(keys)


def test_base_spans(docs, hard):
    rows = list(enumerate(hard + SAMPLES))
    check(rows, {r.doc_id: r for r in pii.digest_columns(pii.personal_data(docs(rows))).collect()})


def test_table_of_the_driver(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check([(r.doc_id, r.text) for r in df.collect()], {r.doc_id: r for r in pii.digest_columns(pii.personal_data(df)).collect()})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="0123456789.@+-() aé", max_size=60))
def test_base_of_odd_texts(text):
    assert [f"{k}:{a}:{e}" for k, a, e in pii.base_spans(text)] == plain(text)


def test_labelers_add_what_the_strict_patterns_miss(docs):
    rows = list(enumerate(SAMPLES * 30 + ["version 1.2.3.4.5, order 456-555-2186x, nothing here"] * 20))
    got = {r.doc_id: r for r in pii.personal_data(docs(rows)).collect()}
    found = lambda i: {rows[i][1][s.start : s.end] for s in got[i].added}
    assert "456-555-2186" in found(3) and "jane (at) example (dot) org" in found(4)
    assert not got[len(rows) - 1].added


def test_reliabilities_tell_a_good_labeler_from_a_bad_one():
    counts = {("phone", "+++-"): 400, ("phone", "---+"): 400, ("phone", "++++"): 300, ("phone", "----"): 300}
    _, accuracy = pii.fit_reliabilities(counts)
    assert accuracy["phone"]["strict"] > 0.9 > 0.7 > accuracy["phone"]["edges"]
    assert pii.fit_reliabilities({}) == ({}, {}) and len(pii.fit_classifier({}, {})) == pii.WIDTH


def test_redaction(docs):
    rows = list(enumerate([*SAMPLES, None, "", "x"]))
    got = {r.doc_id: r for r in pii.redact(docs(rows)).collect()}
    spans = {r.doc_id: r for r in pii.personal_data(docs(rows)).collect()}
    for i, t in rows:
        if t:
            out, at = "", 0
            for s in sorted([*spans[i].base, *spans[i].added], key=lambda s: (s.start, s.end)):
                if s.end <= at:
                    continue
                out += t[at : s.start] + f"[{s.kind.upper()}]" if s.start >= at else ""
                at = s.end
            t = out + t[at:]
        assert got[i].text == t
    twice = pii.redact(docs([(None, SAMPLES[0]), (None, SAMPLES[3]), (7, SAMPLES[3]), (7, SAMPLES[3]), (None, None)])).collect()
    assert len(twice) == 5 and not any(r.text and ("jo.e" in r.text or "555" in r.text) for r in twice)
    assert got[0].key == 1 and "EMAIL" in got[0].text and "10.20" not in got[5].text


def test_no_rows(docs):
    assert pii.digest_columns(pii.personal_data(docs([(1, "x")]).where("false"))).count() == 0


def test_long_runs_take_time_in_proportion():
    """Five million letters or digits with an @ or a dot elsewhere, and many spans in one text."""
    import time

    began = time.monotonic()
    n = 5_000_000
    for text in ("a" * n + " x@y.z", "1" * n + ".2", "a." * (n // 2) + "@", "@a" * (n // 2), "+1" + " " * n, "x@" + "a-" * (n // 2) + ".de"):
        base = pii.base_spans(text)
        assert len(base) == (1 if text.endswith((" x@y.z", ".de")) else 0)
    many = "write a@b.de or 10.0.0.1 now " * 40_000
    base = pii.base_spans(many)
    assert len(base) == 80_000
    assert len(pii.masked(many, [*base, *pii.added(base, pii.candidates(many, base), [0.0] * pii.WIDTH)])) > 0
    assert time.monotonic() - began < 120


def test_columns_of_the_user_stay(docs):
    df = docs([(1, SAMPLES[0]), (None, None)]).selectExpr("*", "'keep' as _hash", "'too' as _text", "5 as _key", "array(1) as _spans")
    got = pii.redact(df)
    assert got.columns == df.columns
    assert {(r._hash, r._text, r._key, tuple(r._spans)) for r in got.collect()} == {("keep", "too", 5, (1,))}
