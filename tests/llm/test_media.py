import hashlib
import html
import zlib

import pytest

from ledgerlens.llm import media


def test_payloads_survive_storage(docs, hard):
    texts = [*hard, "a", "a ", "z" * 191, "z" * 192, "z" * 193, "é" * 96]
    got = {r.doc_id: r for r in media.text_media(docs(texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        b = (t or "").encode()
        p = b + b" " * (-len(b) % 192 if b else 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        image = media.to_png(p)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(image), hashlib.sha256(image).hexdigest(), media.sample_features(p))
        assert r.caption == f"{len(b)} bytes" and r.pos == (0 if not (t or "").split("\n")[0].strip() else 1)


def test_images_are_whole_or_refused():
    p = bytes(range(192)) * 3
    image = media.to_png(p)
    assert media.from_png(image) == p
    with pytest.raises(ValueError, match="damaged"):
        media.from_png(image[:60] + bytes([image[60] ^ 1]) + image[61:])


def test_order_positions_and_captions():
    page = """<html><head><title>T</title><style>x</style></head><body><p>One &amp; two<p>Three
    <figure><img src="sha256:aa"><figcaption>First <b>cap</b></figcaption></figure>tail
    <img src="http://x/y.png" alt="alt text"><script>if (a<b) {}</script><div>last</div>"""
    items = media.parse(page)
    assert [i["pos"] for i in items] == list(range(6))
    assert [(i["kind"], i["text"] or i["ref"]) for i in items] == [("text", "One & two"), ("text", "Three"), ("media", "sha256:aa"), ("text", "tail"), ("media", "http://x/y.png"), ("text", "last")]
    assert [(i["digest"], i["caption"]) for i in items if i["kind"] == "media"] == [("aa", "First cap"), (None, "alt text")]
    assert media.parse(None) == media.parse("") == []


def test_sequences_resolve_by_digest(spark, sf_dir):
    pages = spark.createDataFrame([(1, '<p>a</p><img src="sha256:d1" alt="x"><p>b</p>'), (1, '<img src="sha256:no">'), (2, None)], "page_id long, html string")
    store = spark.createDataFrame([("d1", b"payload"), ("d1", b"payload"), ("d2", b"other"), (None, b"none")], "digest string, payload binary")
    got = sorted(((r.doc_id, r.pos, r.kind, r.text, r.caption, r.payload) for r in media.resolve(media.sequences(pages), store).collect()), key=str)
    assert got == [(1, 0, "media", None, None, None), (1, 0, "text", "a", None, None), (1, 1, "media", None, "x", bytearray(b"payload")), (1, 2, "text", "b", None, None)]
    real = media.sequences(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()
    assert all(r["items"] for r in real) and len(real) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()


def test_a_text_is_rebuilt_from_its_page(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50).collect():
        lines = [x.strip() for x in r.text.split("\n") if x.strip()]
        assert [i["text"] for i in media.parse(media.page_of(r.text)) if i["kind"] == "text"] == lines
    assert html.unescape("&amp;") == "&"


def test_no_rows(docs):
    assert media.text_media(docs([(1, "x")]).where("false")).count() == 0


def test_hot_digests_and_items_without_one(spark, monkeypatch):
    monkeypatch.setattr(media, "MOST_HOT", 4)
    pages = spark.createDataFrame([(i, f'<p>a{i}</p><img src="sha256:{"hot" if i % 3 else i}" alt="c{i}"><p>b</p><img src="x.png">') for i in range(60)], "page_id long, html string")
    store = spark.createDataFrame([("hot", 1), *[(str(i), 2) for i in range(30)]], "digest string, size int")
    got = {r.doc_id: r["items"] for r in media.rebuild(media.resolve(media.sequences(pages), store)).collect()}
    assert len(got) == 60
    for i, items in got.items():
        assert [(x.pos, x.kind, x.text, x.caption, x.size) for x in items] == [(0, "text", f"a{i}", None, None), (1, "media", None, f"c{i}", 1 if i % 3 else 2 if i < 30 else None), (2, "text", "b", None, None), (3, "media", None, None, None)]


def test_null_and_repeated_ids_each_get_their_row(docs):
    rows = [(None, "a"), (None, "a"), (None, None), (7, "b"), (7, "c"), (7, "c")]
    got = sorted((str(r.doc_id), r.n_bytes, r.payload_sha256) for r in media.text_media(docs(rows)).collect())
    assert got == sorted((str(i), len(x or ""), hashlib.sha256((x or "").encode().ljust(192)).hexdigest()) for i, x in rows)
