import hashlib
import re
import zlib
from collections import Counter
from html import unescape

import pytest
from hypothesis import given
from hypothesis import strategies as st

from kinfold.llm import media


@given(raw=st.binary(max_size=1_000))
def test_image_round_trip(raw):
    payload = media.padded(raw)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload[: len(raw)] == raw and not any(payload[len(raw) :]) and len(payload) - len(raw) <= 64
    assert media.read_image(media.store_image(payload)) == payload


def test_damage_is_noticed():
    stored = bytearray(media.store_image(bytes(64)))
    stored[45] ^= 1
    with pytest.raises(ValueError):
        media.read_image(bytes(stored))
    with pytest.raises(ValueError):
        media.read_image(b"GIF89a")


def test_parsing():
    html = '<html><head><title>no</title></head><body><p>One <b>two</b></p><script>x("<p>")</script><figure><img src="a.png" alt="alt"><figcaption>A <i>cat</i></figcaption></figure>after<img src="b.png" alt="B"><video src="v.mp4"></video><p>&amp; end'
    got = [(p["position"], p["kind"], p["text"], p["ref"], p["caption"]) for p in media.parse(html)]
    assert got == [(0, "text", "One two", None, None), (1, "image", None, "a.png", "A cat"), (2, "text", "after", None, None), (3, "image", None, "b.png", "B"), (4, "video", None, "v.mp4", None), (5, "text", "& end", None, None)]
    assert media.parse(None) == media.parse("") == []


@given(html=st.text(st.sampled_from("<>/=\"' abimgpfcto!-&;\n"), max_size=60))
def test_any_html_parses(html):
    parts = media.parse(html)
    assert [p["position"] for p in parts] == list(range(len(parts)))


def shown(html):
    """What of a page is text, by plain replacement: without blanks, as they part differently."""
    body = re.sub(r"(?s)<(script|style|head)\b.*?</\1>|<!--.*?-->|<!DOCTYPE[^>]*>", "", html)
    return re.sub(r"\s", "", unescape(re.sub(r"<[^>]*>", "", body)))


@pytest.mark.parametrize(
    "html, want",
    [
        ("<html><head><title>t</title><body>one<p>two", ["one", "two"]),
        ("<head><meta a=b><p>one<script>x</script> two", ["one two"]),
        ("<head><title>t</title></script></style></head>one", ["one"]),
        ("one</head></script>two<script>x</script>three", ["onetwothree"]),
        ("<head><noscript><p>x</p></noscript><title>t</title></head><p>one", ["one"]),
    ],
)
def test_hidden_elements(html, want):
    """A head may lack its end tag, and an end tag its element."""
    assert [p["text"] for p in media.parse(html)] == want


def test_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = media.sequences(pages).collect()
    rows = pages.collect()
    assert Counter(r.page_id for r in got) == Counter(r.page_id for r in rows) and all(p.text for r in got for p in r.parts if p.kind == "text")
    texts = {r.page_id: re.sub(r"\s", "", "".join(p.text for p in r.parts if p.kind == "text")) for r in got}
    assert texts == {r.page_id: shown(r.html) for r in rows}
    want = {}
    for r in rows:
        parts = media.parse(r.html)
        want[r.page_id] = (len(parts), sum(p["kind"] != "text" for p in parts), hashlib.sha256("".join(f"{p[c] or ''}\n" for p in parts for c in ("kind", "text", "ref", "caption")).encode()).hexdigest())
    assert {r.page_id: (r.n_parts, r.n_media, r.parts_sha256) for r in media.page_digests(pages).collect()} == want


def test_interleaved_pages(spark):
    """Texts and media in turn, shared, unresolved and foreign references, repeated rows."""
    texts = ["one", "two", "x" * 300]
    refs = [media.SCHEME + hashlib.sha256(media.padded(t.encode())).hexdigest() for t in texts]
    store = media.text_store(spark.createDataFrame([(t,) for t in texts], "text string"))
    html = f'a<img src="{refs[0]}" alt="first">b<figure><img src="{refs[1]}"><figcaption>second</figcaption></figure><img src="{media.SCHEME}00"><img src="z.png">c<img src="{refs[0]}">'
    pages = spark.createDataFrame([(1, html), (1, html), (None, html), (2, f'<img src="{refs[2]}">'), (3, "only text"), (4, None)], "page_id bigint, html string")
    got = media.assembled(media.sequences(pages), store).collect()
    assert Counter(r.page_id for r in got) == Counter([1, 1, None, 2, 3, 4])
    payload = {t: media.store_image(media.padded(t.encode())) for t in texts}
    want = [("a", None, None), (None, "first", payload["one"]), ("b", None, None), (None, "second", payload["two"]), (None, None, None), (None, None, None), ("c", None, None), (None, None, payload["one"])]
    for r in got:
        assert [p.position for p in r.parts] == list(range(len(r.parts)))
        told = [(p.text, p.caption, None if p.media is None else bytes(p.media)) for p in r.parts]
        assert told == (want if r.page_id in (1, None) else {2: [(None, None, payload[texts[2]])], 3: [("only text", None, None)], 4: []}[r.page_id])
    assert media.told(None) == (None,) * 6


def test_digests(spark, small):
    odd = spark.createDataFrame([(None, "x"), (1, None), (1, None), (9_000, "x" * 64), (9_001, "x"), (9_002, "é" * 3_000)], "doc_id bigint, text string")
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(odd)
    want = Counter()
    for r in docs.collect():
        raw = (r.text or "").encode()
        p = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want[(r.doc_id, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))] += 1
    rows = media.digests(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    same = {}
    for r in rows:
        assert same.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
        assert r.caption == f"text of {r.n_bytes} bytes"
    for r, text in [(r, t) for r in rows for i, t in [(x.doc_id, x.text) for x in odd.collect()] if r.doc_id == i and i and i >= 9_000]:
        assert (r.position, r.n_parts) == (1, 2), text
    lined = media.digests(spark.createDataFrame([(1, "a\n\nb <i>\nc &amp; d\ne")], "doc_id bigint, text string")).first()
    assert (lined.position, lined.n_parts) == (2, 5)
