import hashlib
import re
import time

import pytest

from kinfold.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def base_spans(text):
    out = []
    for number, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), number, m.end(), kind))
    return sorted(out)


ODD = [
    "a@b.c%d@e.f x@@y.z a@b a@b. .@-.- é@b.co", "1.2.3.4.5.6.7.8 0001.2.3.255 999.1.2.3 1.2.3 00000000000000000255.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111112 4111  1111 1111 1111", "+1 (555) 555-5555 ++12345678901 +1 +1-2 +123456789 +1234567890123456 +1 2 3 4 5 6 7 8 9 0 ",
    "🤖🤖 a@b.co 🤖 1.2.3.4 ü +12345678901", "1" * 30_000 + "x", "1 " * 15_000, "a" * 40_000 + "@", "a." * 20_000 + "@b", "1." * 20_000, "+" * 20_000, "", None,
]


@pytest.fixture(scope="module")
def found(spark, small):
    odd = spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(ODD)], "doc_id bigint, text string")
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(odd)
    return {r.doc_id: r.text or "" for r in docs.collect()}, {r.doc_id: r for r in pii.digests(docs).collect()}


def test_base_spans(found):
    texts, got = found
    assert set(texts) == set(got)
    for n, text in texts.items():
        spans = base_spans(text)
        told = [f"{k}:{a}:{b}" for a, _, b, k in spans]
        assert got[n].base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert [got[n].n_email, got[n].n_ip, got[n].n_card, got[n].n_phone] == [sum(s[3] == k for s in spans) for k in BASE]
        assert set(told) <= set(got[n].spans.split(",")) | ({""} if not told else set())


def test_secrets_are_added(found):
    texts, got = found
    for n, text in texts.items():
        for m in re.finditer(r'token = "([0-9a-f]{40})"', text):
            assert f"secret:{m.start(1)}:{m.end(1)}" in got[n].spans.split(",")


def test_plain_prose_has_no_spans(found):
    texts, got = found
    assert all(not got[n].spans for n, t in texts.items() if not re.search(r"\d", t) and "@" not in t)


def test_generators_and_look_alikes(spark):
    rows = spark.createDataFrame([(1, "call (555) 123-4567 now"), (2, "write to bob.t [at] site [dot] org today"), (3, "commit 3f2a9c3f2a9c3f2a9c3f2a9c3f2a9c3f2a9c1234 is in"), (4, 'api_key: "q7Zk2LmP9xWv4TnB8sRd"')], "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in pii.digests(rows).collect()}
    assert got[1] == "phone:5:19" and got[2].startswith("email:9:") and got[3] == "" and got[4] == "secret:10:30"


def test_long_secrets_are_proposed_whole(spark):
    made = ["q7Zk2LmP9x" * 60, "abcd" * 20 + "1" + "x" * 30, "a" * 40_000, "a1" * 20_000]
    rows = spark.createDataFrame([(k, f'api_key: "{m}" end') for k, m in enumerate(made)], "doc_id bigint, text string")
    got = {r.doc_id: [c.m for c in r.wide if pii.KINDS[c.kind] == "secret"] for r in pii.candidates(rows).collect()}
    assert got == {0: [made[0]], 1: [made[1]], 2: [], 3: [made[3]]}
    assert {r.doc_id: r.redacted for r in pii.redacted(pii.find(rows.where("doc_id = 0"))).collect()} == {0: 'api_key: "[PRIVATE]" end'}


def test_redaction(spark):
    rows = spark.createDataFrame([(1, "x a@b.co y +12345678901."), (2, "plain"), (3, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.redacted for r in pii.redacted(pii.find(rows)).collect()}
    assert got == {1: "x [PRIVATE] y [PRIVATE].", 2: "plain", 3: ""}


def plain_redaction(text, spans):
    out, at = "", 0
    for a, _, b in sorted(spans):
        if a >= at and b > at:
            out += text[at:a] + "[PRIVATE]"
        at = max(at, b)
    return out + text[at:]


def test_redaction_of_long_texts(spark, small):
    made = " 🤖 ".join(f"user{k}@host{k % 7}.org said 10.0.{k % 256}.7 and +1234567{k:05d}" for k in range(3_000))
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10_000, made), (10_001, "ü" * 5_000)], "doc_id bigint, text string"))
    for r in pii.redacted(pii.find(docs)).collect():
        assert r.redacted == plain_redaction(r.text, [(x.start, x.kind, x.end) for x in [*r.base, *r.added]])


def test_many_matches_in_linear_time(spark):
    """100,000 numbers that are candidates or base spans, in seconds."""
    texts = [" ".join(f"{k:06d}-{k % 9999:04d}" for k in range(100_000)), " ".join(f"+1234567{k:05d} a{k}@b.co" for k in range(100_000)), " ".join(f"555 {k % 900 + 100}-{k % 9000 + 1000} x" for k in range(100_000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    start = time.time()
    got = {r.doc_id: r for r in pii.digests(rows).collect()}
    assert time.time() - start < 60
    assert got[1].n_email == got[1].n_phone == 100_000 and got[0].n_email == 0


def test_long_addresses_and_other_kinds(spark):
    name = "n" * 200
    rows = spark.createDataFrame([(1, f"write to {name} [at] {name} [dot] org now"), (2, "login from host 2001:db8:85a3:1f:a2:8a2e:370:7334 ok"), (3, "server 10[.]1[.]2[.]3 is down"), (4, "visa 4111.1111.1111.1111 paid"), (5, "order 4111.1111.1111.1112 sent"), (6, "at 12:30:45 we met at 9:15"), (7, "ratio 16:9 and a::b")], "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in pii.digests(rows).collect()}
    assert got[1].startswith("email:9:") and got[2] == "ip:16:49" and got[3] == "ip:7:21" and got[4] == "card:5:24" and got[5] == got[6] == got[7] == ""


def test_training_repeats(spark):
    assert pii._fitted(spark, 0.995) == pii.train(spark)
