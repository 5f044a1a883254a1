import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from kinfold.llm import suffix


def brute(texts, length=200):
    places = defaultdict(list)
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            places[t[p : p + length]].append((i, p))
    covered = [np.zeros(len(t), bool) for t in texts]
    for at in places.values():
        if len(at) > 1:
            for i, p in at:
                covered[i][p : p + length] = True
    out = []
    for t, c in zip(texts, covered, strict=True):
        spans = int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum())
        out.append((len(t), int(c.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~c].tobytes()).hexdigest()))
    return out


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute([(t or "").encode() for _, t in rows])
    got = Counter(tuple(r) for r in suffix.digests(docs, **options).collect())
    assert got == Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))


def passages(seed, count, alphabet="abcdefghij é"):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    shared = [text(r.randrange(150, 420)) for _ in range(6)]
    rows = []
    for k in range(count):
        parts = [text(r.randrange(0, 300))]
        for _ in range(r.randrange(3)):
            p = r.choice(shared)
            a = r.randrange(0, 60)
            parts += [p[a : a + r.randrange(100, 420)], text(r.randrange(0, 120))]
        rows.append((k, "".join(parts)))
    return rows


def test_passages(spark):
    check(spark, passages(1, 120))


@pytest.mark.parametrize("crowd", [1, 3, 20])
def test_crowded_anchors(spark, crowd):
    """Buckets of more than a few runs are split, down to single windows."""
    r = random.Random(8)
    common = "".join(r.choice("abcdef") for _ in range(260))
    edges = [(300 + k, "".join(r.choice("uvw") for _ in range(30 + k % 40)) + common[k % 3 :] + "".join(r.choice("xyz") for _ in range(k % 50))) for k in range(40)]
    check(spark, passages(1, 60) + edges + edges[:3] + [(200 + k, f"{k}" + "passage " * 30 + f"{k % 3}") for k in range(12)], crowd=crowd)


def test_equal_hashes_are_compared(spark):
    texts = pa.array(["x" * 250, "x" * 249 + "y", "x" * 250])
    one, group = np.array([0, 1, 2]), np.zeros(3, np.int64)
    same = suffix._verified(texts, one, np.zeros(3, np.int64), np.full(3, 51), group, np.zeros(1, np.int64))
    assert same.tolist() == [True, False, True]
    sliced = suffix._verified(texts.slice(1), one[:2], np.zeros(2, np.int64), np.full(2, 51), group[:2], np.zeros(1, np.int64))
    assert sliced.tolist() == [True, False]


def test_periodic_and_low_variety(spark):
    check(spark, [(1, "ab" * 400), (2, "b" + "ab" * 150), (3, "a" * 1_000), (4, "a" * 199), (5, "a" * 200), (6, "abc" * 90 + "x" * 210), *passages(2, 20, "ab")])


def test_within_one_text(spark):
    one = "".join(random.Random(3).choice("abcdef") for _ in range(500))
    check(spark, [(1, one + "#" + one[100:400] + "#" + one[300:]), (2, "other" * 20)])


def test_nulls_repeats_and_edges(spark):
    same = "".join(random.Random(4).choice("abcdef") for _ in range(201))
    check(spark, [(1, None), (2, ""), (3, same), (3, same), (None, same[:200]), (None, "é" * 100), (4, "é" * 100), (5, "é" * 99 + "x")])


def test_small_chunks_and_blocks(spark, monkeypatch):
    """Texts longer than a chunk are cut into pieces; workers of a local session don't see the
    patch, so the functions are called as Spark would."""
    monkeypatch.setattr(suffix, "CHUNK", 1_000)
    rows = passages(5, 40) + [(100, "".join(random.Random(6).choice("abcdef") for _ in range(4_000)))]
    rows.append((101, rows[-1][1][1_500:3_700]))
    texts = [t.encode() for _, t in rows]
    key, anchor, digest, first, count, offset = suffix._all_runs(list(range(len(texts))), texts)
    windows = Counter(zip(key.repeat(count), np.concatenate([f + np.arange(c) for f, c in zip(first, count)]), strict=True))
    assert windows == Counter((i, p) for i, t in enumerate(texts) for p in range(len(t) - 199))
    run, window, _ = suffix.sort_block(anchor, offset, count, [texts[k][f : f + c + 199] for k, f, c in zip(key, first, count)])
    got = {(int(key[r]), int(first[r] + w)) for r, w in zip(run, window, strict=True)}
    places = defaultdict(list)
    for i, t in enumerate(texts):
        for p in range(len(t) - 199):
            places[t[p : p + 200]].append((i, p))
    assert got == {x for at in places.values() if len(at) > 1 for x in at}


def test_the_cover_is_one():
    differences = {(a - b) % suffix.COVER_MOD for a in suffix.COVER for b in suffix.COVER}
    assert differences == set(range(suffix.COVER_MOD)) and suffix._TO_COVER.max() < 8


def test_joined_ranges():
    key, first, last = suffix._joined(np.array([1, 2, 1, 1, 2]), np.array([5, 0, 0, 3, 2]), np.array([9, 0, 3, 4, 7]))
    assert list(zip(key, first, last)) == [(1, 0, 9), (2, 0, 0), (2, 2, 7)]
