import random

import numpy as np
import pytest

from kinfold.llm import minhash
from kinfold.llm.components import components


def sets(texts, words):
    return {i: frozenset(minhash.shingles(t, words).tolist()) for i, t in texts.items()}


def groups(texts, words, percent=80):
    """Smallest id reachable, by comparing all pairs."""
    s = sets(texts, words)
    ids = sorted(s)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(s[a] & s[b])
            if common and 100 * common >= percent * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")


def check(spark, texts, words):
    got = {r.doc_id: r for r in minhash.link(frame(spark, texts), words).collect()}
    want, s = groups(texts, words), sets(texts, words)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(x) for i, x in s.items()}
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_shingles_by_definition():
    words = lambda t, n: len(minhash.shingles(t, n))
    assert words("a b A B a b", 2) == 2 and words("a", 2) == 1 and words("", 2) == words(" \t\x0b", 2) == words(None, 2) == 0
    assert words("a b c", 5) == 1 and words("a b", 2) == 1
    assert (minhash.shingles("A b", 2) == minhash.shingles("a\x0cB", 2)).all() and len(minhash.shingles("É x", 2)) == 1
    assert not np.array_equal(minhash.shingles("É", 2), minhash.shingles("é", 2)) and not np.array_equal(minhash.shingles("a b", 2), minhash.shingles("b a", 2))
    assert words("a\xa0b", 2) == 1 and len(minhash.shingles("a b c d", 2)) == 3


@pytest.mark.parametrize("words", [2, 5])
def test_small_table(spark, small, words):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    check(spark, docs, words)


@pytest.mark.parametrize("listed,block", [(1, 16_000), (10**9, 4_000_000), (200, 4_000_000)])
def test_crowded_group(spark, monkeypatch, listed, block):
    """Near copies around one text, most linked to it, some only to each other or to none; pairs
    from rare members, from blocks, and from both."""
    monkeypatch.setattr(minhash, "PAIRED", 4)
    monkeypatch.setattr(minhash, "LISTED", listed)
    monkeypatch.setattr(minhash, "BLOCK", block)
    r = random.Random(5)
    base = [f"w{k}" for k in range(90)]
    texts = {0: " ".join(base)}
    for k in range(1, 220):
        own = list(base if r.random() < 0.8 else texts[r.randrange(k)].split())
        for _ in range(r.randrange(1, 14)):
            own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
        texts[k] = " ".join(own)
    check(spark, texts, 2)


def test_rare_members_meet():
    """Two similar sets share a member among the first of both, whatever the order."""
    r = np.random.default_rng(3)
    common = r.integers(0, 5, 1 << minhash.SLOT_BITS).astype(np.uint8)
    met = 0
    for _ in range(400):
        both, own = r.integers(0, 1 << 63, r.integers(1, 60), dtype=np.uint64), r.integers(0, 5, 2)
        x, y = (np.unique(np.concatenate([both, r.integers(0, 1 << 63, int(n), dtype=np.uint64)])) for n in own)
        x, y = sorted((x, y), key=len)
        same = len(np.intersect1d(x, y))
        if 100 * same >= 80 * (len(x) + len(y) - same):
            met += 1
            (a, early), (b, _) = minhash.rare(x, common, 80), minhash.rare(y, common, 80)
            assert np.intersect1d(a[:early], b).size
    assert met > 100


def test_template_brings_no_pairs(spark, monkeypatch):
    """Pages of one template, too unlike to link: their rare members are their own, so few meet."""
    base = " ".join(f"t{k}" for k in range(60))
    texts = {k: f"{base} " + " ".join(f"u{k}x{j}" for j in range(25)) for k in range(150)}
    texts |= {1_000 + k: texts[k] + " end" for k in range(10)}
    seen = []
    held = minhash._crowded
    monkeypatch.setattr(minhash, "_crowded", lambda *a: seen.append((out := held(*a))[0].count()) or out)
    check(spark, texts, 2)
    assert seen and seen[0] < 200  # of 12,720


def test_small_sets(spark):
    r = random.Random(6)
    texts = {k: " ".join(r.choice("abcdefgh") for _ in range(r.randrange(0, 9))) for k in range(200)}
    check(spark, texts, 2)


def test_nulls_and_repeats(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "a b c"), (None, None), (4, "A B C")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.link(spark.createDataFrame(rows, "doc_id bigint, text string"), 2).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 2, None, True), (None, 0, None, True), (4, 2, 1, False)], key=repr)
    kept = minhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"), 2).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(1, "a b c"), (2, None), (3, ""), (None, "a b c"), (None, None)], key=repr)


def test_ids_with_several_texts(spark):
    text = lambda c, n=40: " ".join(f"{c}{i}" for i in range(n))
    rows = [(1, text("a")), (1, text("b")), (2, text("a", 41)), (3, text("b", 41)), (0, text("c")), (4, text("c", 41)), (4, text("d")), (5, text("d", 41)), (6, None), (6, text("e")), (7, text("e", 41)), (8, text("f")), (8, text("f", 41)), (8, text("f"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.link(docs, 2).collect())
    assert got == sorted([(1, 39, 1), (1, 39, 1), (2, 40, 1), (3, 40, 1), (0, 39, 0), (4, 40, 0), (4, 39, 4), (5, 40, 4), (6, 0, 6), (6, 39, 6), (7, 40, 6), (8, 39, 8), (8, 40, 8), (8, 39, 8)])
    kept = sorted(((r.doc_id, (r.text or "-")[0]) for r in minhash.keep_one(docs, 2).collect()))
    assert kept == [(0, "c"), (1, "a"), (1, "b"), (4, "d"), (6, "-"), (6, "e"), (8, "f")]


def test_estimate():
    r = np.random.default_rng(0)
    for share in (0.3, 0.8, 0.95):
        errors = []
        for _ in range(60):
            both, n = r.integers(0, 1 << 64, int(600 * share), dtype=np.uint64), int(300 * (1 - share))
            a, b = (np.unique(np.concatenate([both, r.integers(0, 1 << 64, n, dtype=np.uint64)])) for _ in range(2))
            got = minhash.estimate(minhash.registers(a)[None], minhash.registers(b)[None], np.array([len(a)]), np.array([len(b)]))[0]
            errors.append(got - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100 + k, 100) for k in range(1, 30)] + [(201, 200), (202, 201), (200, 202), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), **dict.fromkeys((200, 201, 202), 200)}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
