import numpy as np
import pytest

from kinfold.llm import ann


def brute(vectors, every, k):
    """{query: [(id, score)]} over vectors {id: array}."""
    out = {}
    for q, v in vectors.items():
        if q % every == 0:
            scored = [(-float(np.dot(v, w)), i) for i, w in vectors.items() if i != q and len(w) == len(v)]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def collected(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def frame(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in vectors.items()], "vec_id bigint, embedding array<float>, label int")


def float32(vectors):
    return {i: np.asarray(v, np.float32).astype(float) for i, v in vectors.items()}


@pytest.mark.parametrize("shard,leaf,queries", [(16_384, 512, 65_536), (60, 10, 7), (25, 4, 3), (100, 200, 5)])
def test_exact_at_factor_one(spark, shard, leaf, queries):
    """One shard, several regions of several shards each, and shards in several copies."""
    r = np.random.default_rng(2)
    vectors = float32({int(i): r.normal(size=8) * r.exponential() for i in range(0, 1_800, 3)})
    got = collected(ann.nearest(frame(spark, vectors), every=20, factor=1.0, shard_rows=shard, leaf=leaf, sample_rows=200, query_rows=queries))
    want = brute(vectors, 20, 20)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12) for q in want)


def clustered(seed, count, size=16):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(40, size))
    return centres[r.integers(0, 40, count)] + 0.15 * r.normal(size=(count, size))


def searched(x, q, k, factor, leaf=64, floor=None):
    top = np.sqrt((x * x).sum(1).max()) * (1 + 1e-12)
    tree = ann.VpTree(ann.added(x, top), leaf)
    floor = np.full(len(q), -np.inf) if floor is None else floor
    return tree, ann.Search(tree.nodes, x[tree.order], tree.order, q, floor, k, factor, top)


@pytest.mark.parametrize("factor,leaf", [(1.0, 64), (1.0, 512), (3.0, 512)])
def test_tree_against_all(factor, leaf):
    x = clustered(3, 6_000)
    tree, s = searched(x, x[:200], 10, factor, leaf)
    want = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    recall = np.mean([len(set(s.found[k]) & set(want[k])) / 10 for k in range(200)])
    assert recall == 1 if factor == 1 else recall >= 0.9
    assert (tree.nodes[:, 5] >= 0).sum() >= 6_000 // leaf // 2


def test_pruning_leaves_parts_out():
    r = np.random.default_rng(4)
    x = np.repeat(np.eye(16)[:8] * 5, 700, axis=0) + 0.01 * r.normal(size=(5_600, 16))
    _, s = searched(x, x[:20], 5, 1.0, 128)
    assert s.pruned and s.scanned < 20 * 5_600 * 0.6
    best = np.sort(x[:20] @ x.T, axis=1)[:, -5]
    _, known = searched(x, x[:20], 5, 1.0, 128, floor=best)
    assert known.scanned <= s.scanned and (known.found == s.found).all()


def test_regions_prune_whole_shards(spark):
    """Clusters that lie apart: a query visits few of the shards, and finds what brute force finds."""
    r = np.random.default_rng(8)
    x = 20 * np.repeat(np.eye(8), 300, axis=0) + r.normal(size=(2_400, 8)) * 0.5
    x /= np.linalg.norm(x, axis=1)[:, None]
    vectors = float32(dict(enumerate(x)))
    held, visits = ann._admitted, []

    def watched(*args):
        out = held(*args)
        visits.append(out.count())
        return out

    ann._admitted = watched
    try:
        got = collected(ann.nearest(frame(spark, vectors), shard_rows=300, leaf=32, sample_rows=600))
    finally:
        ann._admitted = held
    want = brute(vectors, 20, 20)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert visits[0] <= 4 * len(want)  # of eight regions


def test_many_copies_of_one_vector(spark):
    vectors = float32({i: [3.0, 1.0] if i % 3 else [i / 100, 1.0] for i in range(600)})
    got, want = collected(ann.nearest(frame(spark, vectors), shard_rows=50, leaf=8, query_rows=4)), brute(vectors, 20, 20)
    assert got == want


def test_ties_and_equal_vectors(spark):
    vectors = float32({i: [1.0, 0.0] if i % 3 else [0.0, 1.0] for i in range(120)})
    got, want = collected(ann.nearest(frame(spark, vectors))), brute(vectors, 20, 20)
    assert got == want


def test_recall_on_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    vectors = {r.vec_id: np.array(r.embedding, float) for r in rows.collect()}
    got, want = collected(ann.nearest(rows, shard_rows=100, leaf=16)), brute(vectors, 20, 20)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    fifty = collected(ann.nearest(rows, every=50, shard_rows=100, leaf=16))
    assert np.mean([len({i for i, _ in fifty[q]} & {i for i, _ in v}) / 20 for q, v in brute(vectors, 50, 20).items()]) >= 0.9


def test_recall_with_varying_norms(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(6_000, 8))
    x *= r.gamma(3, size=(6_000, 1)) / np.linalg.norm(x, axis=1)[:, None]
    vectors = float32(dict(enumerate(x)))
    got, want = collected(ann.nearest(frame(spark, vectors))), brute(vectors, 20, 20)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [0.5, 0.5]), (40, [0.0, 0.0])]
    got = collected(ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")))
    assert got == {0: [(1, 0.5), (20, 0.0)], 20: [(1, 0.5), (0, 0.0)]}


def test_empty(spark):
    assert ann.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [1.0])], "vec_id bigint, embedding array<float>")).count() == 0
