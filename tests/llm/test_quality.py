import zlib

import numpy as np
import pytest

from kinfold.llm import quality


def auc(y, p):
    order = np.argsort(np.argsort(p)) + 1
    good = y.sum()
    return (order[y == 1].sum() - good * (good + 1) / 2) / (good * (len(y) - good))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = {r.doc_id: r for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(r.quality, got[r.doc_id].score) for r in labels.collect() if got[r.doc_id].held_out]
    y, p = np.array(held).T
    assert auc(y, p) > 0.97 and ((p >= 0.3) == y).mean() > 0.95


def test_flat_walk_equals_recursion():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = quality.fit(x, y, trees=12, depth=3)

    def walk(row, at):
        if trees.low[at] == at:
            return trees.value[at]
        return walk(row, trees.low[at] if row[trees.feature[at]] <= trees.limit[at] else trees.high[at])

    want = [1 / (1 + np.exp(-(trees.base + sum(walk(row, t) for t in trees.roots)))) for row in x]
    assert np.allclose(trees.score(x), want) and ((trees.score(x) > 0.5) == y).mean() > 0.9


def naive(x, y, trees, depth, rate, bins, ridge, least):
    """The margin of every row, by trying each split of each feature on the rows themselves."""
    good = (y.sum() + 1) / (len(y) + 2)
    limits = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    margin = np.full(len(y), np.log(good / (1 - good)))

    def grow(rows, step):
        g, h = slope[rows].sum(), bend[rows].sum()
        best = (1e-6, None)
        for f in range(x.shape[1]) if step < depth and h > 2 * least else ():
            for limit in limits[f]:
                low = rows[x[rows, f] <= limit]
                gl, hl = slope[low].sum(), bend[low].sum()
                if hl >= least and h - hl >= least:
                    gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g * g / (h + ridge)
                    if gain > best[0] + 1e-12:
                        best = gain, (f, limit)
        if best[1] is None:
            margin[rows] -= rate * g / (h + ridge)
            return
        f, limit = best[1]
        grow(rows[x[rows, f] <= limit], step + 1)
        grow(rows[x[rows, f] > limit], step + 1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, bend = p - y, p * (1 - p)
        grow(np.arange(len(y)), 0)
    return margin


def test_fit_equals_a_naive_one():
    r = np.random.default_rng(5)
    x = np.column_stack([r.normal(size=300), r.integers(0, 4, 300), r.exponential(size=300)])
    y = ((x[:, 0] + x[:, 2] > 0.8) ^ (r.random(300) < 0.1)).astype(float)
    options = {"trees": 6, "depth": 3, "rate": 0.3, "bins": 12, "ridge": 1.0, "least": 1.0}
    got = quality.fit(x, y, **options).score(x)
    assert np.allclose(got, 1 / (1 + np.exp(-naive(x, y, **options))), atol=1e-9)


def test_the_sample_is_bounded(spark, monkeypatch):
    """A labelled id that very many rows repeat comes to the driver once."""
    docs = spark.range(3_000).selectExpr("id % 3 + 1 as doc_id", "concat('text ', id) as text")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 30)], "doc_id bigint, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(x.shape) or quality.Trees(*([np.zeros(1, np.int64)] * 4), np.zeros(1), np.zeros(0, np.int64), 0.0, 0))
    quality.train(docs, labels)
    assert seen[0][0] <= 3


@pytest.mark.parametrize("y", [[], [1.0, 1.0], [0.0]])
def test_few_labels(y):
    trees = quality.fit(np.zeros((len(y), 3)), np.array(y))
    p = trees.score(np.zeros((2, 3)))
    assert ((0 < p) & (p < 1)).all() and p[0] == p[1]


def test_statistics_of_odd_texts():
    for text in ("", " ", "\n\n", "x" * 200_000, "é🤖", "|" * 50, "a\x00b"):
        row = quality.statistics(text)
        assert len(row) == len(quality.FEATURES) and np.isfinite(row).all()
    assert quality.matrix([]).shape == (0, len(quality.FEATURES))


def test_odd_labels(spark):
    docs = spark.createDataFrame([(k, f"good words number {k}.") for k in range(40)] + [(None, "x"), (7, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(30)] + [(None, 1, 0), (3, None, 0), (4, 5, 0), (2, 1, 0), (999, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == 42 and all(0 <= r.score <= 1 for r in got)
    assert quality.train(docs, labels.limit(0)).score(np.zeros((1, len(quality.FEATURES))))[0] == 0.5


def test_keep_good_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "A text.", "x"), (2, None, "y")], "doc_id bigint, text string, score string")
    kept = quality.keep_good(docs, quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0)))
    assert kept.columns == docs.columns and kept.count() == 2
