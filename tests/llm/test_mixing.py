import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kinfold.llm import mixing


def wanted(sizes):
    """Targets by sharing the excess again until none is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(capped.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return capped | {s: level * weight[s] for s in free}
        capped |= {s: 3.0 * sizes[s] for s in over}


def check(spark, rows, seed=0, near=None):
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    got = mixing.mix(docs, seed).collect()
    assert sorted((r.doc_id, r.source, r.size) for r in got) == sorted(rows) if all(r[0] is not None and r[1] is not None for r in rows) else len(got) == len(rows)
    sizes, docs_of, taken = defaultdict(int), defaultdict(list), defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
        docs_of[s].append(n)
    target = wanted(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        share = r.target / r.source_size if r.source_size else 0
        assert r.copies in (int(share), -int(-share // 1)) or r.size == 0 and r.copies == 0
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(docs_of[s])
    return got


def made(seed, sources, count):
    r = random.Random(seed)
    return [(k, f"s{r.randrange(sources)}" if r.random() < 0.7 else "s0", int(r.lognormvariate(4, 1.2))) for k in range(count)]


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_bounds(spark, seed):
    check(spark, made(seed, 4 + seed * 5, 500), seed)


def test_sources_of_equal_size(spark):
    check(spark, [(s * 10 + k, f"s{s}", 20 + k) for s in range(7) for k in range(10)])


def test_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    check(spark, made(9, 5, 900))


def test_nulls_zero_sizes_and_repeats(spark):
    rows = [(1, "a", 5), (1, "a", 5), (None, "a", 7), (2, None, 3), (3, None, 0), (4, "z", 0), (5, "", 4), (6, "é", 9), (7, "Z", 2)]
    got = check(spark, rows)
    assert {r.taken for r in got if r.source == "z"} == {0}


def test_empty_and_single(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id bigint, source string, size bigint")).count() == 0
    assert [r.taken for r in check(spark, [(1, "a", 10)])] == [10]


def test_reruns_agree_however_rows_lie(spark):
    docs = spark.createDataFrame(made(4, 6, 400), "doc_id bigint, source string, size bigint")
    runs = [sorted((r.doc_id, r.copies) for r in mixing.mix(d).collect()) for d in (docs, docs.repartition(7), docs.coalesce(1))]
    assert runs[0] == runs[1] == runs[2]


def test_expectation_is_kept(spark, monkeypatch):
    """Over many sources of like documents a document is taken as often as its share says,
    whether or not the last block makes good what the last rounding costs."""
    count, docs_each = 1_500, 40
    sizes = [20 + 7 * k for k in range(docs_each)]
    rows = [(n * docs_each + k, f"s{n:05d}", size) for n in range(count) for k, size in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")

    def shift():
        total = defaultdict(float)
        for r in mixing.mix(docs).collect():
            if int(r.source[1:]) % 3 == 0:  # sources of one weight, half of whose words are asked for
                total[r.doc_id % docs_each] += r.copies - r.target / r.source_size
        return [total[k] / (count // 3) for k in range(docs_each)]

    settled = shift()
    monkeypatch.setattr(mixing, "_settled", lambda seed: F.concat("done", F.array(F.struct(F.col("open").alias("item"), (mixing.uniform("open.doc_id", "open.size", F.lit(seed * 1000 + 999)) < F.col("open.p")).cast("int").alias("up")))))
    plain = shift()
    error = 4 * 0.5 / (count // 3) ** 0.5  # four standard errors
    assert max(map(abs, plain)) < error and max(map(abs, settled)) < error


def test_equal_rows_share_blocks_with_none(spark):
    """Very many rows of one id and size, null included, are one item with a count."""
    rows = spark.range(60_000).selectExpr("if(id % 2 = 0, null, 7L) as doc_id", "if(id % 4 < 3, 'a', 'b') as source", "10L as size")
    got = mixing.mix(rows).groupBy("source", "source_size", "target").agg(F.sum("taken").alias("taken"), F.count("*").alias("n"), F.max("copies").alias("most")).collect()
    assert sorted((r.source, r.n) for r in got) == [("a", 45_000), ("b", 15_000)]
    assert all(abs(r.taken - r.target) <= 10 and r.most <= 3 for r in got)


def test_sizes(spark):
    rows = spark.createDataFrame([(1, "a b\tc\n\x0bd\x0c\re", "s"), (2, " ", "s"), (3, None, "s"), (4, "a\xa0b é", None)], "doc_id bigint, text string, source string")
    assert {r.doc_id: r.size for r in mixing.sizes(rows).collect()} == {1: 5, 2: 0, 3: 0, 4: 2}


def test_mixed_repeats_rows(spark):
    rows = [(k, "w " * (k % 9 + 1), "abc"[k % 3]) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 as row", "2 as key")
    copies = {r.doc_id: 0 for r in docs.collect()}
    for r in mixing.mixed(docs).collect():
        copies[r.doc_id] += 1
    assert mixing.mixed(docs).columns == docs.columns and max(copies.values()) <= 3 and sum(copies.values()) > 0


def test_mixed_counts_repeated_rows(spark):
    rows = [(k if k % 2 else None, f"w{k} " * (k % 9 + 1), "abc"[k % 3]) for k in range(60)]
    rows += [r for r in rows if r[2] == "a"] * 5
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(text.split())
    for r in mixing.mixed(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect():
        taken[r.source] += len(r.text.split())
    assert all(abs(taken[s] - t) <= 6 * 9 for s, t in wanted(sizes).items())
