"""Every query over documents: empty tables, nulls everywhere, long texts, clashing columns."""

import public_tokenizers
import pytest

import corpus_pipeline
from kinfold.llm import ann, bpe, chat, lines, media, minhash, mixing, pii, quality, suffix

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside.
CLASHING = ["key", "id", "row", "drop", "k1", "k2", "anchor", "digest", "at", "kind", "n", "f1", "f2", "sketch", "base", "wide", "added", "ids", "decoded", "score", "size", "target", "copies", "taken", "component_id", "kept", "packed", "spans", "media", "html", "page", "label", "x", "site", "pos", "line", "h1", "h2", "item", "open", "done", "block", "rate", "of"]


def model(spark):
    return quality.train(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))


OPERATORS = {
    "bpe": lambda d: bpe.digests(d, PATH),
    "pii": pii.digests,
    "minhash": minhash.link,
    "suffix": suffix.digests,
    "media": media.digests,
    "lines": lines.digests,
    "mixing": mixing.mixture,
    "quality": lambda d: quality.score(d, model(d.sparkSession)),
}


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (None, None, None, None, None), (None, "a b c", None, None, 5), (2, "", "", "", 0), (3, None, "en", "s", None), (4, "lang " * 30_000, "en", "s", 150_000), (5, "x" * 100_000, "en", "s", 100_000), (6, "\n" * 3_000, "en", "t", 3_000), (7, " \t", "en", None, 2)]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", *(f"'c' as {c}" for c in CLASHING))


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(name, odd):
    got = OPERATORS[name](odd).collect()
    assert len(got) == odd.count()
    assert sorted((r.doc_id for r in got), key=repr) == sorted((r.doc_id for r in odd.select("doc_id").collect()), key=repr)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, spark):
    assert OPERATORS[name](spark.createDataFrame([], DOCS)).count() == 0


def test_empty_conversations(spark):
    got = chat.digests(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).collect()
    assert [r.conv_id for r in got] == [-7]


def test_odd_conversations(spark):
    rows = [(1, 0, "user", "a <b> &"), (1, 0, "user", "a <b> &"), (None, None, None, None), (2, None, "assistant", None), (2, 1, "", ""), (3, 0, "assistant", "long " * 40_000), (-7, 5, "user", "more")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", *(f"'c' as {c}" for c in [*CLASHING, "conv", "body", "shown", "head", "start", "number", "span", "formatted", "turns", "loss", "parts", "attached"]))
    got = {r.conv_id: r for r in chat.digests(turns).collect()}
    assert {n: r.n_turns for n, r in got.items()} == {1: 2, None: 1, 2: 2, 3: 1, -7: 3}
    assert got[3].loss_chars == 200_000 and got[2].loss_chars == 0


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, None), (2, [None, 1.0]), (3, [nan, 0.0]), (4, [0.0, 0.0]), (None, [1.0, 1.0]), (5, [0.5, 0.5]), (6, [0.5, 0.5]), (20, [1.0] * 3_000), (40, [1.0] * 3_000), (7, [])]
    names = [c for c in CLASHING if c != "id"]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", *(f"'c' as {c}" for c in [*names, "id", "v", "region", "sub", "salt", "told", "floor", "hits", "rank", "place", "copy"]))
    got = sorted(map(tuple, ann.nearest(table).collect()))
    assert got == [(0, 1, 5, 0.5), (0, 2, 6, 0.5), (20, 1, 40, 3_000.0), (40, 1, 20, 3_000.0)]


def test_repeated_rows_everywhere(spark):
    """A table in which a third of all rows is one row."""
    docs = spark.range(900).selectExpr("if(id % 3 = 0, 1, id) as doc_id", "if(id % 3 = 0, 'the same words in every copy of one text', concat('own words ', id)) as text", "'en' as lang", "concat('s', id % 3) as source", "0L as n_chars")
    for name in ("minhash", "suffix", "mixing", "quality", "lines", "media"):
        assert OPERATORS[name](docs).count() == 900


@pytest.fixture
def labels(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stage_on_odd_rows(k, spark, odd, labels):
    got = corpus_pipeline.STAGES[k][1](spark, odd, labels)
    if k < len(corpus_pipeline.STAGES) - 1:
        assert got.columns == odd.columns
    got.collect()


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stage_on_empty_table(k, spark, labels):
    assert corpus_pipeline.STAGES[k][1](spark, spark.createDataFrame([], DOCS), labels).count() == 0
