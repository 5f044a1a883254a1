from collections import defaultdict

import pytest

from kinfold.llm import lines


def brute(rows, sites):
    """doc_id, text, site to (doc_id, lines, removed, kept text)."""
    at, keeper = defaultdict(set), {}
    for i, text, site in rows:
        for x in (text or "").split("\n"):
            if x:
                at[x].add(site)
                if i is not None:
                    keeper[x] = min(keeper.get(x, i), i)
    out = []
    for i, text, _ in rows:
        seen, kept = set(), []
        own = (text or "").split("\n")
        for x in own:
            if not x or len(at[x]) < sites or (i is not None and i == keeper.get(x) and x not in seen):
                kept.append(x)
            seen.add(x)
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def check(spark, rows, sites):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = [(r.doc_id, r.n_lines, r.n_removed, r.text) for r in lines.dedup_lines(docs, sites).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, sites), key=repr)


@pytest.mark.parametrize("sites", [1, 2, 3, 10])
def test_small_fixture(spark, sites):
    rows = [(k, f"own {k}\ncommon\n\nrare {k % 4}\ncommon\n" + "twice\ntwice" * (k % 3 == 0), f"s{k % 12}") for k in range(40)]
    rows += [(100, None, "s1"), (101, "", None), (102, "common", None), (None, "common\nrare 1", "s2"), (5, rows[5][1], rows[5][2])]
    check(spark, rows, sites)


def test_many_sites(spark):
    """Counts at, just below and far above the threshold, past what a sketch holds exactly."""
    rows = [(n * 1_000 + k, f"line {n}\nmine {n} {k}", f"site {k}") for n, count in enumerate((299, 300, 301, 150, 600)) for k in range(count)]
    check(spark, rows, 300)


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check(spark, [(r.doc_id, r.text, r.source) for r in docs.collect()], 5)


def test_rewriting_keeps_rows_and_columns(spark):
    rows = [(k, None if k == 3 else f"common\nown {k}", f"s{k}", 7, "x", "y") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint, drop string, k1 string")
    got = {r.doc_id: r for r in lines.rewrite(docs).collect()}
    assert lines.rewrite(docs).columns == docs.columns and len(got) == 12
    assert got[0].text == "common\nown 0" and got[0].n_chars == 7 and got[5].text == "own 5" and got[5].n_chars == 5 and got[3].text is None and got[5].drop == "x"


def test_very_many_lines_to_remove(spark):
    """Texts of 40,000 lines that lose nearly all of them take seconds."""
    rows = [(i, "\n".join([f"line {k}" for k in range(40_000)] + [f"own {i}", ""]), f"s{i}") for i in range(4)]
    check(spark, rows, 3)
