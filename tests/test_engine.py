"""Definitions, transforms, learning, signatures, the index, vectors and the encoder on fixtures."""

import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold import cli
from kinfold.functions import codecs, gauss, transforms, vectors
from kinfold.operators import encoder as enc
from kinfold.operators import lineage, signature
from kinfold.operators import index as idx
from kinfold.operators.signature import sign, sums
from kinfold.operators.vocabulary import Vocabulary, learn
from kinfold.plans import protocols
from kinfold.plans.catalogue import GOLDEN, GOLDEN_PROBE, NAMES
from kinfold.plans.definitions import FieldDef, SchemaDef, SourceDef, Transform
from kinfold.sources import delimited
from kinfold.streaming.indexing import index_stream

SPLITS = {
    "ST CLAIR": ["ST CLAIR"], "ST CLAIR-JONES": ["ST CLAIR", "JONES"], "DEL RAY": ["DEL RAY"], "DUFF HESTER": ["DUFF", "HESTER"],
    "ROSADO DE GRACIA": ["ROSADO", "DE GRACIA"], "CONNOLLY-MC LEISH": ["CONNOLLY", "MC LEISH"], "DU BRUCQ": ["DU BRUCQ"],
    "VAN NUYS- CRUZ": ["VAN NUYS", "CRUZ"], "OSBORNE - BARTON": ["OSBORNE", "BARTON"], "SAINT VIL-COACHY": ["SAINT VIL", "COACHY"],
    "SIMO D' OLEO": ["SIMO", "D' OLEO"], "DE LA RENTA": ["DE LA RENTA"], "DEL-PILAR": ["DEL PILAR"], "MARIA DE": ["MARIA"], "DE LA": [], "": [],
}


def apply(spark, name, arguments, *texts):
    step = transforms.build(name, arguments)
    rows = spark.createDataFrame([(list(texts),)], "t array<string>")
    return rows.select(step(F.col("t")).alias("r")).first().r


# definitions


def test_definitions_round_trip():
    text = json.dumps({"hash_count": 2048, "chunk_size": 16, "fields": [{"comment": "c", "attrs": ["name"], "transforms": [{"function": "substr", "arguments": {"begin": 0, "end": 3}}, {"function": "upcase"}]}]})
    schema = SchemaDef.from_json(text)
    assert schema.hash_count == 2048 and schema.chunks == 128 and schema.fields[0].comment == "c"
    assert json.loads(schema.to_json()) == json.loads(text)
    assert list(Transform("substr", {"begin": 0, "end": 3}).to_dict()) == ["function", "arguments"]
    assert Transform("upcase").to_dict() == {"function": "upcase"}
    source = SourceDef.from_json('{"fields": [{"name": "count", "column": 3}, {"name": "fruit", "column": 2}], "id_column": 1, "delimiter": ",", "concurrent": 2}')
    assert source.columns == {"count": 3, "fruit": 2} and SourceDef.from_json(source.to_json()) == source


@pytest.mark.parametrize("bad", [lambda: Transform("no such"), lambda: Transform("substr", {"begin": 1}), lambda: Transform("substr", {"begin": "a", "end": 2}), lambda: Transform("substr", {"begin": True, "end": 2}), lambda: Transform("killafter", {}), lambda: Transform("killafter", {"sep": 1}), lambda: SchemaDef(4, 8, (FieldDef(("a",)),)), lambda: SchemaDef(64, 33, (FieldDef(("a",)),)), lambda: SchemaDef(8, 8, ()), lambda: SourceDef({"a": 1}, delimiter=";;"), lambda: SourceDef({"a": 0}), lambda: SourceDef.from_json('{"fields": [{"name": "a", "column": 1}, {"name": "a", "column": 2}]}')])
def test_bad_definitions_raise(bad):
    with pytest.raises(ValueError):
        bad()


# sources


def write(folder, **files):
    for name, text in files.items():
        (folder / name).write_text(text)
    return f"{folder}/*"


FRUIT = SourceDef({"count": 3, "fruit": 2})


def test_fruit_files(spark, tmp_path):
    glob = write(tmp_path, a="\n132794898,APPLE,1\n4291953712,APPLE,\n2919886652,,1\n1637706266,ORANGE,2\n", b="\n2706566389,BANANA,4\n4188369442,PEAR,3\n3153444041,APRICOT,3\n", c="\n234594352,ORANGE,3\n")
    got = delimited.read(spark, FRUIT, glob).collect()
    assert len(got) == 8 and max(r.id for r in got) == 4291953712
    assert sorted(r.fruit for r in got) == ["", "APPLE", "APPLE", "APRICOT", "BANANA", "ORANGE", "ORANGE", "PEAR"]
    assert sorted(r["count"] for r in got) == ["", "1", "1", "2", "3", "3", "3", "4"]


def test_quotes_and_delimiters(spark, tmp_path):
    got = delimited.read(spark, SourceDef({"a": 1, "b": 3}, id_column=2, delimiter="|"), write(tmp_path, a='"x ""y"" |z"|7|"two\nlines"\n')).first()
    assert (got.id, got.a, got.b) == (7, 'x "y" |z', "two\nlines")


@pytest.mark.parametrize("text", ["x,a,1\n", "-1,a,1\n", " 1,a,1\n", "4294967296,a,1\n", "99999999999999999999999,a,1\n", ",a,1\n", "1,a,1\n2,b\n", "1,a,1\n2,b,1,4\n"])
def test_bad_rows_raise(spark, tmp_path, text):
    with pytest.raises(Exception):
        delimited.read(spark, FRUIT, write(tmp_path, a=text)).select("id").collect()


LINES = {
    "plain": ('1,a,b\n2,"x, ""y"" z",\n\n3,"",""\r\n4,"""",e', True),
    "line end in a cell": ('1,"a\nb",c\n', False),
    "quotes in pairs around a line end": ('1,"a"",b\n""c",d\n', False),
    "a bare quote": ('1,a"b,c\n', False),
    "a line of blanks": ("1,a,b\n  \n", False),
    "a carriage return": ("1,a\rb,c\n", False),
    "many doubled quotes": ('1,"' + '""' * 20_000 + '",' + "x" * 100_000 + "\n", True),
    "nothing": ("", True),
}


@pytest.mark.parametrize("name", LINES)
def test_lines_that_are_rows(spark, tmp_path, name):
    text, want = LINES[name]
    glob = write(tmp_path, a=text)
    assert delimited.one_line_rows(spark, FRUIT, glob) == want
    if want and text:
        assert delimited.read(spark, FRUIT, glob).collect() == delimited.read(spark, FRUIT, glob, multi_line=True).collect()


@pytest.mark.parametrize("mark", ["|", "\t", ".", "\\"])
def test_lines_by_delimiter(spark, tmp_path, mark):
    source = SourceDef({"a": 2}, delimiter=mark)
    assert delimited.one_line_rows(spark, source, write(tmp_path, a=f'1{mark}"x{mark}y"\n'))
    assert not delimited.one_line_rows(spark, source, write(tmp_path, a='1;"x"\n'))


def test_files_without_line_ends_in_cells_are_split(spark, tmp_path):
    glob = write(tmp_path, a="".join(f"{k},name {k},3\n" for k in range(50_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        split, whole = (delimited.read(spark, FRUIT, glob, multi_line=m) for m in (None, True))
        assert split.rdd.getNumPartitions() > 4 and whole.rdd.getNumPartitions() == 1
        assert split.agg(F.sum("id"), F.count("*")).first() == whole.agg(F.sum("id"), F.count("*")).first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_missing_column_raises(spark, tmp_path):
    with pytest.raises(ValueError):
        delimited.read(spark, SourceDef({"a": 5}), write(tmp_path, a="1,2\n"))


# transforms


@pytest.mark.parametrize("name", NAMES)
def test_split(spark, name):
    assert apply(spark, "split", {}, name) == SPLITS[name]


def test_transforms(spark):
    assert apply(spark, "substr", {"begin": 0, "end": 3}, "apple", "ab", "") == ["app", "ab", ""]
    assert apply(spark, "substr", {"begin": 1.9, "end": 3.2}, "apple") == ["pp"]
    assert apply(spark, "substr", {"begin": 3, "end": 1}, "apple") == [""]
    assert apply(spark, "upcase", {}, "abÉé") == ["ABÉÉ"]
    assert apply(spark, "trim", {}, "\t\n\x85\xa0 a b　\x0c") == ["a b"]
    assert apply(spark, "killafter", {"sep": "-"}, "ab-c-d", "abc") == ["ab", "abc"]
    assert apply(spark, "killafter", {"sep": ""}, "abc") == [""]
    assert apply(spark, "split", {}, "A B", "C") == ["A", "B", "C"]


def test_strict_substr_raises(spark):
    with pytest.raises(Exception, match="too short"):
        apply(spark, "substr", {"begin": 0, "end": 3, "strict": True}, "ab")
    assert apply(spark, "substr", {"begin": 0, "end": 3, "strict": True}, "abc") == ["abc"]


def test_registering(spark):
    transforms.register("twice", lambda _: lambda t: F.transform(t, lambda x: F.concat(x, x)))
    try:
        assert apply(spark, "twice", {}, "ab") == ["abab"]
    finally:
        del transforms.REGISTRY["twice"]


def test_joined_attributes(spark):
    rows = spark.createDataFrame([("x", None)], "a string, b string")
    assert rows.select(transforms.joined(("a", "b", "none"), rows.columns).alias("r")).first().r == "x"


# learning


ANIMALS = [(1, "apple", "dog"), (2, "orange", "cat"), (3, "banana", "mouse"), (4, "apple", "cat"), (5, "pear", "bird")]
ANIMAL_SCHEMA = SchemaDef(2048, 12, (FieldDef(("name",), (Transform("upcase"),)), FieldDef(("animal",), (Transform("upcase"),))))


def one_field(spark, texts, hashes=16, width=4, steps=()):
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    return rows, SchemaDef(hashes, width, (FieldDef(("t",), steps),))


def test_weights(spark):
    rows, schema = one_field(spark, ["x", "x", "y", ""])
    got = {r.term: r for r in learn(rows, schema).table.collect()}
    assert set(got) == {"x", "y"} and got["x"].term_idx == 0 and got["y"].term_idx == 1 and got["x"].total == 3
    assert math.isclose(got["x"].weight, math.log(1.5)) and math.isclose(got["y"].weight, math.log(3))


def test_term_counts_per_occurrence(spark):
    rows, schema = one_field(spark, ["RED RED BLUE"], steps=(Transform("split"),))
    assert {r.term: r.cnt for r in learn(rows, schema).counts.collect()} == {"RED": 2, "BLUE": 1}


@settings(max_examples=5, deadline=None)
@given(words=st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\0"), min_size=1, max_size=4), min_size=1, max_size=30))
def test_ordinals_are_bytewise(spark, words):
    rows, schema = one_field(spark, words)
    got = {r.term: r.term_idx for r in learn(rows, schema).table.collect()}
    assert got == {w: k for k, w in enumerate(sorted(set(words), key=lambda w: w.encode()))}


def test_save_and_load(spark, tmp_path):
    rows = spark.createDataFrame(ANIMALS, "id bigint, name string, animal string")
    learnt = learn(rows, ANIMAL_SCHEMA)
    learnt.save(f"{tmp_path}/v")
    before = {r.id: r.signature for r in sign(rows, learnt).collect()}
    after = {r.id: r.signature for r in sign(rows, Vocabulary.load(spark, f"{tmp_path}/v")).collect()}
    assert before == after and all(len(s) == 170 for s in before.values()) and len({tuple(s) for s in before.values()}) == 5


def test_fingerprint(spark):
    a, schema = one_field(spark, ["x", "y", "x"])
    b, _ = one_field(spark, ["y", "x", "x"])
    c, _ = one_field(spark, ["y", "y", "x"])
    prints = [learn(r, schema).fingerprint().first().fingerprint for r in (a, b, c)]
    assert prints[0] == prints[1] != prints[2]


# components and signatures


def test_compact(spark):
    rows = spark.createDataFrame([(-8.0,), (0.0,), (7.999,), (9.0,), (-9.0,)], "x double")
    got = rows.select(gauss.compact(F.col("x")).alias("q"), gauss.uncompact(gauss.compact(F.col("x"))).alias("x")).collect()
    assert [r.q for r in got] == [0, 32768, 65531, 65535, 0] and [r.x for r in got[:3]] == [-8.0, 0.0, 7.998779296875]


def test_components_are_normal(spark):
    r = gauss.components(spark, 50_000).agg(F.avg("x"), F.var_samp("x")).first()
    assert abs(r[0]) < 0.02 and abs(r[1] - 1) < 0.03


def python_component(i, seed="planes"):
    import hashlib

    h = hashlib.md5(f"{seed}:{i}".encode()).hexdigest()
    u1, u2 = (int(h[:8], 16) + 1) / 4294967297, int(h[8:16], 16) / 4294967296
    return math.floor((math.sqrt(-2 * math.log(u1)) * math.cos(2 * math.pi * u2) + 8) * 4096) / 4096 - 8


def test_signature_against_plain_python(spark):
    rows = spark.createDataFrame(ANIMALS, "id bigint, name string, animal string")
    schema = SchemaDef(20, 6, ANIMAL_SCHEMA.fields)
    got = {r.id: r.signature for r in sign(rows, learn(rows, schema)).collect()}
    lists = [[r[k].upper() for r in ANIMALS] for k in (1, 2)]
    for n, *values in ANIMALS:
        sums_, offset = [0.0] * 20, 0
        for known, value in zip(lists, values, strict=True):
            terms = sorted(set(known))
            w = math.log(len(known) / known.count(value.upper()))
            for i in range(20):
                sums_[i] += w * python_component(offset + i * len(terms) + terms.index(value.upper()))
            offset += len(terms) * 20
        want = [sum((sums_[c * 6 + j] >= -1e-9) << j for j in range(6)) for c in range(3)]
        assert got[n] == want


def test_one_term_sets_every_bit(spark):
    rows, schema = one_field(spark, ["x", "x"])
    assert [r.signature for r in sign(rows, learn(rows, schema)).collect()] == [[15] * 4] * 2


def test_no_terms_set_every_bit(spark):
    rows, schema = one_field(spark, ["A B", ""], steps=(Transform("split"),))
    assert {r.id: r.signature for r in sign(rows, learn(rows, schema)).collect()}[1] == [15] * 4


def test_unlearnt_terms(spark):
    learnt_rows, schema = one_field(spark, ["b", "d", "d"])
    probes, _ = one_field(spark, ["a", "c", "e", "", "b"])
    vocabulary = learn(learnt_rows, schema)
    got = {r.id: r for r in sums(probes, vocabulary).collect()}
    planes = [[python_component(i * 2 + k) for i in range(16)] for k in (0, 1)]
    for n, k in ((0, 0), (1, 1), (3, 0)):
        assert [math.copysign(1, s) for s in got[n].sums] == [math.copysign(1, p) for p in planes[k]] and all(math.isinf(s) for s in got[n].sums)
    assert got[2].sign_error and not got[4].sign_error
    signed = {r.id: r.signature for r in sign(probes, vocabulary).collect()}
    assert signed[2] is None and signed[0] == [sum((planes[0][c * 4 + j] >= 0) << j for j in range(4)) for c in range(4)]
    assert {r.id: r.sign_error for r in sign(probes, vocabulary, oov="ignore").collect()} == dict.fromkeys(range(5))


def test_infinities_that_cancel_give_zero_bits(spark):
    learnt_rows, schema = one_field(spark, ["B D"], steps=(Transform("split"),))
    probes, _ = one_field(spark, ["A C"], steps=(Transform("split"),))
    s = sums(probes, learn(learnt_rows, schema)).first().sums
    assert any(math.isnan(x) for x in s)
    bits = sign(probes, learn(learnt_rows, schema)).first().signature
    assert all(not bits[i // 4] >> i % 4 & 1 for i, x in enumerate(s) if math.isnan(x))


@pytest.mark.parametrize("shipped", [True, False])
def test_records_of_one_id_are_signed_each_by_itself(spark, monkeypatch, shipped):
    """As if they had ids of their own; repeated records count as often as they occur."""
    values = [("A B", "x"), ("C", "x"), ("A B", "x"), ("", None), ("", ""), ("C", "y"), ("A B", "x"), ("Z", "x"), (None, "C")]
    ids = [1, 1, 1, 1, 1, None, None, 1, 1]
    apart = spark.createDataFrame([(k, *v) for k, v in enumerate(values)], "id bigint, t string, u string")
    schema = SchemaDef(16, 4, (FieldDef(("t",), (Transform("split"),)), FieldDef(("u",))))
    learnt = learn(apart.where("id <> 7"), schema)
    if not shipped:
        monkeypatch.setattr(signature, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(signature, "TIMES", 2)
    want = sorted((ids[r.id] or 0, r.signature or [], bool(r.sign_error)) for r in sign(apart, learnt).collect())
    together = spark.createDataFrame([(i, *v) for i, v in zip(ids, values, strict=True)], "id bigint, t string, u string")
    signed = lineage.cut(sign(together.repartition(3), learnt))
    assert sorted((r.id or 0, r.signature or [], bool(r.sign_error)) for r in signed.collect()) == want
    assert idx.postings(signed, "multiset").count() == 8 * 4 and idx.postings(signed).count() < 8 * 4
    assert sign(together.limit(0), learnt).count() == 0


def test_latest_of_equal_versions_is_settled(spark):
    rows = [(1, f"n{k}", 1) for k in range(40)] + [(1, "old", 0), (2, None, 1)]
    frame = spark.createDataFrame(rows, "id bigint, n string, version bigint")
    got = {tuple(sorted((r.id, r.n or "") for r in idx.latest(frame.repartition(k)).collect())) for k in (1, 3, 7)}
    assert len(got) == 1 and "old" not in str(got)


def test_close_records_share_more(spark):
    words = [f"W{k} X{k % 7} Y{k % 5}" for k in range(60)]
    rows, schema = one_field(spark, words, 128, 4, (Transform("split"),))
    learnt = learn(rows, schema)
    signed = sign(rows, learnt)
    near = sign(spark.createDataFrame([(0, "W0 X0 Y1"), (1, "W9 X4 Y2")], "id bigint, t string"), learnt)
    got = {r.query_id: r.matches for r in idx.match(near, idx.postings(signed)).where("id = 0").collect()}
    assert got[0] > got.get(1, 0)


# the index


def golden(spark):
    stored = spark.createDataFrame(GOLDEN, "id bigint, first string, last string, signature array<bigint>")
    return stored, spark.createDataFrame([(0, GOLDEN_PROBE)], "id bigint, signature array<bigint>")


@pytest.mark.parametrize("gathered", [32_000_000, 100])
def test_equal_records_are_signed_once(spark, monkeypatch, gathered):
    rows = spark.range(1000).select("id", F.concat(F.lit("A"), F.col("id") % 3).alias("t"))
    learnt, placed, real = learn(rows, SchemaDef(16, 4, (FieldDef(("t",)),))), [], signature.weighted_terms
    monkeypatch.setattr(signature, "GATHERED_BYTES", gathered, raising=False)
    monkeypatch.setattr(signature, "weighted_terms", lambda *a: placed.append(real(*a)) or placed[-1])
    got = sign(rows, learnt).collect()
    assert len(got) == 1000 and len({(r.id % 3, tuple(r.signature)) for r in got}) == 3
    assert placed[0].count() == 3


@pytest.mark.parametrize("broadcast", [250_000, 0])
@pytest.mark.parametrize("unique", [False, True])
def test_matches_of_classes_are_those_of_ids(spark, monkeypatch, broadcast, unique):
    """Equal signatures, several of one id, repeated rows and limits, against counting by hand."""
    monkeypatch.setattr(idx, "BROADCAST_ROWS", broadcast, raising=False)
    monkeypatch.setattr(idx, "TASK_ROWS", 10, raising=False)
    rows = [(k, [k % 2, k % 3, 7, k % 5]) for k in range(40)] + [(k, [1, 2, 7, 4]) for k in (3, 3, 9)]
    stored = spark.createDataFrame(rows, "id bigint, signature array<bigint>").repartition(3)
    probes = stored.where("id < 10")
    counts = {}
    for q, a in rows:
        for i, b in rows:
            for c in range(4):
                if q < 10 and a[c] == b[c]:
                    counts.setdefault((q, i), []).append(c)
    want = {k: len(set(v)) if unique else len(v) for k, v in counts.items()}
    posted = idx.postings(stored, "multiset")
    found = idx.match(probes, posted, unique=unique)
    assert sorted((r.query_id, r.id, r.matches) for r in found.collect()) == sorted((*k, n) for k, n in want.items())
    if broadcast:
        assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()  # pairs of ids are not shuffled
    got = idx.match(probes, posted, unique=unique, min_matches=2, limit=3)
    best = [sorted((-n, i) for (q, i), n in want.items() if q == p and n >= 2)[:3] for p in range(10)]
    assert sorted((r.query_id, -r.matches, r.id) for r in got.collect()) == sorted((p, *x) for p in range(10) for x in best[p])


def test_min_matches_of_an_index(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"n{k}", [k % 2, k % 3, 7], None) for k in range(12)], "id bigint, n string, signature array<bigint>, sign_error string")
    index = idx.Index(spark, f"{tmp_path}/i")
    for version in (1, 2):
        index.write(rows.select("id", "n"), rows.select("id", "signature", "sign_error"), version)
    got = index.query(rows.where("id = 0"), min_matches=2)
    assert [(r.id, r.n, r.matches) for r in got.collect()] == [(0, "n0", 3), (6, "n6", 3), *((k, f"n{k}", 2) for k in (2, 3, 4, 8, 9, 10))]
    assert sorted(index.query(rows.where("id = 0"), best_first=False, min_matches=2).collect()) == sorted(got.collect())


def test_golden_matches(spark):
    stored, probe = golden(spark)
    got = idx.ranked(idx.match(probe, idx.postings(stored), stored.select("id", "first"))).collect()
    assert [(r.id, r.first, r.matches) for r in got] == [(1, "John", 4), (2, "Jane", 3)]


def test_modes_of_rewriting(spark, tmp_path):
    stored, probe = golden(spark)
    signed = stored.select("id", "signature", F.lit(None).cast("string").alias("sign_error"))
    for mode, matches in (("set", 4), ("multiset", 8)):
        index = idx.Index(spark, f"{tmp_path}/{mode}", mode)
        index.write(stored.select("id", "first"), signed, 1)
        index.write(stored.where("id = 1").select("id", F.lit("Jack").alias("first")), signed.where("id = 1"), 2)
        first = index.query(probe).first()
        assert (first.id, first.first, first.matches) == (1, "Jack", matches)
        assert [r.first for r in index.fetch(stored.where("id = 2")).collect()] == ["Jane"]


def test_ids_without_a_record(spark):
    stored, probe = golden(spark)
    some = stored.where("id = 1").select("id", "first")
    assert idx.match(probe, idx.postings(stored), some, "inner").count() == 1
    assert {r.id: r.first for r in idx.match(probe, idx.postings(stored), some, "left").collect()} == {1: "John", 2: None}


def test_limits(spark):
    stored, probe = golden(spark)
    assert [r.id for r in idx.match(probe, idx.postings(stored), min_matches=4).collect()] == [1]
    assert [r.id for r in idx.match(probe, idx.postings(stored), limit=1).collect()] == [1]


def test_codecs(spark):
    r = spark.sql("select 255 as c, 65535 as v, 4291953712L as i").select(codecs.bucket_key(F.col("c"), F.col("v")).alias("b"), codecs.id_key(F.col("i")).alias("k")).withColumn("i", codecs.key_id(F.col("k"))).first()
    assert (r.b, r.k, r.i) == ("////", "/9IEMA==", 4291953712)
    with pytest.raises(Exception):
        spark.sql("select 256 as c, 0 as v").select(codecs.bucket_key(F.col("c"), F.col("v"))).collect()


def test_streamed_index(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in", a="1,apple,1\n2,pear,2\n", b="3,apple,1\n")
    source = SourceDef({"fruit": 2, "count": 3}, concurrent=1)
    schema = SchemaDef(32, 4, (FieldDef(("fruit",)), FieldDef(("count",))))
    rows = delimited.read(spark, source, f"{tmp_path}/in/*")
    learnt = learn(rows, schema)
    index = idx.Index(spark, f"{tmp_path}/idx")
    index_stream(delimited.read_stream(spark, source, f"{tmp_path}/in"), learnt, index, f"{tmp_path}/cp").awaitTermination()
    got = index.query(sign(rows.where("id = 1"), learnt)).collect()
    assert [(r.id, r.matches) for r in got[:2]] == [(1, 8), (3, 8)]


def test_protocols(spark, tmp_path):
    from kinfold.plans import protocols

    source = protocols.DelimitedSource(SourceDef({"fruit": 2, "count": 3}, glob=write(tmp_path, a="1,apple,1\n2,pear,2\n")))
    rows = source.records(spark)
    signer = protocols.LearntSigner(learn(rows, SchemaDef(17, 4, (FieldDef(("fruit",)),))))
    assert isinstance(source, protocols.Source) and isinstance(signer, protocols.Signer) and isinstance(protocols.Gauss(), protocols.RandomProvider)
    assert isinstance(signer.vocabulary, protocols.Classifier)
    assert (signer.signature_length, signer.chunk_bits) == (4, 4) and [len(r.signature) for r in signer.sign(rows).collect()] == [4, 4]
    assert math.isclose(value(spark, protocols.Gauss().get(F.lit(5))), python_component(5))


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    glob = write(tmp_path / "in", a="1,apple,1\n2,pear,2\n3,apple,1\n")
    (tmp_path / "s.json").write_text(SourceDef({"fruit": 2, "count": 3}).to_json())
    (tmp_path / "d.json").write_text(SchemaDef(16, 4, (FieldDef(("fruit",)), FieldDef(("count",)))).to_json())
    common = ["--source", f"{tmp_path}/s.json", "--in", glob]
    assert cli.main(["learn", "--schema", f"{tmp_path}/d.json", *common, "--out", f"{tmp_path}/v"], spark) == 0
    assert cli.main(["index", "--schema", f"{tmp_path}/v", *common, "--index", f"{tmp_path}/i"], spark) == 0
    assert cli.main(["query", "--schema", f"{tmp_path}/v", *common, "--index", f"{tmp_path}/i", "--limit", "2"], spark) == 0
    assert "apple" in capsys.readouterr().out
    assert cli.main(["hash", "--count", "10", "--out", f"{tmp_path}/h"], spark) == 0 and spark.read.parquet(f"{tmp_path}/h").count() == 10
    with pytest.raises(SystemExit):
        cli.main(["nothing"], spark)


# vectors


def value(spark, column):
    return spark.range(1).select(column.alias("r")).first().r


def array(*xs):
    return F.array(*(F.lit(float(x)) for x in xs))


def sparse(dimension, **at):
    entries = [F.struct(F.lit(int(k[1:])).cast("bigint").alias("index"), F.lit(float(v)).alias("value")) for k, v in at.items()]
    kind = "array<struct<index:bigint,value:double>>"
    return F.struct(F.lit(dimension).cast("bigint").alias("dimension"), (F.array(*entries) if entries else F.array()).cast(kind).alias("components"))


def test_vector_goldens(spark):
    assert math.isclose(value(spark, vectors.cosine(array(1, 0), array(1, 1))), 1 / math.sqrt(2))
    a, b = sparse(5, _1=1, _3=1, _4=1), sparse(5, _1=5, _2=2, _4=4)
    assert value(spark, vectors.sparse_dot(a, b)) == 9 and value(spark, vectors.mixed_dot(array(0, 1, 0, 1, 1), b)) == 9
    planes = [array(1, -1, 0, 0, 0), array(0, 1, 0, -1, 0), array(-1, 0, 1, 0, 0), array(0, -1, 0, 0, 1)]
    assert value(spark, vectors.signature(array(0.2, 0.3, 0.4, 0.5, 0.6), planes)) == 0xC
    assert value(spark, vectors.sparse_dot(sparse(5), b)) == 0 and value(spark, vectors.sparse_component(b, 4)) == 4 and value(spark, vectors.sparse_component(b, 3)) == 0
    assert math.isclose(value(spark, vectors.sparse_norm(b)), math.sqrt(45)) and value(spark, vectors.norm(array(3, 4))) == 5
    assert math.isnan(value(spark, vectors.cosine(array(0, 0), array(1, 1)))) and math.isnan(value(spark, vectors.sparse_cosine(sparse(5), b)))
    assert math.isclose(value(spark, vectors.sparse_cosine(a, b)), 9 / math.sqrt(3 * 45))
    assert value(spark, vectors.hashed(array(1, 1), array(-1, 1))) and not value(spark, vectors.hashed(array(1, 1), array(-1, 0)))
    assert not value(spark, vectors.side(F.lit(float("nan"))))
    assert value(spark, vectors.component(array(1, 2), 1)) == 2 and value(spark, vectors.component(array(1, 2), 2)) is None
    assert len(value(spark, vectors.random(7))) == 7


@pytest.mark.parametrize("product", [lambda: vectors.dot(array(1), array(1, 2)), lambda: vectors.sparse_dot(sparse(4), sparse(5)), lambda: vectors.mixed_dot(array(1), sparse(5))])
def test_dimensions_must_agree(spark, product):
    with pytest.raises(Exception, match="dimensions differ"):
        value(spark, product())


# the encoder


CELLS = [(0, ["a", "1", ""]), (1, ["b", "1", ""]), (2, ["c", "2", "x"])]


def test_encoder(spark, tmp_path):
    rows = spark.createDataFrame(CELLS, "seq bigint, fields array<string>")
    learnt = enc.learn(rows)
    got = {(r.field_pos, r.term): r for r in learnt.counts.collect()}
    assert got[0, "c"].term_id == 2 and got[1, "2"].term_id == 1 and got[1, "1"].cnt == 2 and (2, "") not in got
    learnt.save(f"{tmp_path}/e")
    for one in (learnt, enc.Encoder.load(spark, f"{tmp_path}/e")):
        v = {r.seq: r.vector for r in one.encode(rows).collect()}[0]
        at = [(c["index"], c["value"]) for c in v.components]
        assert v.dimension == 6 and at[0][0] == 0 and math.isclose(at[0][1], math.log(3)) and at[1][0] == 3 and math.isclose(at[1][1], math.log(1.5)) and at[2] == (0, 0.0)


def test_encoder_unknown_term(spark):
    rows = spark.createDataFrame(CELLS, "seq bigint, fields array<string>")
    probe = spark.createDataFrame([(9, ["zz", "2", "x"])], "seq bigint, fields array<string>")
    v = enc.learn(rows).encode(probe).first().vector
    assert v.components[0]["index"] == 0 and math.isclose(v.components[0].value, math.log(3))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stream_of_wider_files(spark, tmp_path):
    """Files with more columns than the definition names read alike as batch and as stream."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("1,x,y,z\n2,,q,\n")
    source = SourceDef({"second": 2}, glob=f"{tmp_path}/in/*.csv")
    stream = delimited.read_stream(spark, source)
    stream.writeStream.format("memory").queryName("wide_files").trigger(availableNow=True).start().awaitTermination()
    assert sorted(spark.table("wide_files").collect()) == sorted(delimited.read(spark, source).collect())
    assert delimited.read_stream(spark, source, f"{tmp_path}/none*.csv", width=4).columns == ["id", "second"]


def test_paths_without_broadcast(spark, monkeypatch):
    """Signatures are the same whether planes and terms are broadcast or not, and by a provider."""
    rows = spark.createDataFrame([(k, f"NAME {k % 5} OF {k % 3}", f"t{k % 4}") for k in range(60)], "id bigint, n string, m string")
    schema = SchemaDef(32, 8, (FieldDef(("n",), (Transform("split"),)), FieldDef(("m",))))
    learnt = learn(rows.where("id < 20"), schema)
    told = lambda **options: sorted((r.id, r.signature, r.sign_error) for r in sign(rows, learnt, **options).collect())
    want = told()
    assert told(seed=protocols.Gauss()) == want
    monkeypatch.setattr(signature, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(signature, "BROADCAST_TERMS", 0)
    assert told() == want and told(seed=protocols.Gauss()) == want


def test_one_prefix_is_numbered_over_ranges(spark):
    rows = spark.createDataFrame([(k % 2, f"Customer#{k:06d}") for k in range(2_000)], "g int, term string").repartition(7)
    got = {(r.g, r.term): r.before for r in lineage.before(rows, "g", ["term"]).collect()}
    for g in (0, 1):
        assert [got[g, f"Customer#{k:06d}"] for k in range(g, 2_000, 2)] == list(range(1_000))


def test_vector_types_are_checked(spark):
    rows = spark.createDataFrame([([1.0, 2.0], "x")], "v array<float>, t string").withColumn("s", vectors.sparse(vectors.dense(F.col("v"))))
    got = rows.select(vectors.dot_of(rows, "v", "s").alias("a"), vectors.dot_of(rows, "s", "v").alias("b"), vectors.cosine_of(rows, "v", "s").alias("c")).first()
    assert (got.a, got.b) == (5.0, 5.0) and abs(got.c - 1) < 1e-12
    with pytest.raises(TypeError):
        vectors.dot_of(rows, "v", "t")
