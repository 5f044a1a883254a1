"""The pipeline against plain steps over the same rows."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from kinfold.llm import lines, minhash, quality
from kinfold.llm.common import saved

from .test_lines import brute
from .test_minhash import groups


def test_stages(spark, small):
    docs = saved(spark.read.parquet(f"{small}/documents.parquet"))
    columns = docs.columns
    good, own, unlike, mixed = (None,) * 4
    stages = [f for _, f in corpus_pipeline.STAGES]

    good = saved(stages[0](spark, docs, small))
    model = quality.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    rows = docs.collect()
    keep = model.score(quality.matrix([r.text for r in rows])) >= quality.THRESHOLD
    assert good.columns == columns and sorted(good.collect()) == sorted(r for r, k in zip(rows, keep, strict=True) if k)

    own = saved(stages[1](spark, good, small))
    want = {i: text for i, _, _, text in brute([(r.doc_id, r.text, r.source) for r in good.collect()], lines.SITES)}
    assert own.columns == columns and {r.doc_id: r.text for r in own.collect()} == want

    unlike = saved(stages[2](spark, own, small))
    texts = {r.doc_id: r.text for r in own.collect()}
    assert unlike.columns == columns and {r.doc_id for r in unlike.collect()} == {i for i, c in groups(texts, 5).items() if i == c}

    mixed = saved(stages[3](spark, unlike, small))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in unlike.collect():
        sizes[r.source] += len(r.text.split())
    copies = Counter()
    for r in mixed.collect():
        taken[r.source] += len(r.text.split())
        copies[r.doc_id] += 1
    assert mixed.columns == columns and max(copies.values()) <= 3 and abs(sum(taken.values()) - sum(sizes.values())) < 0.15 * sum(sizes.values())

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in stages[4](spark, mixed, small).collect())
    want = Counter()
    for r in mixed.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        want[(r.doc_id, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())] += 1
    assert got == want


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0 and minhash.BANDS * 4 == minhash.BUCKETS
