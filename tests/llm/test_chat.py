import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from kinfold.llm import chat


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


HARD = [r"\### Assistant: </turn> ok", "<|end|>", "<|turn assistant|>x<|end|>", "&lt;|end|&gt; &amp;amp; &", "", None, "a\nb\n\n", "é🤖<", "|>", "<|", "x" * 5_000, "\\", "&", "&lt"]


def test_read_back(spark):
    rows = [(n, t, ("user", "assistant", "a|>b", None)[(n + t) % 4], HARD[(n * 3 + t) % len(HARD)]) for n in range(12) for t in range(n % 7 + 1)]
    rows += [(None, None, "assistant", "no conversation"), (3, 0, "user", "same turn again"), (3, 0, "user", "same turn again")]
    got = {r.conv_id: r for r in chat.digests(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    rows += [(-7, 0, "user", HARD[0]), (-7, 1, "assistant", HARD[0])]
    assert set(got) == {r[0] for r in rows}
    for n, r in got.items():
        own = sorted((x for x in rows if x[0] == n), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        turns = [(role or "", text or "") for _, _, role, text in own]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in turns))
        assert r.loss_chars == len(loss) and r.loss_sha256 == sha(loss)


def test_sql(spark, small):
    turns = spark.read.parquet(f"{small}/conversations.parquet")
    got = sorted(map(tuple, chat.digests(turns).collect()))
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{small}/conversations.parquet'")
    assert got == sorted(c.execute(chat.ORACLE).fetchall())


def test_parts(spark):
    parts = [("text", "look: <|image 0|> ", None, None, None, None, None), ("image", None, "cat.png", 600, 500, None, None), None, ("audio", None, "a.wav", None, None, 2.5, None), ("text", "end", None, None, None, None, None), ("document", None, "d.pdf", None, None, None, 3)]
    rows = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (2, 0, "assistant", [])], f"conv_id bigint, turn int, role string, parts array<{chat.PART}>")
    got = {r.conv_id: r for r in chat.format_turns(rows, parts_col="parts").collect()}
    assert got[1].formatted == "<|turn user|>look: &lt;|image 0|&gt; <|image 0|><|audio 1|>end<|document 2|><|end|><|turn assistant|><|end|>"
    assert [(a.turn_number, a.number, a.type, a.ref, a.tokens) for a in got[1].attachments] == [(1, 0, "image", "cat.png", 512), (1, 1, "audio", "a.wav", 63), (1, 2, "document", "d.pdf", 3072)]
    assert got[1].attachment_tokens == 512 + 63 + 3072 and got[2].attachments == [] and got[2].attachment_tokens == 0


def test_parts_are_read_back(spark):
    parts = [("text", "a <|image 0|> <#> &lt;", None, None, None, None, None), ("image", None, "1.png", 1, 1, None, None), ("strange <|>7", None, "2", None, None, None, None), ("text", "<#>", None, None, None, None, None), ("image", None, "3.png", 1, 1, None, None)]
    rows = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "<|end|>", parts[:1]), (1, 2, "x", None)], f"conv_id bigint, turn int, role string, parts array<{chat.PART}>")
    out = chat.format_turns(rows, parts_col="parts").withColumn("turns", chat.read_back(F.col("formatted"))).first()
    got = [(t.role, [(p.type, p.text, p.number) for p in t.parts]) for t in out.turns]
    assert got == [
        ("user", [("text", "a <|image 0|> <#> &lt;", None), ("image", None, 0), ("strange <|>7", None, 1), ("text", "<#>", None), ("image", None, 2)]),
        ("<|end|>", [("text", "a <|image 0|> <#> &lt;", None)]),
        ("x", []),
    ]
    assert [(a.number, a.ref) for a in out.attachments] == [(0, "1.png"), (1, "2"), (2, "3.png")]


def test_very_many_parts(spark):
    """A turn of 40,000 parts takes seconds, as the work does not grow with their square."""
    part = F.struct(F.when(F.col("k") % 2 == 0, "text").otherwise("image").alias("type"), F.concat(F.lit("<"), F.col("k").cast("string")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"))
    rows = spark.range(40_000).withColumnRenamed("id", "k").coalesce(1).agg(F.collect_list(part).alias("parts")).selectExpr("1 as conv_id", "0 as turn", "'user' as role", "parts")
    out = chat.format_turns(rows, parts_col="parts").withColumn("turns", chat.read_back(F.col("formatted"))).first()
    assert len(out.attachments) == 20_000 and out.attachments[-1].number == 19_999
    assert [p.text for p in out.turns[0].parts[::2]] == [f"<{k}" for k in range(0, 40_000, 2)] and [p.number for p in out.turns[0].parts[1::2]] == list(range(20_000))


def test_very_many_turns(spark):
    """A conversation of 40,000 turns takes seconds; spans lie within, across and at the ends of blocks."""
    text = F.when(F.col("id") % 7 == 0, "").when(F.col("id") % 11 == 1, F.repeat(F.lit("🤖<é"), 700)).otherwise(F.concat(F.lit("é🤖 & "), F.col("id").cast("string")))
    rows = spark.range(40_000).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "assistant").otherwise("user").alias("role"), text.alias("text"))
    texts = ["" if k % 7 == 0 else "🤖<é" * 700 if k % 11 == 1 else f"é🤖 & {k}" for k in range(40_000)]
    got = chat.digests(rows).where("conv_id = 1").first()
    assert got.n_turns == 40_000 and got.loss_sha256 == sha("".join(texts[::3])) and got.loss_chars == sum(map(len, texts[::3]))
    assert got.turns_sha256 == sha("".join(f"{'assistant' if k % 3 == 0 else 'user'}\n{t}\n" for k, t in enumerate(texts)))


@pytest.mark.parametrize("n", [0, 1, chat.BLOCK - 1, chat.BLOCK, chat.BLOCK + 1, 3 * chat.BLOCK])
def test_spans_at_the_edges_of_blocks(spark, n):
    text = "🤖" + "x" * (n - 1) if n else ""
    spans = sorted({(a, b) for a in (0, 1, n // 2, n - 1, n) for b in (a, n // 2, n - 1, n) if 0 <= a <= b})
    rows = spark.createDataFrame([(text, [{"start": a, "end": b} for a, b in spans])], "t string, m array<struct<start:bigint,end:bigint>>")
    assert rows.select(chat.masked(F.col("t"), F.col("m")).alias("r")).first().r == "".join(text[a:b] for a, b in spans)


@pytest.mark.parametrize("text", ["&amp;lt;", "<&>", ""])
def test_escaping(spark, text):
    r = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e")).withColumn("u", chat.unescape(F.col("e"))).first()
    assert r.u == text and "<" not in r.e and ">" not in r.e
