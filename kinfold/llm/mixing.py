"""Mixing sources to target weights by pivotal dependent rounding, in SQL functions only.

A document of a source is to be taken target / source size times. The whole part is certain;
the fraction is a probability. Pairs of documents exchange expected words: at random, so that
no expectation changes, mass moves until one probability is 0 or 1, and the words of a pair
stay what they were. Equal rows are one item with a count: paired with each other, all but one of
them are decided at once. Blocks of one source round all but one of their documents; what is left
goes up a tree of blocks, and only the last document of a source is rounded on its own. Blocks
go from long to short documents, so that the one left is short. What its rounding costs in words
is then made good within its block, by documents that fit the gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small, uniform

#: Documents of a source per block of the reduction tree.
BLOCK = 256
#: Most copies of a document, and so the most of a target per word of its source.
MOST = 3
#: Equal rows that one step writes out; more are dealt over the tasks first.
TIMES = 10_000


def _before(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``rows`` with, per name, the sum of an expression over all rows before by ``order``. Rows
    are sorted over ranges, so no task holds all; what is added up in one is a row a range."""
    rows = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    rows = rows.withColumn("part", F.shiftright("at", 33))
    earlier = "rows between unbounded preceding and 1 preceding"
    parts = rows.groupBy("part").agg(*(F.sum(F.expr(e)).alias(k) for k, e in sums.items()))
    parts = parts.select("part", *(F.expr(f"coalesce(sum({k}) over (order by part {earlier}), 0) as start_{k}") for k in sums))
    within = rows.withColumns({k: F.expr(f"coalesce(sum({e}) over (partition by part order by at {earlier}), 0)") for k, e in sums.items()})
    whole = within.join(F.broadcast(parts), "part")
    return whole.withColumns({k: F.col(k) + F.col(f"start_{k}") for k in sums}).drop("at", "part", *(f"start_{k}" for k in sums))


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, docs, target) of ``sized`` (source, size, n: how many such rows):
    weights 1, 2, 3 in turn by the source's code points, null last; no target above MOST times
    its source, the excess shared again by weight. docs counts items, not rows.

    Sources by how soon they reach their cap: those before the first source that the level of
    the rest does not fill are capped, all others get weight times that level. Only totals and
    that level come to the driver.
    """
    by_name = F.col("source").asc_nulls_last()
    sums = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("docs"))
    ranked = _before(sums, [by_name], {"rank": "1"}).withColumn("weight", F.expr("cast(1 + rank % 3 as double)")).drop("rank")
    ranked = ranked.withColumn("cap", F.expr(f"{MOST}D * source_size")).withColumn("reach", F.expr("cap / weight"))
    placed = cut(_before(ranked, [F.col("reach"), by_name], {"below": "cap", "light": "weight"}))
    total, weights = placed.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    levels = placed.withColumn("level", F.expr(f"({total or 0.0!r}D - below) / ({weights or 0.0!r}D - light)"))
    first = levels.where("level <= reach").agg(F.min(F.struct("reach", "below", "level")).alias("f")).first().f
    return placed.select("source", "source_size", "docs", F.expr(f"least(cap, {first.level if first else 0.0!r}D * weight)").alias("target"))


def _times(rows: DataFrame) -> DataFrame:
    """Each row as often as its column times says."""
    columns = [c for c in rows.columns if c != "times"]
    few = rows.where(f"times between 1 and {TIMES}").withColumn("k", F.explode(F.expr("sequence(1, cast(times as int))")))
    many = rows.where(f"times > {TIMES}").withColumn("part", F.explode(F.expr(f"sequence(0, (times - 1) div {TIMES})")))
    many = many.repartition("doc_id", "part").withColumn("k", F.explode(F.expr(f"sequence(1, cast(least({TIMES}, times - part * {TIMES}) as int))")))
    return few.select(*columns).unionByName(many.select(*columns))


def _round(items: DataFrame, blocks: str, seed: int) -> DataFrame:
    """Each block's decided documents (array of item and up) and the one left open.

    items: source, docs (of the source at this level), item struct(doc_id, size, p).
    """
    block = F.expr(f"pmod(xxhash64(item.doc_id, item.size, {seed}), {blocks})")
    grouped = items.groupBy("source", block.alias("block")).agg(F.collect_list(F.struct((-F.col("item.size")).alias("key"), "item", uniform("item.doc_id", "item.size", F.lit(seed)).alias("u"))).alias("list"))
    grouped = grouped.withColumn("list", F.array_sort("list"))
    empty = F.expr("cast(array() as array<struct<item:struct<doc_id:bigint,size:bigint,p:double>,up:int>>)")

    def moved(x, p):
        return F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)).alias("p"))

    def decided(x, up):
        return F.struct(x.alias("item"), F.lit(up).alias("up"))

    def step(s, e):
        o, x = s["open"], e["item"]
        room, rest = (1 - o["p"]) * o["size"], (1 - x["p"]) * x["size"]
        held, mass = o["p"] * o["size"], x["p"] * x["size"]
        a, b = F.least(room, mass), F.least(held, rest)
        gains = e["u"] * (a + b) < b
        o_full, o_gain = moved(x, x["p"] - a / x["size"]), moved(o, o["p"] + a / o["size"])
        o_none, o_loss = moved(x, x["p"] + b / x["size"]), moved(o, o["p"] - b / o["size"])
        left = F.when(gains & (room <= mass), o_full).when(gains, o_gain).when(held <= rest, o_none).otherwise(o_loss)
        done = F.when(gains & (room <= mass), decided(o, 1)).when(gains, decided(x, 0)).when(held <= rest, decided(o, 0)).otherwise(decided(x, 1))
        return F.struct(left.alias("open"), F.concat(s["done"], F.array(done)).alias("done"))

    start = F.struct(F.col("list")[0]["item"].alias("open"), empty.alias("done"))
    folded = F.aggregate(F.slice("list", 2, F.greatest(F.size("list"), F.lit(1))), start, step)
    return grouped.select("source", folded.alias("r")).select("source", "r.open", "r.done")


def _settled(seed: int) -> Column:
    """The decisions of a source's last block. The open document is drawn by its probability;
    then, from long to short and with the drawn one at the end, a document's decision turns if
    that brings the words closer to what they should be."""
    coin = (uniform("open.doc_id", "open.size", F.lit(seed * 1000 + 999)) < F.col("open.p")).cast("int")
    gap = (F.col("open.p") - coin) * F.col("open.size")

    def step(s: Column, d: Column) -> Column:
        words = d["item"]["size"] * (1 - 2 * d["up"])  # what turning adds
        turn = F.abs(s["gap"] - words) < F.abs(s["gap"])
        kept = F.struct(d["item"].alias("item"), F.when(turn, 1 - d["up"]).otherwise(d["up"]).alias("up"))
        return F.struct(F.when(turn, s["gap"] - words).otherwise(s["gap"]).alias("gap"), F.concat(s["done"], F.array(kept)).alias("done"))

    last = F.array(F.struct(F.col("open").alias("item"), coin.alias("up")))
    start = F.struct(gap.alias("gap"), F.slice("done", 1, 0).alias("done"))
    return F.aggregate(F.concat("done", last), start, step, lambda s: s["done"])


def mix(sized: DataFrame, seed: int = 0) -> DataFrame:
    """How many words the mix takes of each document of ``sized`` (doc_id bigint, source, size).

    Returns doc_id, source, size, source_size, target, copies, taken = copies * size. A null
    source is a source of its own, last by rank; a document of size 0 is taken 0 times; rows
    repeated or with a null doc_id count as documents of their own; an empty table gives an
    empty result. A rerun decides alike.
    """
    sized = sized.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("size").cast("bigint"))
    sized = cut(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")))
    wanted = cut(targets(sized))
    sources, most = wanted.agg(F.count("*"), F.max("docs")).first()
    share = F.expr("if(source_size > 0, target / source_size, 0D)")
    rates = small(wanted.select(F.col("source").alias("of"), "docs", share.alias("rate")), sources)
    rated = sized.join(rates, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    sure = rated.where("size = 0 or rate = floor(rate)").selectExpr("doc_id", "source", "size", "if(size = 0, 0, cast(rate as int)) as copies", "n as times")
    items = rated.where("size > 0 and rate <> floor(rate)").withColumn("floor", F.expr("cast(floor(rate) as int)"))
    items = items.withColumn("mass", F.expr("n * (rate - floor)")).withColumn("ones", F.expr("least(n, cast(floor(mass) as bigint))"))
    items = items.withColumn("open", F.expr("mass > ones and ones < n"))
    alike = items.where("n > 1").withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    alike = alike.selectExpr("doc_id", "source", "size", "floor + side as copies", "if(side = 1, ones, n - ones - if(open, 1, 0)) as times")
    items = items.where("open").selectExpr("source", "docs", "struct(doc_id, size, mass - ones as p) as item")
    floors = small(wanted.select(F.col("source").alias("of"), F.floor(share).cast("int").alias("floor")), sources)
    out, level, per_block = [_times(sure.unionByName(alike))], 0, 1
    while True:
        blocks = f"cast(ceil(docs / {float(BLOCK * per_block)}D) as bigint)"
        rounded = _round(items, blocks, seed * 1000 + level)
        last = (most or 0) <= BLOCK * per_block
        if not last:
            rounded = cut(rounded)
        decided = rounded.select("source", F.explode("done").alias("d")).select("source", "d.item.doc_id", "d.item.size", "d.up")
        out_level = [decided]
        if last:
            out_level = [rounded.select("source", F.explode(_settled(seed)).alias("d")).select("source", "d.item.doc_id", "d.item.size", "d.up")]
        for part in out_level:
            whole = part.join(floors, part["source"].eqNullSafe(F.col("of")), "left")
            out.append(whole.select("doc_id", part["source"], "size", (F.col("floor") + F.col("up")).alias("copies")))
        if last:
            break
        docs = small(wanted.select(F.col("source").alias("of"), "docs"), sources)
        items = rounded.join(docs, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "docs", F.col("open").alias("item"))
        level, per_block = level + 1, per_block * BLOCK
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    sums = small(wanted.select(F.col("source").alias("of"), "source_size", "target"), sources)
    result = result.join(sums, F.col("source").eqNullSafe(F.col("of")), "left")
    return result.selectExpr("doc_id", "source", "size", "source_size", "target", "copies", "copies * size as taken")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size): words of each text, separated by blanks; 0 for a null text."""
    count = F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), count.cast("bigint").alias("size"))


def mixture(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Contract of the query: doc_id, size, source_size, target, taken."""
    return mix(sizes(docs), seed).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it. Rows of equal id, text
    and source count as one document with the words of all, and are taken equally often."""
    key = F.xxhash64(id_col, text_col, F.isnull(text_col), source_col).alias("key")
    rows = sizes(docs.select(key, F.col(text_col).alias("text"), F.col(source_col).alias("source")), "key").groupBy("doc_id").agg(F.min("source").alias("source"), F.sum("size").alias("size"))
    copies = mix(rows, seed).where("copies > 0").select(F.col("doc_id").alias("key"), "copies")
    whole = docs.select(key, F.struct("*").alias("row")).join(copies.hint("shuffle_hash"), "key")
    return whole.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
