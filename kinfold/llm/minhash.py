"""Near-duplicate documents with HyperMinHash registers, banding and exact verification.

A document is the set of its word shingles, 64-bit hashes. Documents of equal sets form a
class; one member goes on. The set's hashes fall into 128 buckets; of each bucket's least value
a register keeps the count of leading zeros (6 bits) and the 10 bits after the first one. Empty
buckets borrow from others in a fixed random order, so small sets collide as their similarity
says. Registers in bands of four make the keys that similar sets share.

Within a key's documents no pairs are listed: all are compared with two of them, its hubs. What
the links found so far join needs no further comparison. Documents around a hub that are still
apart are compared with each other: around a few hubs' documents as pairs; around many by the
rarest members of their sets. Of two similar sets, members ordered by how rare they are, the
smaller has one of the common members among its first ninth and the larger among its first fifth,
so only documents that share such a member meet, and what is common to a whole group of documents
brings none of them together. Pairs pass an estimate from the registers, corrected for chance
collisions, and then count on the full sets. A member shared by very many is worked off in blocks
of sets, of which only links come out; blocks use the same estimate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, counted, cut, released, ship
from .components import components

BUCKETS = 128
BANDS = 32
ZERO_BITS = 6
MANTISSA_BITS = 10
#: Candidates whose estimate is this much below the threshold are not verified: six standard
#: errors at a similarity of 0.8.
MARGIN = 0.22
#: Hubs that a document is verified against before components are known.
HUBS = 2
#: Documents around a hub up to which pairs are listed; more meet by the rare members of their sets.
PAIRED = 32
#: Pairs that one shared member may bring together one by one; more are compared in blocks.
LISTED = 4_096
#: Bytes of the sets of a block.
BLOCK = 4_000_000
#: Counters of how often members occur, whatever the number of sets.
SLOT_BITS = 18
#: Word hashes that a Python worker remembers.
CACHED_WORDS = 250_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
#: For each bucket the order in which it looks for another to borrow from.
_LENDERS = np.argsort(np.random.default_rng(7).random((BUCKETS, BUCKETS)), axis=1)


def _mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def _forget() -> None:
    _hashes.clear()


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words make one shingle, none no set."""
    parts = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII blanks only
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, parts), np.uint64, len(parts))
    n = min(words, len(parts))
    total = np.full(len(parts) - n + 1, n, np.uint64)
    for k in range(n):
        total = total * _ODD[k % len(_ODD)] + h[k : len(h) - n + 1 + k]
    total = _mix(total)
    total.sort()
    return total[np.concatenate(([True], total[1:] != total[:-1]))]


def registers(s: np.ndarray) -> np.ndarray:
    """The BUCKETS compressed registers of a set that is not empty."""
    bucket = (s >> np.uint64(57)).astype(np.int64)
    first = np.concatenate(([True], bucket[1:] != bucket[:-1]))  # sorted: a bucket's least value comes first
    value = (s[first] & np.uint64((1 << 57) - 1)) >> np.uint64(4)
    part, exponent = np.frexp(value.astype(np.float64))
    zeros = np.minimum(53 - exponent, (1 << ZERO_BITS) - 1)
    mantissa = np.where(value > 0, (part * 2 - 1) * (1 << MANTISSA_BITS), 0).astype(np.int64)
    out = np.zeros(BUCKETS, np.uint16)
    filled = np.zeros(BUCKETS, bool)
    out[bucket[first]] = zeros * (1 << MANTISSA_BITS) + mantissa
    filled[bucket[first]] = True
    if not filled.all():
        empty = np.flatnonzero(~filled)
        order = _LENDERS[empty]
        out[empty] = out[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return out


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity of sets of sizes n and m from their registers (a row each).

    Registers of unrelated values agree with a probability that follows from the geometric
    leading zeros and the uniform mantissa; it is taken out of the share that agrees.
    """
    share = (a == b).mean(axis=1)
    low, high = np.minimum(n, m) / BUCKETS, np.maximum(n, m) / BUCKETS
    x = np.arange(1, 54)
    upper, lower = 2.0 ** -(x - 1)[None], 2.0 ** -x[None]
    least = lambda d: np.exp(-d[:, None] * lower) - np.exp(-d[:, None] * upper)  # noqa: E731  P(least value in an octave)
    chance = (least(low) * least(high)).sum(axis=1) / (1 << MANTISSA_BITS)
    return np.clip((share - chance) / (1 - chance), 0, 1)


def _columns(batch: pa.RecordBatch, step: int = 2000) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, step):
        yield batch.slice(k, step)


def _print(s: np.ndarray) -> tuple[int, int]:
    """The two halves of a set's 128-bit digest."""
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def sketches(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, f1, f2, sketch): size, 128-bit digest and registers of each row's set."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _columns(whole):
                size, f1, f2, sketch = [], [], [], []
                for text in batch.column(1).to_pylist():
                    s = shingles(text, words)
                    one, two = _print(s)
                    size.append(len(s))
                    f1.append(one)
                    f2.append(two)
                    sketch.append(registers(s).tobytes() if len(s) else b"")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sketch, pa.binary())], ["doc_id", "n", "f1", "f2", "sketch"])

    return rows.mapInArrow(released(run, _forget), "doc_id bigint, n bigint, f1 bigint, f2 bigint, sketch binary")


def _likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, likeness) of the pairs whose sizes and registers allow ``threshold``."""
    one, two = (classes.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in "ab")
    sized = pairs.join(two, "b").join(one, "a").where(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, BUCKETS) for k in (3, 5))
                got = estimate(a, b, *(batch.column(k).to_numpy().astype(float) for k in (2, 4)))
                kept = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got)], ["a", "b", "likeness"])
                yield kept.filter(pa.array(got >= threshold - MARGIN))

    return sized.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(run, "a bigint, b bigint, likeness double")


def _sets(asked: DataFrame, classes: DataFrame, docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(key, s): the full sets, sorted 64-bit hashes, of the classes whose keys are asked for.

    The texts of a class's document are read, and of those the one with the class's digest
    counts: the document's id may stand for other texts, too."""
    few = asked.count() <= BROADCAST_ROWS
    keys = asked.withColumnRenamed("key", "id")
    wanted = cut(classes.join(F.broadcast(keys) if few else keys, "id", "left_semi").select(F.col("id").alias("key"), "doc_id", "f1", "f2"))
    owners, wanted = wanted.select("doc_id"), wanted.select("key", "f1", "f2")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(owners) if few else owners, "doc_id", "left_semi").select("text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _columns(whole, 500):
                full = [shingles(t, words) for t in batch.column(0).to_pylist()]
                f1, f2 = zip(*map(_print, full), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array([s.tobytes() for s in full], pa.binary())], ["f1", "f2", "s"])

    full = texts.mapInArrow(released(sets, _forget), "f1 bigint, f2 bigint, s binary").groupBy("f1", "f2").agg(F.min("s").alias("s"))
    return cut(full.join(F.broadcast(wanted) if few else wanted, ["f1", "f2"]).select("key", "s"), 10_000)


def _verified(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the pairs (a, b) whose full sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _columns(whole, 500):
                keep = []
                for a, b in zip(batch.column(2), batch.column(3), strict=True):
                    x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                    at = np.searchsorted(x, y)
                    at[at == len(x)] = 0
                    common = int((x[at] == y).sum()) if len(x) else 0
                    keep.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.select("a", "b").join(held.select(F.col("key").alias("b"), F.col("s").alias("sb")), "b").join(held.select(F.col("key").alias("a"), F.col("s").alias("sa")), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(check, "u bigint, v bigint")


def block_links(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (u, v) between the documents (id, c, s) of two blocks in different components c, one
    for each document on the left and component on the right. Hashes get small numbers, and a
    document is compared with a whole block by one pass over the block's numbers, if the
    estimate from their registers allows any link."""
    lengths = right["s"].map(len).to_numpy() // 8
    dense, numbers = np.unique(np.frombuffer(b"".join(right["s"]), np.uint64), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    ids, owner = right["id"].to_numpy(), right["c"].to_numpy()
    sketch = np.array([registers(np.frombuffer(s, np.uint64)) for s in right["s"]])
    flag = np.zeros(len(dense), np.int32)
    out_u, out_v = [], []
    for u, c, s in zip(left["id"], left["c"], left["s"], strict=True):
        x = np.frombuffer(s, np.uint64)
        likely = owner != c
        likely[likely] = estimate(sketch[likely], registers(x)[None], np.full(likely.sum(), len(x), float), lengths[likely].astype(float)) >= percent / 100 - MARGIN
        if not likely.any():
            continue
        at = np.searchsorted(dense, x)
        at[at == len(dense)] = 0
        at = at[dense[at] == x]
        flag[at] = 1
        common = np.add.reduceat(flag[numbers], starts).astype(np.int64)
        flag[at] = 0
        hit = np.flatnonzero(likely & (common > 0) & (100 * common >= percent * (len(x) + lengths - common)))
        _, first = np.unique(owner[hit], return_index=True)
        out_u += [u] * len(first)
        out_v += ids[hit[first]].tolist()
    return pd.DataFrame({"u": np.array(out_u, np.int64), "v": np.array(out_v, np.int64)})


def _frequencies(rows: DataFrame) -> np.ndarray:
    """How common the members of each slot are among the sets s, as a coarse logarithm. The slots
    are a fixed number, and members that share one only lose some of their order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for s in batch.column(0):
                np.add.at(total, (np.frombuffer(s.as_buffer(), np.uint64) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), 1)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(total[slot])], ["slot", "n"])

    got = rows.select("s").mapInArrow(released(count), "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SLOT_BITS, np.uint8)
    out[got["slot"].to_numpy()] = np.minimum(255, np.log2(got["n"].to_numpy()) * 6 + 1)
    return out


def rare(s: np.ndarray, common: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """(members, early): the first members of a set, from rare to common, one of which any set
    similar to it has, too; the first ``early`` of them if that set is no smaller."""
    n = len(s)
    order = np.lexsort((s, common[(s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]))
    return s[order[: n + 1 - -(-percent * n // 100)]], n + 1 - -(-2 * percent * n // (100 + percent))


def _crowded(members: DataFrame, held: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, links) across the components c of documents (id, c): pairs (a, b) still to be
    verified, from members that few share, and links (u, v) from members that many share."""
    rows = cut(members.join(held.withColumnRenamed("key", "id"), "id").select("id", "c", "s"), 10_000)
    common = _frequencies(rows)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _columns(whole, 500):
                out = []
                for n, s in enumerate(batch.column(2)):
                    full = np.frombuffer(s.as_buffer(), np.uint64)
                    head, early = rare(full, common, percent)
                    place = np.arange(len(head))
                    out.append((head.view(np.int64), np.full(len(head), n), np.full(len(head), len(full)), place, place < early))
                h, row, size, place, early = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(h), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(size), pa.array(place), pa.array(early)], ["h", "id", "c", "n", "place", "early"])

    listed = cut(rows.mapInArrow(released(firsts), "h bigint, id bigint, c bigint, n bigint, place bigint, early boolean"))
    lists = listed.groupBy("h").agg(F.count("*").alias("m"), F.count_if("early").alias("e"), F.sum("n").alias("size"), F.sum(F.expr("if(early, n, 0)")).alias("esize"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    lists = cut(lists.where("lo <> hi and e > 0"))
    some = listed.join(lists.where(f"m * e <= {LISTED}").select("h"), "h", "left_semi")
    x, y = some.where("early").alias("x"), some.alias("y")
    meet = f"x.h = y.h and x.c <> y.c and x.n <= y.n and {percent} * y.n <= 100 * x.n and {100 + percent} * least(x.n - x.place, y.n - y.place) >= {percent} * (x.n + y.n)"
    pairs = x.join(y, F.expr(meet)).selectExpr("least(x.id, y.id) as a", "greatest(x.id, y.id) as b").distinct()
    blocks = lists.where(f"m * e > {LISTED}").selectExpr("h", f"cast(ceil(8 * esize / {BLOCK}D) as int) as nu", f"cast(ceil(8 * size / {BLOCK}D) as int) as nm")
    many = listed.select("h", "id", "c", "early").join(blocks, "h").join(rows.select("id", "s"), "id")
    spread = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = many.where("early").select("h", "id", "c", "s", F.expr("cast(pmod(xxhash64(id), nu) as int)").alias("bu"), spread("nm").alias("bm"))
    right = many.select("h", "id", "c", "s", F.expr("cast(pmod(xxhash64(id, 1), nm) as int)").alias("bm"), spread("nu").alias("bu"))
    right = right.toDF(*right.columns)  # columns of its own, apart from the left's

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return block_links(a, b, percent) if len(a) and len(b) else pd.DataFrame({"u": np.array([], np.int64), "v": np.array([], np.int64)})

    return pairs, left.groupBy("h", "bu", "bm").cogroup(right.groupBy("h", "bu", "bm")).applyInPandas(run, "u bigint, v bigint")


def link(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups of documents: sets linked at 100 * common >= percent * all.

    Returns doc_id, n_shingles, component_id (the smallest id reachable over links, its own
    included), kept (whether the row's id is that). Words are lower-cased in A-Z only and parted
    by ASCII blanks. A text without words, or null, has an empty set and no links. Repeated rows
    of an id have the same result; if their texts differ, each is linked by its own text alone.
    A null id is linked with nothing and kept: its component is null. An empty table gives an
    empty result.
    """
    return _linked(docs, words, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def _linked(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """:func:`link` with each row's digest (f1, f2) and the number of its group, null for an
    empty set. Classes have numbers of their own, as one id may be the smallest of several."""
    prints = cut(sketches(docs, words, id_col, text_col), 20_000)
    known = prints.where("n > 0 and doc_id is not null")
    classes = known.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "n", "sketch")).alias("r"))
    classes = cut(classes.select("f1", "f2", F.monotonically_increasing_id().alias("id"), "r.doc_id", "r.n", "r.sketch"), 20_000)
    keys = F.expr(f"explode(transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(sketch, i * {2 * BUCKETS // BANDS} + 1, {2 * BUCKETS // BANDS}))))")
    bands = classes.select("id", keys.alias("key"))
    hubs = bands.groupBy("key").agg(F.min("id").alias("one"), F.min(F.struct(F.xxhash64("id").alias("h"), "id")).alias("two"), F.count("*").alias("size"))
    hubs = hubs.where("size > 1").selectExpr("key", "one", "two.id as two")
    shared = cut(bands.join(hubs, "key"))
    stars = shared.select("id", F.explode(F.array("one", "two")).alias("hub")).where("id <> hub").selectExpr("least(id, hub) as a", "greatest(id, hub) as b", "id").distinct()
    likely = cut(_likely(stars.select("a", "b").distinct(), classes, percent / 100))
    rank = F.expr("row_number() over (partition by id order by likeness desc, a, b)")
    best = likely.join(stars, ["a", "b"]).withColumn("rank", rank).where(F.col("rank") <= HUBS).select("a", "b").distinct()
    best = cut(best)
    asked = cut(best.selectExpr("explode(array(a, b)) as key").distinct())
    edges = _verified(best, _sets(asked, classes, docs, words, id_col, text_col), percent)
    joined = cut(components(edges))
    label = F.coalesce("component", "id")
    placed = shared.select("key", "one", "id").join(joined.withColumnRenamed("node", "id"), "id", "left").select("key", "one", "id", label.alias("c"))
    open_keys = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    groups = cut(placed.join(open_keys, "key", "left_semi").select("one", "id", "c").distinct())
    parts = groups.groupBy("one", "c").agg(F.count("*").alias("n"))
    sized = cut(parts.groupBy("one").agg(F.sum("n").alias("m"), F.count("*").alias("parts")).where("parts > 1"))
    few, many = sized.where(f"m <= {PAIRED}"), sized.where(f"m > {PAIRED}")
    loose = groups.join(few, "one", "left_semi")
    others = loose.alias("x").join(loose.alias("y"), F.expr("x.one = y.one and x.c < y.c")).selectExpr("least(x.id, y.id) as a", "greatest(x.id, y.id) as b").distinct()
    others = cut(_likely(others.join(best, ["a", "b"], "left_anti"), classes, percent / 100).select("a", "b"))
    crowd, crowds = counted(groups.join(many, "one", "left_semi").select("id", "c").distinct())
    asked = cut(others.selectExpr("explode(array(a, b)) as key").union(crowd.select("id")).distinct())
    held = _sets(asked, classes, docs, words, id_col, text_col)
    more = None
    if crowds:
        pairs, more = _crowded(crowd, held, percent)
        others = cut(_likely(pairs.join(best, ["a", "b"], "left_anti"), classes, percent / 100).select("a", "b").union(others).distinct())
    verified = _verified(others, held, percent)
    more = verified.union(more) if more else verified
    members = joined.select(F.col("node").alias("u"), F.col("component").alias("v"))
    joined = components(cut(more.union(members)))
    named = cut(classes.join(joined.withColumnRenamed("node", "id"), "id", "left").select("f1", "f2", "doc_id", label.alias("part")))
    firsts = named.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    named = named.drop("doc_id").join(firsts, "part")
    out = prints.select("doc_id", "n", "f1", "f2").join(named, ["f1", "f2"], "left")
    out = out.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).withColumn("component_id", F.expr("if(doc_id is null, null, component_id)"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "f1", "f2", "part")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of the documents that :func:`link` keeps: of each group
    the one with the smallest id. Of repeated rows of an id one stays, and one of each group if
    their texts differ; rows without an id stay."""
    linked = cut(_linked(docs, words, percent, id_col, text_col))
    known = linked.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("kept").alias("kept"), (F.min(F.struct("f1", "f2")) != F.max(F.struct("f1", "f2"))).alias("differ"))
    odd = cut(known.where("not kept or n > 1").selectExpr("doc_id", "not differ and not kept as gone", "differ"))
    gone, several, differ = odd.where("gone").select("doc_id"), odd.where("not gone and not differ").select("doc_id"), odd.where("differ").select("doc_id")
    few = odd.count() <= BROADCAST_ROWS
    whole = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.struct("*").alias("row"))
    left = whole.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")
    if several.count():
        once = left.join(several, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        left = left.join(several, "doc_id", "left_anti").unionByName(once)
    if differ.count():

        def prints(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([_print(shingles(t, words)) for t in texts], columns=["f1", "f2"], dtype="int64")

        ids = F.broadcast(differ) if few else differ
        texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct("*").alias("row")).join(ids, "doc_id", "left_semi")
        texts = texts.withColumn("p", F.pandas_udf(prints, "f1 bigint, f2 bigint")("text")).select("doc_id", "p.f1", "p.f2", "row")
        stay = linked.where("kept").join(ids, "doc_id", "left_semi").select("doc_id", "f1", "f2", "part").distinct()
        once = texts.join(stay, ["doc_id", "f1", "f2"]).dropDuplicates(["doc_id", "part"])
        left = left.join(ids, "doc_id", "left_anti").unionByName(once.select("doc_id", "row"))
    return left.select("row.*")


#: The query's result in SQL: sets of two-word shingles, all pairs by common shingles, and the
#: smallest id over links until nothing changes.
ORACLE = r"""
with recursive t as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as sh from t
),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as u, b.doc_id as v, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
e as (select u, v from p join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= 80 * (x.n + y.n - c)),
both_ways as (select u, v from e union all select v, u from e),
reach(doc_id, to_id) as (select doc_id, doc_id from t union select r.doc_id, b.v from reach r join both_ways b on b.u = r.to_id),
c as (select doc_id, min(to_id) as component_id from reach group by doc_id)
select t.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, t.doc_id = c.component_id as kept from t join c using (doc_id) left join n using (doc_id)
"""
