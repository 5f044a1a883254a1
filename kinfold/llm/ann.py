"""Nearest neighbours by largest inner product with vantage-point trees, one tree per shard.

Inner products become distances by one added coordinate, sqrt(M^2 - |x|^2) with M the largest
norm (0 for a query), so the nearest point has the largest product and the triangle inequality
holds. A part is left out if ``factor`` times the least distance that the inequality allows
exceeds the distance of the k-th point found so far: factor 1 is exact, a larger factor prunes
more.

The upper levels of the tree are grown on a bounded sample and part all vectors into regions; a
region is dealt by hash into shards of bounded size, and each shard's tree is built once and
kept. Of equal vectors only the smallest ids can be among the nearest, and equal queries have
equal neighbours, so copies are searched once. A query first visits one shard of its region;
with the distance found there it visits only the shards that their region's bounds admit. A
shard that very many queries visit is handed out in several copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, cut, released, saved, ship, small

SHARD_ROWS = 16_384
#: Queries that one copy of a shard serves.
QUERY_ROWS = 65_536
LEAF = 512
#: Queries walked down a tree together.
BATCH = 1_024
#: Vectors on which the upper levels are grown, at most, and how many of them a region takes.
SAMPLE_ROWS, REGION_SAMPLE = 4_096, 16
#: Rounding of distances, as a share of the largest norm.
NOISE = 1e-7


def added(vectors: np.ndarray, top: float) -> np.ndarray:
    """``vectors`` with the coordinate that makes all norms ``top``."""
    return np.column_stack([vectors, np.sqrt(np.maximum(top * top - np.einsum("ij,ij->i", vectors, vectors), 0))])


def _vantage(points: np.ndarray, rows: np.ndarray, random: np.random.Generator) -> tuple[int, np.ndarray]:
    """The row, of a few, from which distances spread most, and its distances to all ``rows``."""
    far = lambda at, some: np.sqrt(np.maximum(((points[some] - points[at]) ** 2).sum(axis=1), 0))
    sample = random.choice(rows, min(64, len(rows)), replace=False)
    at = int(max(sample[:8], key=lambda p: far(p, sample).std()))
    return at, far(at, rows)


class VpTree:
    """A tree over the rows of ``points``, put in the tree's order (``order``: their old places).

    A node is a row of ``nodes``: start, end, vantage point's place, and of each child least and
    greatest distance and number (-1: a leaf). The median distance parts a node in two halves.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 0):
        self.random, self.leaf = np.random.default_rng(seed), leaf
        self.order, self.made = [], []
        self.grow(points, np.arange(len(points)))
        self.order = np.concatenate(self.order) if self.order else np.zeros(0, np.int64)
        place = np.empty(len(points), np.int64)
        place[self.order] = np.arange(len(points))
        self.nodes = np.array(self.made, np.float64).reshape(-1, 9)
        inner = self.nodes[:, 5] >= 0
        self.nodes[inner, 2] = place[self.nodes[inner, 2].astype(np.int64)]

    def grow(self, points: np.ndarray, rows: np.ndarray) -> int:
        number, start = len(self.made), sum(map(len, self.order))
        self.made.append([start, start + len(rows), 0, 0, 0, -1, 0, 0, -1])
        if len(rows) <= self.leaf:
            self.order.append(rows)
            return number
        at, d = _vantage(points, rows, self.random)
        half = np.argpartition(d, len(d) // 2)
        told: list[float] = []
        for part in (half[: len(d) // 2], half[len(d) // 2 :]):
            told += [d[part].min(), d[part].max(), self.grow(points, rows[part])]
        self.made[number][2:] = [at, *told]
        return number


class Search:
    """The k largest inner products, above ``floor``, of a batch of queries with the vectors of
    a tree (in its order)."""

    def __init__(self, nodes: np.ndarray, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int, factor: float, top: float):
        self.nodes, self.vectors, self.ids, self.queries, self.floor, self.k, self.factor = nodes, vectors, ids, queries, floor, k, factor
        self.shift = np.einsum("ij,ij->i", queries, queries) + top * top  # squared distance = shift - 2 * product
        self.slack = 1e-9 * max(1.0, top * math.sqrt(self.shift.max(initial=0.0)))
        self.noise = NOISE * top
        self.score = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.pruned = self.scanned = 0
        if len(vectors):
            self.visit(0, np.arange(len(queries)))

    def least(self, live: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[live, -1], self.floor[live])

    def visit(self, number: int, live: np.ndarray) -> None:
        start, end, at, *told = self.nodes[number]
        if told[2] < 0:
            self.scan(int(start), int(end), live)
            return
        children = told[:3], told[3:]
        d = np.sqrt(np.maximum(self.shift[live] - 2 * (self.queries[live] @ self.vectors[int(at)]), 0))
        least = [np.maximum(np.maximum(d - hi, lo - d) - self.noise, 0) for lo, hi, _ in children]
        first = np.where(least[0] == least[1], d > (children[0][1] + children[1][0]) / 2, least[0] > least[1])
        for late in (False, True):
            for side, (_, _, child) in enumerate(children):
                pick = (first == side) != late
                reach = np.sqrt(np.maximum(self.shift[live] - 2 * (self.least(live) - self.slack), 0))
                near = self.factor * least[side] <= reach
                self.pruned += int((pick & ~near).sum())
                pick &= near
                if pick.any():
                    self.visit(int(child), live[pick])

    def scan(self, start: int, end: int, live: np.ndarray) -> None:
        self.scanned += (end - start) * len(live)
        rough = self.queries[live] @ self.vectors[start:end].T
        least = self.least(live)
        if end - start > self.k:  # the k-th here bounds what can matter, too
            least = np.maximum(least, np.partition(rough, end - start - self.k, axis=1)[:, end - start - self.k])
        q, c = np.nonzero(rough >= least[:, None] - self.slack)
        if not len(q):
            return
        exact = np.einsum("ij,ij->i", self.queries[live[q]], self.vectors[start + c])
        hit = np.unique(q)
        q = np.concatenate([q, np.repeat(hit, self.k)])
        score = np.concatenate([exact, self.score[live[hit]].ravel()])
        found = np.concatenate([self.ids[start + c], self.found[live[hit]].ravel()])
        order = np.lexsort((found, -score, q))
        q, score, found = q[order], score[order], found[order]
        pick = np.searchsorted(q, hit)[:, None] + np.arange(self.k)
        self.score[live[hit]], self.found[live[hit]] = score[pick], found[pick]


@dataclass
class Upper:
    """The upper levels for vectors of one length: inner nodes (vantage point, limit, children)
    and so many regions, which count from ``base``."""

    top: float
    base: int
    points: np.ndarray  # with the added coordinate
    limit: np.ndarray
    child: np.ndarray  # a node's number, or -1 - region
    regions: int

    @classmethod
    def grown(cls, sample: np.ndarray, top: float, base: int, regions: int) -> Upper:
        points, random = added(sample, top), np.random.default_rng(len(sample))
        vantage, limit, child, made = [], [], [], []

        def grow(rows: np.ndarray, regions: int) -> int:
            if regions < 2 or len(rows) < 2 * REGION_SAMPLE:
                made.append(rows)
                return -len(made)
            number = len(limit)
            at, d = _vantage(points, rows, random)
            inner = np.sort(d)[len(d) // 4 : -(len(d) // 4)]  # the widest gap near the median
            gap = np.diff(inner).argmax()
            middle = float((inner[gap] + inner[gap + 1]) / 2)
            vantage.append(points[at])
            limit.append(middle)
            child.append([0, 0])
            for side, part in enumerate((rows[d <= middle], rows[d > middle])):
                child[number][side] = grow(part, regions // 2 + (regions % 2 and side))
            return number

        grow(np.arange(len(points)), regions)
        wide = sample.shape[1] + 1
        return cls(top, base, np.array(vantage).reshape(-1, wide), np.array(limit), np.array(child, np.int64).reshape(-1, 2), len(made))

    def distances(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """From each vector to each inner node's vantage point."""
        if not len(self.limit):
            return np.zeros((len(vectors), 0))
        x = np.column_stack([vectors, np.zeros(len(vectors))]) if query else added(vectors, self.top)
        total = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", self.points, self.points)
        return np.sqrt(np.maximum(total - 2 * x @ self.points.T, 0))

    def region(self, d: np.ndarray) -> np.ndarray:
        """The region of each row of distances, from ``base``."""
        at = np.full(len(d), 0 if len(self.limit) else -1)
        while (at >= 0).any():
            live = np.flatnonzero(at >= 0)
            node = at[live]
            at[live] = self.child[node, (d[live, node] > self.limit[node]).astype(np.int64)]
        return -1 - at + self.base


def _stacked(batch: pa.RecordBatch, ids: int, vectors: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, ids, vectors) for each length of vector in a batch."""
    lists = batch.column(vectors)
    sizes = np.diff(lists.offsets.to_numpy())
    starts = lists.offsets.to_numpy()[:-1]
    values, keys = lists.values.to_numpy(), batch.column(ids).to_numpy()
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, keys[at], values[starts[at][:, None] + np.arange(n)]


def _lists(rows: np.ndarray, kind: pa.DataType = pa.float64()) -> pa.Array:
    """The rows of a matrix as an array of lists."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel(), kind))


_ROW = "region int, sub int, salt int, at int, id bigint, v array<double>, told binary, floor double"
_NAMES = ["region", "sub", "salt", "at", "id", "v", "told", "floor"]
_HIT = "id bigint, hits array<struct<score:double,vec_id:bigint>>"


def _parted(rows: DataFrame, uppers: dict[int, Upper], query: bool) -> DataFrame:
    """``rows`` (id, v) with their region."""
    if all(u.regions == 1 for u in uppers.values()):
        only = F.expr("case size(v) " + " ".join(f"when {n} then {u.base}" for n, u in uppers.items()) + " end") if uppers else F.lit(None)
        return rows.select("id", "v", only.cast("int").alias("region")).where("region is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 4_096):
                batch = whole.slice(k, 4_096)
                region = np.zeros(batch.num_rows, np.int32)
                for at, _, x in _stacked(batch, 0, 1):
                    upper = uppers.get(x.shape[1])
                    region[at] = upper.region(upper.distances(x, query)) if upper else -1
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(region)], ["id", "v", "region"])

    return rows.select("id", "v").mapInArrow(released(run), "id bigint, v array<double>, region int").where("region >= 0")


def _gathered(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of equal leading columns, batch by batch: (key, the part of a batch)."""
    for batch in batches:
        if batch.num_rows:
            cols = [batch.column(k).to_numpy() for k in range(keys)]
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(new)
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                yield tuple(int(c[a]) for c in cols), batch.slice(a, b - a)


def _trees(assigned: DataFrame, uppers: dict[int, Upper], leaf: int) -> DataFrame:
    """Each shard's vectors in their tree's order, after a row with the nodes (``told``) and the
    least and greatest distances to the upper levels' vantage points (``v``)."""
    of_region = {u.base + r: u for u in uppers.values() for r in range(u.regions)}

    def made(key: tuple, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (region, sub), upper = key, of_region[key[0]]
        ids, x = (np.concatenate(c) for c in zip(*((i, v) for p in parts for _, i, v in _stacked(p, 2, 3))))
        d = upper.distances(x, False)
        bounds = np.concatenate([d.min(axis=0), d.max(axis=0)])[None]
        tree = VpTree(added(x, upper.top), leaf, len(x))
        yield _batch(region, sub, [-1], [0], _lists(bounds), tree.nodes.tobytes())
        for a in range(0, len(x), 4_096):
            at = np.arange(a, min(a + 4_096, len(x)))
            yield _batch(region, sub, at, ids[tree.order[at]], _lists(x[tree.order[at]]), None)

    def _batch(region: int, sub: int, at, ids, v: pa.Array, told: bytes | None) -> pa.RecordBatch:
        n = len(v)
        same = lambda x: pa.array(np.full(n, x, np.int32))
        return pa.RecordBatch.from_arrays([same(region), same(sub), same(0), pa.array(np.asarray(at, np.int32)), pa.array(np.asarray(ids, np.int64)), v, pa.array([told] * n, pa.binary()), pa.nulls(n, pa.float64())], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []
        for key, part in _gathered(batches, 2):
            if key != last and parts:
                yield from made(last, parts)
                parts = []
            last = key
            parts.append(part)
        if parts:
            yield from made(last, parts)

    rows = assigned.select("region", "sub", "id", "v").repartition("region", "sub").sortWithinPartitions("region", "sub")
    return rows.mapInArrow(released(run), _ROW)


def _searched(trees: DataFrame, asks: DataFrame, uppers: dict[int, Upper], k: int, factor: float, query_rows: int) -> DataFrame:
    """(id, hits): what each ask (region, sub, id, v, floor) finds in its shard, nearest first."""
    tops = {u.base + r: u.top for u in uppers.values() for r in range(u.regions)}
    counts = small(*counted(asks.groupBy("region", "sub").agg(F.expr(f"cast(ceil(count(*) / {float(query_rows)}D) as int)").alias("copies"))))
    points = trees.drop("salt").join(counts, ["region", "sub"]).withColumn("salt", F.explode(F.expr("sequence(0, copies - 1)"))).select(*_NAMES)
    dealt = asks.join(counts, ["region", "sub"]).withColumns({"salt": F.expr("cast(pmod(xxhash64(id), copies) as int)"), "at": F.lit(2**31 - 1), "told": F.lit(None).cast("binary")}).select(*_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = nodes = tree = None
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for key, part in _gathered(batches, 3):
            if key != last:
                last, nodes, tree, parts = key, None, None, []
            at = part.column(3).to_numpy()
            if at[0] == -1:
                nodes = np.frombuffer(part.column(6)[0].as_py(), np.float64).reshape(-1, 9)
                part, at = part.slice(1), at[1:]
            asked = int(np.searchsorted(at, 2**31 - 1))
            if asked:
                parts += [(i, v) for _, i, v in _stacked(part.slice(0, asked), 4, 5)]
            part = part.slice(asked)
            if not part.num_rows:
                continue
            if tree is None:
                tree = tuple(np.concatenate(c) for c in zip(*parts))
                parts = []
            floor = part.column(7).to_numpy()
            for at, ids, q in _stacked(part, 4, 5):
                for a in range(0, len(ids), BATCH):
                    some = slice(a, a + BATCH)
                    s = Search(nodes, tree[1], tree[0], q[some], floor[at[some]], k, factor, tops[key[0]])
                    seen = s.score > -np.inf
                    hits = pa.StructArray.from_arrays([pa.array(s.score[seen]), pa.array(s.found[seen])], ["score", "vec_id"])
                    offsets = np.concatenate(([0], np.cumsum(seen.sum(axis=1)))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.ListArray.from_arrays(pa.array(offsets), hits)], ["id", "hits"])

    keys = ["region", "sub", "salt"]
    return points.unionByName(dealt).repartition(*keys).sortWithinPartitions(*keys, "at").mapInArrow(released(run), _HIT)


def _admitted(queries: DataFrame, uppers: dict[int, Upper], bounds: dict[int, tuple[np.ndarray, np.ndarray]], factor: float) -> DataFrame:
    """``queries`` (id, v, floor) with the regions that their bounds don't rule out, one a row,
    and whether it is the query's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1_024):
                batch = whole.slice(k, 1_024)
                floor = batch.column(2).to_numpy()
                for at, ids, q in _stacked(batch, 0, 1):
                    upper = uppers[q.shape[1]]
                    d = upper.distances(q, True)
                    own = upper.region(d)
                    reach = np.sqrt(np.maximum(np.einsum("ij,ij->i", q, q) + upper.top**2 - 2 * floor[at] + 2e-9 * max(1.0, upper.top**2), 0))
                    for region in range(upper.base, upper.base + upper.regions):
                        if region not in bounds:
                            continue
                        lo, hi = bounds[region]
                        least = np.maximum(lo - d, d - hi).max(axis=1, initial=0) - NOISE * upper.top
                        live = np.flatnonzero(factor * np.maximum(least, 0) <= reach)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[live]), _lists(q[live]), pa.array(floor[at[live]]), pa.array(np.full(len(live), region, np.int32)), pa.array(own[live] == region)], ["id", "v", "floor", "region", "own"])

    return queries.select("id", "v", "floor").mapInArrow(released(run), "id bigint, v array<double>, floor double, region int, own boolean")


def nearest(df: DataFrame, every: int = 20, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, leaf: int = LEAF, sample_rows: int = SAMPLE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k nearest of every row whose id is divisible by ``every``, among all other rows.

    Returns query_id, rank (from 1), vec_id, score: the inner product in double precision on
    the vectors as given; ties go to the smaller id. Ids that are null and vectors that are
    null, zero or hold null or non-finite components take no part. Vectors are compared with
    those of the same length only. A repeated id counts once, with its smallest vector. With
    fewer than k candidates all are returned; an empty table gives an empty result. A factor
    above 1 loses neighbours where norms vary. The other parameters part the work and change no
    result: rows of a shard and of a tree's leaf, vectors that are sampled for the upper levels,
    queries per copy of a shard.
    """
    ship(df.sparkSession)
    double = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), double.alias("v")).where("id is not null and v is not null")
    rows = rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    rows = cut(rows.groupBy("id").agg(F.min("v").alias("v")).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")}))
    members = rows.where(F.col("id") % every == 0)
    queries = cut(members.groupBy("h1", "h2").agg(F.min(F.struct("id", "v")).alias("q")).select("h1", "h2", "q.id", "q.v"))
    points = rows.withColumn("copy", F.expr("row_number() over (partition by h1, h2 order by id)")).where(F.col("copy") <= k + 1).select("id", "v")
    norm = F.expr("sqrt(aggregate(v, 0D, (s, x) -> s + x * x))")
    told = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"), F.max(norm).alias("top")).orderBy("size").collect()
    sample: dict[int, list] = {}
    if any(t.n > shard_rows for t in told):
        for r in rows.orderBy(F.xxhash64("id", F.lit(2)), "id").limit(sample_rows).select("v").collect():
            sample.setdefault(len(r.v), []).append(r.v)
    uppers, base = {}, 0
    for t in told:
        uppers[t["size"]] = Upper.grown(np.array(sample.get(t["size"], []), np.float64).reshape(-1, t["size"]), t.top * (1 + 1e-12), base, math.ceil(t.n / shard_rows))
        base += uppers[t["size"]].regions
    assigned = _parted(points, uppers, False)
    if base == len(uppers):
        subs = {uppers[t["size"]].base: math.ceil(t.n / shard_rows) for t in told}
    else:
        assigned = cut(assigned)
        subs = {r.region: math.ceil(r.n / shard_rows) for r in assigned.groupBy("region").agg(F.count("*").alias("n")).collect()}
    count = F.get(F.array(*(F.lit(subs.get(r, 0)) for r in range(max(1, base)))), "region")
    assigned = assigned.withColumn("sub", F.pmod(F.xxhash64("id"), count).cast("int"))
    trees = saved(_trees(assigned, uppers, leaf))
    # a query whose own region holds no vector starts in none
    asks = _parted(queries, uppers, True).where(count > 0).withColumns({"sub": F.lit(0), "floor": F.lit(float("-inf"))})
    found = _searched(trees, asks, uppers, k + 1, factor, query_rows)
    if sum(subs.values()) > 1:
        found = cut(found)
        ends = trees.where("at = -1").select("region", F.expr("slice(v, 1, int(size(v) / 2)) as lo"), F.expr("slice(v, int(size(v) / 2) + 1, int(size(v) / 2)) as hi"))
        ends = ends.select("region", F.posexplode_outer(F.arrays_zip("lo", "hi")).alias("pos", "b")).groupBy("region", "pos").agg(F.min("b.lo").alias("lo"), F.max("b.hi").alias("hi")).orderBy("region", "pos").collect()
        bounds = {r: tuple(np.array([e[c] for e in ends if e.region == r and e.pos is not None]) for c in ("lo", "hi")) for r in {e.region for e in ends}}
        floors = found.select("id", F.when(F.size("hits") > k, F.element_at("hits", -1)["score"]).otherwise(F.lit(float("-inf"))).alias("floor"))
        known = queries.join(floors, "id", "left").na.fill(float("-inf"), ["floor"])
        more = _admitted(known, uppers, bounds, factor).withColumn("sub", F.explode(F.sequence(F.lit(0), count - 1))).where("not (own and sub = 0)").drop("own")
        found = found.unionByName(_searched(trees, cut(more), uppers, k + 1, factor, query_rows))
    best = found.select("id", F.explode("hits").alias("h")).select("id", "h.score", "h.vec_id").withColumn("place", F.expr("row_number() over (partition by id order by score desc, vec_id)")).where(F.col("place") <= k + 1)
    lists = best.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("hits"))
    whole = members.select(F.col("id").alias("query_id"), "h1", "h2").join(queries.select("h1", "h2", "id"), ["h1", "h2"]).join(lists, "id")
    others = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    return whole.select("query_id", F.posexplode(others).alias("rank", "h")).select("query_id", (F.col("rank") + 1).alias("rank"), "h.vec_id", "h.score")
