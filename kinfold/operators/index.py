"""The chunk index: postings (chunk, value, id), records, and queries by shared chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import cut

#: Rows (classes, pairs of classes, ids of probes, chunk values) up to which they may be broadcast.
BROADCAST_ROWS = 250_000
#: Matches that one task writes, where their number is known.
TASK_ROWS = 4_000_000


def chunks(signed: DataFrame) -> DataFrame:
    """(id, chunk_idx, chunk_val) of signed rows; a row without a signature has none.

    The chunks are tested after they are made: a test before would make the engine compute the
    signature once more, for the test."""
    rows = signed.select("id", F.posexplode_outer("signature").alias("chunk_idx", "chunk_val"))
    return rows.where("chunk_idx is not null")


def postings(signed: DataFrame, mode: str = "set") -> DataFrame:
    """(chunk_idx, chunk_val, id) of signed records; failed ones have none. In 'set' mode equal
    postings count once, in 'multiset' mode each counts."""
    if mode not in ("set", "multiset"):
        raise ValueError("mode is 'set' or 'multiset'")
    rows = chunks(signed).select("chunk_idx", "chunk_val", "id")
    return rows.distinct() if mode == "set" else rows


def latest(records: DataFrame, version: str = "version") -> DataFrame:
    """One row per id: the one of the highest version, of several always the same."""
    others = [c for c in records.columns if c not in ("id", version)]
    best = records.groupBy("id").agg(F.max_by(F.struct(*others), F.struct(version, F.xxhash64(F.lit(0), *others), F.xxhash64(F.lit(1), *others))).alias("r"))
    return best.select("id", *(f"r.{c}" for c in others))


def _small(rows: DataFrame, count: int) -> DataFrame:
    return F.broadcast(rows) if count <= BROADCAST_ROWS else rows


def _classes(rows: DataFrame, name: str, unique: bool) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Of rows (id, chunk_idx, chunk_val): (id, ``name``), ids of equal postings having the same
    class, a digest of these; the classes with a representative and their size; the postings of
    each class, which are those of its representative; the number of classes."""
    collect = F.collect_set if unique else F.collect_list
    told = F.array_sort(collect(F.struct("chunk_idx", "chunk_val"))).cast("string")
    ids = cut(rows.groupBy("id").agg(F.unhex(F.sha2(told, 256)).alias(name)))
    classes = cut(ids.groupBy(name).agg(F.min("id").alias("one"), F.count("*").alias("size")))
    count = classes.count()
    own = rows.join(_small(classes, count), F.col("id").eqNullSafe(F.col("one"))).select(name, "chunk_idx", "chunk_val")
    return ids, classes, own, count


def match(probes: DataFrame, stored: DataFrame, records: DataFrame | Callable[[DataFrame], DataFrame] | None = None, how: str = "inner", min_matches: int = 1, limit: int | None = None, unique: bool = False) -> DataFrame:
    """(query_id, id, attributes, matches), in no order: every id that shares a chunk with a probe,
    and how many it shares.

    ``probes`` are signed rows (id, signature), ``stored`` postings. ``records``, a DataFrame or
    what gives one for ids, has the attributes. ``how`` is what happens to ids without a record:
    'inner' drops them, 'left' leaves their attributes null. ``limit`` is per probe. With
    ``unique`` a posting that is stored several times counts once.

    Postings meet the probes' chunks first. Ids of equal postings are one class, and shared chunks
    are counted, and the best chosen, between classes; a pair of classes becomes pairs of ids in the
    end, without a shuffle of these while pairs of classes and probes can be broadcast. Chunks
    shared by very many classes are split by the engine's skew handling.
    """
    asked = chunks(probes)
    values = cut(asked.select("chunk_idx", "chunk_val").distinct())
    met = stored.join(_small(values, values.count()), ["chunk_idx", "chunk_val"], "left_semi").select("id", "chunk_idx", "chunk_val")
    queries, query_classes, query_chunks, n = _classes(asked, "query_class", unique)
    ids, classes, own_chunks, m = _classes(met, "class", unique)
    found = query_chunks.join(own_chunks, ["chunk_idx", "chunk_val"]).select("query_class", "chunk_idx", "class")
    found = (found.distinct() if unique else found).groupBy("query_class", "class").agg(F.count("*").alias("matches"))
    if min_matches > 1:
        found = found.where(F.col("matches") >= min_matches)
    few = n * m <= BROADCAST_ROWS
    found = F.broadcast(cut(found)) if few else found
    queries = _small(queries, queries.count()).withColumnRenamed("id", "query_id")
    if limit:
        place = "row_number() over (partition by {} id)"
        firsts = ids.withColumn("place", F.expr(place.format("class order by"))).where(F.col("place") <= limit).drop("place")
        best = firsts.join(found, "class").withColumn("place", F.expr(place.format("query_class order by matches desc,"))).where(F.col("place") <= limit)
        best = best.join(queries, "query_class").select("query_id", "id", "matches")
        if callable(records):
            best = cut(best)
            records = records(best)
        if records is None:
            return best
        attrs = [c for c in records.columns if c != "id"]
        return best.join(records, "id", how).select("query_id", "id", *attrs, "matches")
    if callable(records):
        records = records(ids if min_matches <= 1 else ids.join(found, "class", "left_semi"))
    attrs = [] if records is None else [c for c in records.columns if c != "id"]
    if records is not None:
        ids = ids.join(records, "id", how)
    if few:
        sizes = (c.select(k, F.col("size").cast("double").alias(f"size_{k}")) for c, k in ((query_classes, "query_class"), (classes, "class")))
        pairs = found
        for s in sizes:
            pairs = pairs.join(F.broadcast(s), s.columns[0])
        total = pairs.agg(F.sum(F.col("size_query_class") * F.col("size_class"))).first()[0] or 0
        if total > TASK_ROWS:
            ids = ids.repartition(1 + int(total // TASK_ROWS))
    return ids.join(found, "class").join(queries, "query_class").select("query_id", "id", *attrs, "matches")


def ranked(matches: DataFrame) -> DataFrame:
    """Best matches first, ties by id."""
    return matches.orderBy("query_id", F.desc("matches"), "id")


class Index:
    """An index in a folder. Every write appends; re-writing an id adds postings and replaces its
    attributes, older postings stay."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "set"):
        self.spark, self.path, self.mode = spark, path, mode

    def write(self, records: DataFrame, signed: DataFrame, version: int) -> None:
        """Append records (id, attributes) that could be signed. Writing the same version again,
        as a retry does, changes nothing in 'set' mode."""
        good = signed.where("sign_error is null").select("id")
        records.join(good, "id", "left_semi").withColumn("version", F.lit(version).cast("bigint")).write.mode("append").parquet(f"{self.path}/records")
        rows = postings(signed.where("sign_error is null"), self.mode)
        rows = rows.repartitionByRange("chunk_idx", "chunk_val").sortWithinPartitions("chunk_idx", "chunk_val")
        rows.write.mode("append").partitionBy("chunk_idx").parquet(f"{self.path}/postings")

    def stored(self) -> DataFrame:
        """The postings as they were written: sorted by chunk value, some of them several times."""
        return self.spark.read.parquet(f"{self.path}/postings").select(F.col("chunk_idx").cast("int"), "chunk_val", "id")

    def postings(self) -> DataFrame:
        return self.stored().distinct() if self.mode == "set" else self.stored()

    def records(self, ids: DataFrame | None = None) -> DataFrame:
        """The latest version of every record, or of those whose id is among ``ids``."""
        rows = self.spark.read.parquet(f"{self.path}/records")
        return latest(rows if ids is None else rows.join(ids.select("id").distinct(), "id", "left_semi"))

    def query(self, probes: DataFrame, best_first: bool = True, **options) -> DataFrame:
        """Matches of signed probes, best first unless told otherwise. A 'multiset' index keeps ids
        without a record. Of the index only what matches is compared: postings meet the probes
        before they are made unique, and of the records only those of matched ids are brought to
        their latest version."""
        how = "left" if self.mode == "multiset" else "inner"
        found = match(probes, self.stored(), self.records, how, unique=self.mode == "set", **options)
        return ranked(found) if best_first else found

    def fetch(self, ids: DataFrame) -> DataFrame:
        """The records of some ids; ids without one are left out."""
        return self.records(ids)
