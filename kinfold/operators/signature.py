"""Signatures: signed random projections of a record's weighted terms, cut into chunks.

A field's hyperplanes have one component per known term, so the planes are made once per term
and not once per occurrence, while they can be broadcast; beyond that a record's components are
made where its terms meet, as shipping a plane per occurrence would cost more than making it. A
record's sums add its terms' components times weights, term by term and then field by field; a
bit is set if the sum is not below zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import gauss
from kinfold.plans.definitions import SchemaDef

from .lineage import before, cut
from .vocabulary import Vocabulary, field_terms

#: Sums this little below zero count as zero; they are rounding noise of equal weights.
SLACK = 1e-9
#: Terms, known and unlearnt, up to which their numbers and weights may be broadcast.
BROADCAST_TERMS = 200_000
#: Bytes of planes up to which they may be broadcast.
BROADCAST_BYTES = 32_000_000
#: Unused since copies of a record are joined to the signature of their content; a test sets it.
TIMES = 10_000
#: Bytes of planes that one task gathers.
GATHERED_BYTES = 32_000_000


def quantised(index: Column, seed) -> Column:
    """The quantised component at an index, of a seed or of a provider of numbers by index."""
    return gauss.quantised(index, seed) if isinstance(seed, str) else gauss.compact(seed.get(index))


def planes(vocabulary: Vocabulary, seed=gauss.SEED) -> DataFrame:
    """(field_idx, term_idx, q): per known term the quantised component of every hyperplane."""
    count = vocabulary.schema.hash_count
    rows = vocabulary.table.join(F.broadcast(vocabulary.fields.select("field_idx", "field_offset")), "field_idx")
    index = lambda i: F.col("field_offset") + i * F.col("dim") + F.col("term_idx")
    return rows.select("field_idx", "term_idx", F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: quantised(index(i.cast("bigint")), seed)).alias("q"))


def weighted_terms(records: DataFrame, id_col: str, vocabulary: Vocabulary, oov: str = "reference") -> DataFrame:
    """(id, field_idx, pos, term, term_idx, weight) of every term occurrence, and a row without
    a term for a field that has none.

    An unlearnt term, '' included, takes the place of the next known term with an infinite
    weight; without a next term term_idx is null. With ``oov='ignore'`` neither has it, nor counts.
    """
    if oov not in ("reference", "ignore"):
        raise ValueError("oov is 'reference' or 'ignore'")
    terms = field_terms(records, vocabulary.schema, id_col, outer=True)
    known = vocabulary.table.select("field_idx", "term", "term_idx", "weight")
    count = vocabulary.counts.count()
    if oov == "ignore":
        return terms.join(F.broadcast(known) if count <= BROADCAST_TERMS else known, ["field_idx", "term"], "left")
    unknown = field_terms(records, vocabulary.schema, id_col).select("field_idx", "term").distinct().join(known, ["field_idx", "term"], "left_anti")
    both = known.select("field_idx", "term", F.lit(1).alias("known")).unionByName(unknown.select("field_idx", "term", F.lit(0).alias("known")))
    next_ = before(both, "field_idx", ["term"], "known").where("known = 0").join(F.broadcast(vocabulary.fields.select("field_idx", "dim")), "field_idx")
    guessed = next_.select("field_idx", "term", F.when(F.col("before") < F.col("dim"), F.col("before")).alias("term_idx"), F.lit(float("inf")).alias("weight"))
    guessed = cut(guessed)
    every = known.unionByName(guessed)
    return terms.join(F.broadcast(every) if count + guessed.count() <= BROADCAST_TERMS else every, ["field_idx", "term"], "left")


def _added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _field_sums(k: int, zero: Column) -> Column:
    own = F.filter("parts", lambda p: (p["field_idx"] == k) & p["q"].isNotNull())
    return F.aggregate(own, zero, lambda s, p: F.zip_with(s, p["q"], lambda x, q: x + p["weight"] * gauss.uncompact(q)))


def _made_sums(k: int, zero: Column, seed) -> Column:
    """The same from parts with the term's place in the first plane and the field's terms."""
    own = F.filter("parts", lambda p: (p["field_idx"] == k) & p["first"].isNotNull())
    at = lambda p, i: p["first"] + i.cast("bigint") * p["dim"]
    return F.aggregate(own, zero, lambda s, p: F.transform(s, lambda x, i: x + p["weight"] * gauss.uncompact(quantised(at(p, i), seed))))


def _by_content(records: DataFrame, schema: SchemaDef, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, content) of every record, and once for each content what the schema reads of a record,
    null as ''. A content is a digest of that; its column's name is longer than any other."""
    name = "_" * (1 + max(map(len, records.columns)))
    values = {a: F.coalesce(F.col(f"`{a}`").cast("string"), F.lit("")) for a in schema.attrs if a in records.columns}
    told = (x for v in values.values() for x in (F.length(v).cast("string"), F.lit(":"), v))
    content = F.unhex(F.sha2(F.concat(F.lit(""), *told), 256)).alias(name)
    once = records.select(content, *(v.alias(a) for a, v in values.items())).distinct()
    return records.select(F.col(id_col).alias("id"), content.alias("content")), once


def _content_sums(contents: DataFrame, vocabulary: Vocabulary, seed, oov: str) -> DataFrame:
    """(content, sums, sign_error) of contents, whose first column has their digests.

    Only the terms' numbers and weights are shuffled; planes that can be broadcast join them where
    they meet, in so many partitions that the planes of one take ``GATHERED_BYTES`` or so, others
    are made there."""
    schema, id_col = vocabulary.schema, contents.columns[0]
    terms = weighted_terms(contents, id_col, vocabulary, oov)
    shipped = vocabulary.counts.count() * schema.hash_count * 4 <= BROADCAST_BYTES
    if shipped:
        size = field_terms(contents, schema, id_col, outer=True).count() * schema.hash_count * 4
        rows = terms.repartition(1 + size // GATHERED_BYTES, "id").join(F.broadcast(planes(vocabulary, seed)), ["field_idx", "term_idx"], "left")
        part = F.struct("field_idx", "pos", "weight", "q")
    else:
        rows = terms.join(F.broadcast(vocabulary.fields.select("field_idx", "field_offset", "dim")), "field_idx", "left")
        part = F.struct("field_idx", "pos", "weight", (F.col("field_offset") + F.col("term_idx")).alias("first"), "dim")
    gathered = rows.groupBy("id").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max(F.col("term").isNotNull() & F.col("term_idx").isNull()).alias("failed"))
    zero = F.array_repeat(F.lit(0.0), schema.hash_count)
    total = zero
    for k in range(len(schema.fields)):
        total = _added(total, _field_sums(k, zero) if shipped else _made_sums(k, zero, seed))
    error = F.when(F.col("failed") & F.lit(oov == "reference"), F.lit("a term sorts after all that are known"))
    return gathered.select(F.col("id").alias("content"), total.alias("sums"), error.alias("sign_error"))


def sums(records: DataFrame, vocabulary: Vocabulary, seed=gauss.SEED, oov: str = "reference", id_col: str = "id") -> DataFrame:
    """(id, sums, sign_error): the projection on every hyperplane; an error for records with a
    term that sorts after all known ones. One row per record: records of one id are signed each
    by itself, and a repeated record has as many rows as it occurs.

    Sums are made once for all records of equal content and joined to their ids; contents of very
    many records are split by the engine's skew handling."""
    rows, contents = _by_content(records, vocabulary.schema, id_col)
    return rows.join(_content_sums(contents, vocabulary, seed, oov), "content").select("id", "sums", "sign_error")


def packed(sums_: Column, hash_count: int, width: int, slack: float = SLACK) -> Column:
    """Sums to chunks: bit j of chunk c is the side of hyperplane c * width + j. NaN gives 0, and
    hyperplanes that fill no whole chunk are left out."""
    chunks = F.sequence(F.lit(0), F.lit(hash_count // width - 1))

    def bit(c: Column, j: Column) -> Column:
        s = F.get(sums_, c * width + j)
        return F.when(~F.isnan(s) & (s >= -slack), F.call_function("shiftleft", F.lit(1).cast("bigint"), j)).otherwise(F.lit(0).cast("bigint"))

    return F.transform(chunks, lambda c: F.aggregate(F.sequence(F.lit(0), F.lit(width - 1)), F.lit(0).cast("bigint"), lambda a, j: a.bitwiseOR(bit(c, j))))


def sign(records: DataFrame, vocabulary: Vocabulary, seed=gauss.SEED, oov: str = "reference", id_col: str = "id", slack: float = SLACK) -> DataFrame:
    """(id, signature array<bigint>, sign_error) of every record; no signature where there is an error.
    ``seed`` is a text, or a provider whose ``get`` gives a number for an index."""
    schema = vocabulary.schema
    rows, contents = _by_content(records, schema, id_col)
    chunks = packed(F.col("sums"), schema.hash_count, schema.width, slack)
    signed = _content_sums(contents, vocabulary, seed, oov).select("content", F.when(F.col("sign_error").isNull(), chunks).alias("signature"), "sign_error")
    return rows.join(signed, "content").select("id", "signature", "sign_error")
