"""Dense, quantised and sparse vectors as columns.

Dense: array<double>. Quantised: array<int> of 16-bit steps. Sparse: struct<dimension:bigint,
components:array<struct<index:bigint,value:double>>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType, StructType

from . import gauss

SPARSE = "struct<dimension:bigint,components:array<struct<index:bigint,value:double>>>"
#: Bits of a signature; hyperplanes after these have no effect.
BITS = 16


def dense(v: Column) -> Column:
    """Any numeric array as a dense vector."""
    return F.transform(v, lambda x: x.cast("double"))


def quantise(v: Column) -> Column:
    return F.transform(v, gauss.compact)


def restore(q: Column) -> Column:
    return F.transform(q, gauss.uncompact)


def total(v: Column) -> Column:
    """The sum of an array, in order."""
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dimension(v: Column) -> Column:
    return F.size(v).cast("bigint")


def component(v: Column, i: Column | int) -> Column:
    """The i-th number (from 0), null beyond the end."""
    return F.get(v, F.lit(i) if isinstance(i, int) else i)


def _same(a: Column, b: Column, value: Column) -> Column:
    return F.when(a == b, value).otherwise(F.raise_error(F.lit("the vectors' dimensions differ")))


def dot(a: Column, b: Column) -> Column:
    """Of dense vectors; unequal dimensions raise."""
    return _same(F.size(a), F.size(b), total(F.zip_with(a, b, lambda x, y: x * y)))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def _cosine(product: Column, size: Column) -> Column:
    return F.when(size == 0, F.lit(float("nan"))).otherwise(product / F.when(size != 0, size))


def cosine(a: Column, b: Column) -> Column:
    """Of dense vectors; NaN if one is zero."""
    return _cosine(dot(a, b), norm(a) * norm(b))


def sparse(v: Column, least: float = 0.0) -> Column:
    """A dense vector's components above ``least`` in size."""
    at = F.transform(v, lambda x, i: F.struct(i.cast("bigint").alias("index"), x.cast("double").alias("value")))
    return F.struct(dimension(v).alias("dimension"), F.filter(at, lambda c: F.abs(c["value"]) > least).alias("components"))


def sparse_component(s: Column, i: Column | int) -> Column:
    """The first component at an index, 0 where there is none."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.coalesce(F.get(F.filter(s["components"], lambda c: c["index"] == i), F.lit(0))["value"], F.lit(0.0))


def sparse_norm(s: Column) -> Column:
    return F.sqrt(F.aggregate(s["components"], F.lit(0.0), lambda t, c: t + c["value"] * c["value"]))


def sparse_dot(a: Column, b: Column) -> Column:
    """Of sparse vectors with ascending indexes; an empty one gives 0."""
    other = F.map_from_entries(F.filter(b["components"], lambda c: c["value"] != 0))
    value = F.aggregate(a["components"], F.lit(0.0), lambda t, c: t + c["value"] * F.coalesce(F.try_element_at(other, c["index"]), F.lit(0.0)))
    return _same(a["dimension"], b["dimension"], value)


def mixed_dot(v: Column, s: Column) -> Column:
    """Of a dense and a sparse vector."""
    value = F.aggregate(s["components"], F.lit(0.0), lambda t, c: t + c["value"] * F.get(v, c["index"].cast("int")))
    return _same(dimension(v), s["dimension"], value)


def sparse_cosine(a: Column, b: Column) -> Column:
    return _cosine(sparse_dot(a, b), sparse_norm(a) * sparse_norm(b))


def _kind(rows: DataFrame, name: str) -> str:
    kind = rows.schema[name].dataType
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, NumericType):
        return "dense"
    if isinstance(kind, StructType) and kind.fieldNames() == ["dimension", "components"]:
        return "sparse"
    raise TypeError(f"{name} is no vector: {kind.simpleString()}")


def dot_of(rows: DataFrame, a: str, b: str) -> Column:
    """The inner product of two columns of ``rows``, dense or sparse each; others raise TypeError."""
    kinds = _kind(rows, a), _kind(rows, b)
    x, y = (dense(F.col(c)) if k == "dense" else F.col(c) for c, k in zip((a, b), kinds, strict=True))
    if kinds[0] == kinds[1]:
        return dot(x, y) if kinds[0] == "dense" else sparse_dot(x, y)
    return mixed_dot(x, y) if kinds[0] == "dense" else mixed_dot(y, x)


def cosine_of(rows: DataFrame, a: str, b: str) -> Column:
    """The cosine of two columns of ``rows``, dense or sparse each; NaN if one is zero."""
    size = lambda c: norm(dense(F.col(c))) if _kind(rows, c) == "dense" else sparse_norm(F.col(c))
    return _cosine(dot_of(rows, a, b), size(a) * size(b))


def random(size: int, seed: str = gauss.SEED, start: int = 0) -> Column:
    """A quantised normal vector: the components from ``start`` on."""
    return F.transform(F.sequence(F.lit(start), F.lit(start + size - 1)), lambda i: gauss.quantised(i, seed))


def planes(spark: SparkSession, count: int, size: int, seed: str = gauss.SEED) -> list[Column]:
    """``count`` random hyperplanes as literals: they are parameters, made once and not per row."""
    rows = gauss.components(spark, count * size, seed).orderBy("i").select("x").collect()
    return [F.lit([r.x for r in rows[k * size : (k + 1) * size]]) for k in range(count)]


def side(product: Column, slack: float = 0.0) -> Column:
    """Whether a point lies on a hyperplane's positive side; NaN doesn't."""
    return ~F.isnan(product) & (product >= -slack)


def hashed(v: Column, plane: Column) -> Column:
    """The side of a dense vector."""
    return side(dot(v, plane))


def signature(v: Column, planes: list[Column], slack: float = 0.0) -> Column:
    """Bit i is the side of the i-th plane, for the first BITS planes."""
    out = F.lit(0)
    for i, plane in enumerate(planes[:BITS]):
        out = out.bitwiseOR(F.when(side(dot(v, plane), slack), F.lit(1 << i)).otherwise(F.lit(0)))
    return out.cast("int")
