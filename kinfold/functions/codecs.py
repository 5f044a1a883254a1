"""Text keys of index buckets and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hex(n: Column, digits: int) -> Column:
    return F.lpad(F.hex(n.cast("bigint")), digits, "0")


def bucket_key(chunk: Column, value: Column) -> Column:
    """Base64 of the chunk's byte and the value's two, high byte first; more bits raise."""
    fits = chunk.between(0, 255) & value.between(0, 65535)
    key = F.base64(F.unhex(F.concat(_hex(chunk, 2), _hex(value, 4))))
    return F.when(fits, key).otherwise(F.raise_error(F.lit("a bucket has 8 bits of chunk and 16 of value")))


def id_key(id_: Column) -> Column:
    """Base64 of an unsigned 32-bit id, high byte first."""
    key = F.base64(F.unhex(_hex(id_, 8)))
    return F.when(id_.between(0, 4294967295), key).otherwise(F.raise_error(F.lit("an id has 32 bits")))


def key_id(key: Column) -> Column:
    """The id of such a key."""
    return F.conv(F.hex(F.unbase64(key)), 16, 10).cast("bigint")
