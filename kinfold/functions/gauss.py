"""Deterministic normal deviates by index, quantised to 16 bits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Quantised numbers cover [-8, 8) in steps of 1/4096.
LOW, STEPS = 8, 4096
SEED = "planes"


def compact(x: Column) -> Column:
    """A number as one of 65,536 steps; outside the range the nearest one."""
    return F.least(F.lit(65535), F.greatest(F.lit(0), F.floor((x + float(LOW)) * float(STEPS)))).cast("int")


def uncompact(q: Column) -> Column:
    return q / F.lit(float(STEPS)) - float(LOW)


def normal(index: Column, seed: str = SEED) -> Column:
    """The standard normal deviate of an index: Box-Muller on two halves of a digest."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), index.cast("bigint").cast("string")).cast("binary"))
    part = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("double")
    radius = F.sqrt(-2.0 * F.log((part(1) + 1.0) / 4294967297.0))
    return radius * F.cos(2 * math.pi * (part(9) / 4294967296.0))


def quantised(index: Column, seed: str = SEED) -> Column:
    return compact(normal(index, seed))


def component(index: Column, seed: str = SEED) -> Column:
    """What a hyperplane has at an index: the quantised deviate as a number."""
    return uncompact(quantised(index, seed))


def components(spark: SparkSession, count: int, seed: str = SEED) -> DataFrame:
    """(i, q, x): the first ``count`` components; write it as Parquet to keep them."""
    return spark.range(count).select(F.col("id").alias("i"), quantised(F.col("id"), seed).alias("q")).withColumn("x", uncompact(F.col("q")))
