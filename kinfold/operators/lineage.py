"""Cutting a plan's lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session, as in tests, may do without: it
    gets a folder of its own, removed at its end."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="checkpoints")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the session's checkpoint folder, so that what is built on
    it neither computes it again nor depends on an executor."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def before(rows: DataFrame, group: str, order: list[str], flag: str | None = None) -> DataFrame:
    """``rows`` with ``before``: how many rows of the same ``group`` come earlier by ``order``, or
    how many of them have ``flag`` 1.

    All groups are sorted together over ranges, so no group is sorted in one task; a row's number
    is its place in its range plus what the ranges before hold of the group, one row a range.
    """
    keys = [group, *order]
    rows = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    rows = rows.withColumn("range", F.shiftright("at", 33))
    earlier = "rows between unbounded preceding and 1 preceding"
    starts = rows.groupBy(group, "range").agg(F.min("at").alias("low"), F.sum(flag).alias("n") if flag else F.count("*").alias("n"))
    starts = starts.withColumn("start", F.expr(f"coalesce(sum(n) over (partition by {group} order by range {earlier}), 0)")).drop("n")
    within = F.expr(f"coalesce(sum({flag}) over (partition by {group}, range order by at {earlier}), 0)") if flag else F.col("at") - F.col("low")
    whole = rows.join(F.broadcast(starts), [group, "range"])
    return whole.withColumn("before", (within + F.col("start")).cast("bigint")).drop("at", "range", "low", "start")
