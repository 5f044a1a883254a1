"""What several operators share."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a few dozen bytes up to which a counted table may be broadcast.
BROADCAST_ROWS = 100_000


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once a session. Workers that have it on
    their path run the same code from there; others could not import it."""
    context = spark.sparkContext
    if not getattr(context, "_kinfold_sent", False):
        root = Path(__file__).resolve().parent.parent
        path = Path(tempfile.mkdtemp(prefix="kinfold")) / "kinfold_sent.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(str(path))
        context._kinfold_sent = True


def released(run: Callable[[Iterator], Iterator], forget: Callable[[], None] | None = None) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches; at its end the worker, which may idle on, gives back what it
    remembered and the memory that Arrow holds on to."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        if forget:
            forget()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        if trim:
            trim(0)

    return whole


def folder(df: DataFrame) -> str:
    """The shared checkpoint folder, set now where none is. Only a local session, as in tests,
    may do without spark.checkpoint.dir: it gets a folder of its own, removed at its end."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            shared = tempfile.mkdtemp(prefix="checkpoints")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        context.setCheckpointDir(shared)
    return context._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read again."""
    path = f"{folder(df)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def cut(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there, so that a lost
    executor costs no recomputation. Only where no folder is set, as in tests, a local one is.

    The rows are counted as they are written; reading them takes no more tasks than one for
    ``rows`` rows, so that a small table does not go on in hundreds of near-empty pieces."""
    return counted(df, rows)[0]


def counted(df: DataFrame, rows: int = 100_000) -> tuple[DataFrame, int]:
    """:func:`cut` and the number of rows."""
    folder(df)
    seen = Observation()
    done = df.observe(seen, F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    return done.coalesce(max(1, -(-seen.get["n"] // rows))), seen.get["n"]


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of so many counted rows, marked for broadcast if that is within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def uniform(*columns) -> Column:
    """A number in [0, 1) that depends only on the columns' values."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(1 << 53))
