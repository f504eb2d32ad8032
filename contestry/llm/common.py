"""What the operators share: the checkpoint folder, size-checked broadcasts, Arrow batch sizes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch holds, so that a batch of long texts fits in a Python worker.
ARROW_ROWS = 512
#: Bytes after which an Arrow batch is full, whatever its rows: some texts are thousands of times the usual length.
ARROW_BYTES = 8 << 20
#: Largest number of rows, of a few dozen bytes each, that is ever broadcast.
BROADCAST_ROWS = 200_000
#: Spark's own setting by which a finished execution deletes its shuffle files; a written table needs them no more.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where written tables lie, and those that were written for the one that ``settled`` is making.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    A temporary folder is set only where the session names none, as in local tests.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        path = sc.getCheckpointDir() or f"file://{tempfile.mkdtemp(prefix='contestry-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it: a lost executor costs no recomputation.

    A written table rather than ``checkpoint()``: it is compressed, its size is known to the planner, and it
    starts a plan without the constraints of the old one, which multiply over the rounds of a loop.
    """
    spark = df.sparkSession
    path = scratch(spark, "cut")
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    made = _MADE.get()
    if made is not None:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(table: DataFrame) -> None:
    """Delete a table of ``cut`` from which all that follows has been written; other frames are left alone."""
    if table in _PATHS:
        _delete(table.sparkSession, _PATHS.pop(table))


def settled(build: Callable[[], DataFrame]) -> DataFrame:
    """``cut`` of what is built, after which the tables that were cut to build it go; nothing else may read them."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        df = build()
    finally:
        _MADE.reset(token)
    out = cut(df)
    for path in made:
        _delete(out.sparkSession, path)
    return out


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def give_back() -> None:
    """Freed memory goes back to the system, as workers are kept."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(run: Callable) -> Callable:
    """The same function over Arrow batches, with ``give_back`` at its end."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: other columns cannot clash."""
    return df.select(*[df[old].alias(new) for new, old in columns.items()])


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a check of the counted size; beyond it Spark shuffles both sides."""
    return F.broadcast(df) if rows <= limit else df


def ascii_lower(column):
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
