"""What the operators share: the shared scratch folder, Arrow text helpers, table reading."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_folder

#: Bytes of text that one Python step holds at a time; a batch from Arrow is cut into slices of about this size.
SLICE_BYTES = 2 << 20
#: Rows of two or three numbers that are broadcast (some 80 bytes each in memory).
BROADCAST_ROWS = 500_000


def _written(df: DataFrame, at: str) -> DataFrame:
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts lineage like ``checkpoint()`` but keeps only compressed columns, so later steps read the columns they need,
    and a lost executor costs no recomputation of what came before.
    """
    return _written(df, f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}")


Keep = Callable[[DataFrame, str], DataFrame]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Keep]:
    """A ``materialize`` for steps in between: its tables are deleted at the end. What is read later must be written with the plain one."""
    at = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    number = 0

    def keep(df: DataFrame, label: str) -> DataFrame:
        nonlocal number
        number += 1
        return _written(df, f"{at}/{number}-{label}")

    try:
        yield keep
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def few(df: DataFrame) -> bool:
    """Whether a written table of short rows may be broadcast: it has at most BROADCAST_ROWS."""
    return df.count() <= BROADCAST_ROWS


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for a broadcast where ``few`` allows it; else Spark chooses."""
    return F.broadcast(df) if few(df) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def give_back() -> None:
    """Return what this Python worker has freed to the machine: idle workers of earlier steps should not hold it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library that Linux has
    if trim is not None:
        trim(0)


def sliced(batches: Iterator[pa.RecordBatch], column: str | int = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a slice holds about ``size`` bytes of ``column`` (one row at least)."""
    give_back()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * size / max(1, batch.column(column).nbytes)))
        for at in range(0, n, step):
            yield batch.slice(at, step)
    give_back()


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores added until no column has it (whatever the case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name

