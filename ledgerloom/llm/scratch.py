"""Tables that cut lineage, in the folder that all executors share, and bounds on what is broadcast and on what a Python worker holds.

:func:`ledgerloom.sources.shared.shared_dir` tells which folder that is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.sources.shared import shared_dir

_written: list[str] = []
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other table has; Spark makes it on writing."""
    path = f"{shared_dir(spark)}/ledgerloom-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    if (held := _passing.get()) is not None:
        held.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The result no longer depends on what made it: a lost executor costs a
    reread of the file, never a rerun of the stages before.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _names(*tables: DataFrame) -> set[str]:
    """Names of the folders that these tables read, of those made here."""
    folders = {f.rpartition("/")[0].rpartition("/")[2] for df in tables for f in df.inputFiles()}
    return {f for f in folders if f.startswith("ledgerloom-")}


def _drop(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        _delete(spark, path)
        if path in _written:
            _written.remove(path)


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`stored`, once nothing reads them."""
    gone = _names(*tables)
    for df in tables[:1]:
        _drop(df.sparkSession, [p for p in _written if p.rpartition("/")[2] in gone])


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored in the block are deleted when it ends, but those that what is passed to the yielded function reads."""
    held: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(_names(df))
        return df

    token = _passing.set(held)
    try:
        yield keep
    finally:
        _passing.reset(token)
        outer = _passing.get()
        if outer is not None:
            outer += [p for p in held if p.rpartition("/")[2] in kept]
        _drop(spark, [p for p in held if p.rpartition("/")[2] not in kept])


def clear(spark: SparkSession) -> None:
    """Delete all tables that this process stored; DataFrames that read them are of no more use."""
    _drop(spark, list(_written))


#: What may be broadcast: tables of so many bytes, by :func:`table_bytes`.
BROADCAST_BYTES = 64 << 20


def _value_bytes(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long")
    if isinstance(kind, T.ArrayType):
        each = 8 + 16 * len(kind.elementType.fields) if isinstance(kind.elementType, T.StructType) else 16
        own = F.coalesce(F.size(value), F.lit(0)).cast("long") * each
        return own + F.coalesce(F.octet_length(F.array_join(value, "")), F.lit(0)) if isinstance(kind.elementType, T.StringType) else own
    return F.lit(0).cast("long")


def table_bytes(df: DataFrame) -> int:
    """Bytes of a table in memory, about: 16 for each row and column, and what strings and arrays hold besides."""
    more = sum((_value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(0).cast("long"))
    rows, held = df.agg(F.count("*"), F.sum(more)).first()
    return rows * 16 * (1 + len(df.columns)) + (held or 0)


def small(df: DataFrame) -> DataFrame:
    """``df``, with a broadcast hint only if it takes at most BROADCAST_BYTES (counted)."""
    return F.broadcast(df) if table_bytes(df) <= BROADCAST_BYTES else df


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` but those in ``gone`` (``id_col``, ``text_key``: the text's xxhash64), null ids alike."""
    gone = stored(gone.select(F.col(id_col).alias("gone_id"), F.col("text_key").alias("gone_key")).distinct(), "gone")
    on = [docs[id_col].eqNullSafe(gone["gone_id"]), F.xxhash64(docs[text_col]) == gone["gone_key"]]
    return docs.join(small(gone), on, "left_anti")


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch where the session has no bound of its own.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes: long texts make batches of few rows. A bound that the user set stays."""
    if ARROW_BYTES not in spark.conf.getAll:
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which after a task gives the memory that Arrow holds for reuse back: workers outlive their tasks."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return tidied


def by_bytes(batch: pa.RecordBatch, column: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose values in ``column`` take about ``limit`` bytes, a row at least."""
    values = batch.column(column)
    length = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    held = np.cumsum(pc.fill_null(length, 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(values):
        before = held[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(held, before + limit, "right")))
        yield batch.slice(start, end - start)
        start = end
