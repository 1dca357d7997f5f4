"""Capture sessions: what arrives is accumulated once, endpoints are inferred as it does, and a hand-off ends it.

Both sinks write a batch under its number, so a batch that Spark runs again
after a failure replaces what it wrote before and adds nothing.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.types import StringType, StructField, StructType

from ledgerloom import schemas
from ledgerloom.functions.urls import url_matches

from .capture import captures, infer_endpoints

ENDPOINTS = StructType([StructField(c, StringType()) for c in ("accounts_url", "transactions_url")])


def write_batch(found: DataFrame, batch_id: int, out: str) -> None:
    """Put a batch in its own folder of ``out``; run again it replaces itself."""
    found.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")


def read_batches(spark: SparkSession, out: str) -> DataFrame:
    """All that a sink of :func:`write_batch` holds, with ``batch``."""
    return spark.read.parquet(out)


def _once(stream: DataFrame, out: str, checkpoint: str, mode: str, transform=lambda df: df) -> DataStreamWriter:
    def put(found: DataFrame, batch_id: int) -> None:
        write_batch(transform(found), batch_id, out)

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put)


def accumulate(responses: DataFrame, origin: str, out: str, checkpoint: str) -> DataStreamWriter:
    """The captures of a stream of responses, added to ``out`` once each whatever is run again."""
    return _once(captures(responses, origin), out, checkpoint, "append")


def first_seen(found: DataFrame) -> DataFrame:
    """``url, seq``: the first capture of each URL that has a hint; as a stream, its state is one row for each such URL."""
    hinted = url_matches(F.col("url"), schemas.TRANSACTION_URL_HINTS) | url_matches(F.col("url"), schemas.ACCOUNT_URL_HINTS)
    return found.filter(hinted).groupBy("url").agg(F.min("seq").alias("seq"))


def running_endpoints(responses: DataFrame, origin: str, out: str, checkpoint: str) -> DataStreamWriter:
    """After each batch the endpoints that all captures so far give, under the batch's number in ``out``."""
    return _once(first_seen(captures(responses, origin)), out, checkpoint, "complete", infer_endpoints)


def latest_endpoints(spark: SparkSession, out: str) -> DataFrame:
    """What :func:`running_endpoints` wrote last; a row of nulls before any batch."""
    found = read_batches(spark, out)
    return found.agg(*(F.max_by(c, "batch").alias(c) for c in ENDPOINTS.names))


class Progress(StreamingQueryListener):
    """Batches and rows that the queries of a session report; an event may come a little after its batch."""

    def __init__(self) -> None:
        self.batches: dict[tuple[str, int], int] = {}
        self.ended: set[str] = set()
        self.news = threading.Condition()

    def onQueryStarted(self, event) -> None:  # noqa: N802  Spark's names
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        with self.news:
            self.batches[str(event.progress.id), event.progress.batchId] = event.progress.numInputRows
            self.news.notify_all()

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self.news:
            self.ended.add(str(event.id))
            self.news.notify_all()


@dataclass
class CaptureSession:
    """Queries that run until :meth:`hand_off`; use it in a ``with`` block, which ends it in any case."""

    spark: SparkSession
    writers: list[DataStreamWriter]
    progress: Progress = field(default_factory=Progress)
    queries: list[StreamingQuery] = field(default_factory=list)

    def __enter__(self) -> CaptureSession:
        self.spark.streams.addListener(self.progress)
        self.queries = [w.trigger(processingTime="0 seconds").start() for w in self.writers]
        return self

    def hand_off(self, timeout: float = 30) -> dict[str, int]:
        """Take all that has arrived, then end; returns how many batches and rows each query is known to have read.

        What arrived before the call is in the sinks when it returns; an error of a query is raised.
        """
        for q in self.queries:
            q.processAllAvailable()
        ids = {str(q.id) for q in self.queries}
        for q in self.queries:
            q.stop()
        with self.progress.news:
            self.progress.news.wait_for(lambda: ids <= self.progress.ended, timeout)
        return {"batches": len(self.progress.batches), "rows": sum(self.progress.batches.values())}

    def __exit__(self, *error) -> None:
        for q in self.queries:
            q.stop()
        self.spark.streams.removeListener(self.progress)
