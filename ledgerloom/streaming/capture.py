"""Responses that look like account data: one filter for batches and streams, and what it lets one infer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom import schemas
from ledgerloom.functions.urls import any_includes, same_origin, url_matches
from ledgerloom.operators.records import has_any_key, record_head


def looks_like_data(url: Column, first_keys: Column) -> Column:
    """A URL with an account or transaction hint, or a first record with a balance or an amount."""
    keys = (*schemas.BALANCE_KEYS, *schemas.AMOUNT_KEYS)
    return url_matches(url, schemas.ACCOUNT_URL_HINTS) | url_matches(url, schemas.TRANSACTION_URL_HINTS) | has_any_key(first_keys, keys)


def captures(responses: DataFrame, origin: str) -> DataFrame:
    """``seq, url, method, status, sample`` of the JSON responses of one origin that look like data."""
    json_only = responses.filter(any_includes(F.coalesce("content_type", F.lit("")), ("application/json",)) & same_origin(F.col("url"), origin))
    parsed = json_only.withColumn("head", record_head("body")).filter(F.col("head.sample").isNotNull())
    return parsed.filter(looks_like_data(F.col("url"), F.col("head.keys"))).select("seq", "url", "method", "status", F.col("head.sample").alias("sample"))


def infer_endpoints(found: DataFrame) -> DataFrame:
    """One row ``accounts_url, transactions_url``: the first captures whose URLs have the hints, in order of ``seq``.

    The accounts' URL is the first other than the transactions' one.  Both
    come from one row a URL, so what ``found`` holds is read once.
    """
    found = found.groupBy("url").agg(F.min("seq").alias("seq"))
    tx, acc = url_matches(F.col("url"), schemas.TRANSACTION_URL_HINTS), url_matches(F.col("url"), schemas.ACCOUNT_URL_HINTS)
    transactions = found.agg(F.min_by(F.when(tx, F.col("url")), F.when(tx, F.col("seq"))).alias("transactions_url"))
    rest = found.crossJoin(F.broadcast(transactions)).filter(acc & ~F.col("url").eqNullSafe(F.col("transactions_url")))  # one row
    accounts = rest.agg(F.min_by("url", "seq").alias("accounts_url"))
    return accounts.crossJoin(transactions)


def stream_captures(spark: SparkSession, folder: str, origin: str, out: str, checkpoint: str) -> StreamingQuery:
    """Filter JSON files of responses as they arrive in ``folder`` and append what is found to ``out`` as Parquet.

    The trigger takes all that is there and ends; progress is kept in
    ``checkpoint``, so another call continues from it.
    """
    responses = spark.readStream.schema(schemas.RESPONSE).json(folder)
    return captures(responses, origin).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
