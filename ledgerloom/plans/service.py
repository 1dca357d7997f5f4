"""What a user asks for: accounts with totals, a balance, a history, the session, the captures."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import is_expired, mask_user, preview
from ledgerloom.functions.urls import path_query, rescope, with_query_param
from ledgerloom.operators import paging, records, summary
from ledgerloom.sources.shared import work_folder


class NotFound(LookupError):
    pass


def date_range(start: str, end: str) -> tuple[str, str]:
    """Both dates, if they look like YYYY-MM-DD; neither the calendar nor their order is checked."""
    for value in (start, end):
        if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", value):
            raise ValueError(f"not a date: {value!r}")
    return start, end


def get_accounts(accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The accounts, and net worth by currency."""
    return accounts, summary.net_worth(accounts)


def get_balance(accounts: DataFrame, account_id: str, order: str) -> DataFrame:
    """Of the accounts of this id the first by ``order``, the column that has their order of arrival; an error if there is none."""
    found = summary.first_match(accounts, F.col("id") == account_id, order, accounts.columns)
    if not found.limit(1).count():
        raise NotFound(f"Account not found: {account_id}")
    return found


def get_transactions(transactions: DataFrame, account_id: str, start: str, end: str) -> DataFrame:
    return summary.in_range(transactions, *date_range(start, end), account_id)


def replay_url(url: str, account_id: str, start: str, end: str, page: int, page_param: str = "page") -> DataFrame:
    """One row ``url``: a captured URL for another account, range and page."""
    spark = SparkSession.getActiveSession()
    one = spark.createDataFrame([(url,)], "url string")
    return one.select(with_query_param(rescope(F.col("url"), account_id, start, end), page_param, str(page)).alias("url"))


def replayed_history(pages: DataFrame, start: str, end: str, account_id: str | None = None, start_page: int = 1, max_pages: int = paging.MAX_PAGES) -> DataFrame:
    """Transactions of replayed ``pages`` (``account, page, body``), with ``truncated``.

    With ``account_id`` they are the pages of one account and need no column
    for it.  A page is its records with an amount: one without any ends the
    walk, and pages are compared by these.  All rows bear the account's id;
    those out of the range go last.  Pages that the walk can't reach aren't
    parsed, the others once: their rows are stored in the shared folder
    before the walk, so the call runs a job.
    """
    if account_id is not None:
        pages = pages.withColumn("account", F.lit(account_id))
    near = pages.filter(F.col("page").between(start_page, start_page + max_pages - 1)).select("account", "page", "body")
    path = work_folder(pages.sparkSession, "history")
    records.transaction_fields(records.explode_records(near, "body"), ["account", "page"]).write.parquet(path)
    rows = pages.sparkSession.read.parquet(path)
    counts = rows.groupBy("account", "page").agg(F.count("*").alias("n"))
    offsets = paging.running_before(counts, ["account"], "page", "n")
    text = paging.signature_text(F.col("date"), F.col("amount.amount").cast("string"), F.col("description"))
    walked = paging.walk_pages(paging.page_signatures(rows, ["account"], "page", "ordinal", text), ["account"], start_page, None, max_pages)
    taken = rows.join(walked.select("account", "page", "truncated"), ["account", "page"]).join(offsets, ["account", "page"])
    numbered = taken.withColumn("id", records.synthetic_id(F.col("own_id"), F.col("before"), F.col("ordinal"))).filter(F.col("date").between(start, end))
    return numbered.select("page", "ordinal", "id", F.col("account").alias("accountId"), "date", "description", "amount", "truncated")


def session_info(sessions: DataFrame, now, keep: Sequence[str] = ()) -> DataFrame:
    """What may be shown of sessions, after the columns in ``keep``: never a token; users are masked."""
    return sessions.select(*keep, "method", mask_user(F.col("user")).alias("user"), "hasStorageState", "createdAt", "expiresAt", is_expired(F.col("expiresAt"), now).alias("expired"))


def capture_list(captures: DataFrame) -> DataFrame:
    return captures.orderBy("seq").select("status", "method", path_query(F.col("url")).alias("path"), preview(F.col("sample")).alias("sample"))
