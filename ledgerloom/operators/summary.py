"""Accounts and transactions: net worth, lookups, ranges and what is displayed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.functions.scalars import format_money, pad_right


def net_worth(accounts: DataFrame) -> DataFrame:
    """``currency, total``: balances, those of cards and loans negated whatever their sign."""
    amount = F.col("balance.amount")
    signed = F.when(F.col("type").isin(*schemas.DEBT_TYPES), -amount).otherwise(amount)
    return accounts.groupBy(F.col("balance.currency").alias("currency")).agg(F.sum(signed).alias("total"))


def totals_map(accounts: DataFrame) -> DataFrame:
    """One row with ``totals``: a map from currency to net worth. Currencies are few."""
    return net_worth(accounts).agg(F.map_from_entries(F.collect_list(F.struct("currency", "total"))).alias("totals"))


def in_range(transactions: DataFrame, start: str = "0000-00-00", end: str = "9999-99-99", account_id: str | None = None) -> DataFrame:
    """Transactions with a date from ``start`` to ``end``, both included and compared as text."""
    found = transactions.filter(F.col("date").between(start, end))
    return found if account_id is None else found.filter(F.col("accountId") == account_id)


def first_match(rows: DataFrame, condition, order: str, columns: Sequence[str]) -> DataFrame:
    """The row that comes first in ``order`` of those that meet ``condition``; no row if none does."""
    return rows.filter(condition).orderBy(order).select(*columns).limit(1)


def account_display(accounts: DataFrame) -> DataFrame:
    return accounts.select("id", "name", "type", "number", format_money(F.col("balance.amount"), F.col("balance.currency")).alias("balance"))


def transaction_display(transactions: DataFrame) -> DataFrame:
    return transactions.select("date", F.left("description", F.lit(40)).alias("description"), format_money(F.col("amount.amount"), F.col("amount.currency")).alias("amount"))


def balance_display(accounts: DataFrame) -> DataFrame:
    return accounts.select(pad_right(F.col("number"), 10).alias("number"), pad_right(F.col("name"), 24).alias("name"), format_money(F.col("balance.amount"), F.col("balance.currency")).alias("balance"))


_ANSI = r"\x1b\[[0-9;]*m"


def text_table(rows: DataFrame, headers: Sequence[str]) -> DataFrame:
    """Cells padded to the widest of their column (colour codes don't count), joined by two spaces, as ``line``.

    Widths are one row of sums, so that the rows themselves never leave their
    partitions.  ``header`` and ``rule`` are the same in each row.
    """
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]
    width = lambda c: F.length(F.regexp_replace(c, _ANSI, ""))
    widths = rows.agg(*(F.greatest(F.lit(len(h)), F.max(width(c))).alias(f"w{i}") for i, (h, c) in enumerate(zip(headers, cells))))
    fill = lambda c, i: F.concat(c, F.repeat(F.lit(" "), F.greatest(F.col(f"w{i}") - width(c), F.lit(0))))
    joined = rows.crossJoin(F.broadcast(widths))  # one row
    return joined.select(
        F.concat_ws("  ", *(fill(F.lit(h), i) for i, h in enumerate(headers))).alias("header"),
        F.concat_ws("  ", *(F.repeat(F.lit("─"), F.col(f"w{i}")) for i in range(len(headers)))).alias("rule"),
        F.concat_ws("  ", *(fill(c, i) for i, c in enumerate(cells))).alias("line"),
    )
