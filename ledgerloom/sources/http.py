"""Accounts and paged histories of an HTTP service, as a Spark data source.

Register :class:`HistorySource` and read ``spark.read.format("paged_history")``
with the options ``url`` (base), ``token``, ``accounts`` (ids joined by
commas), ``from``, ``to``, ``page_size``, ``start_page``, ``max_pages`` and
``timeout``.  Each account is a partition; its pages are walked in order, since
only a page's content tells whether there is another.  With ``mark_truncated`` there
is a column ``truncated``, true in the last row of a walk that ended at its cap, for
:class:`ledgerloom.operators.paging.TruncationWatch`.  Conditions on account
and date are passed to the service, and Spark applies them again.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual
from pyspark.sql.types import BooleanType, StructField, StructType

from ledgerloom.schemas import ACCOUNT, ACCOUNT_TYPES, DEFAULT_CURRENCY, TRANSACTION

# Limits of a request and of a walk.
TIMEOUT, PAGE_SIZE, MAX_PAGES, ERROR_CHARS = 30, 100, 50, 500
FIRST_DATE, LAST_DATE = "0000-00-00", "9999-99-99"


class HttpError(Exception):
    """A response that isn't a success, with the beginning of its body."""

    def __init__(self, status: int, reason: str, body: str) -> None:
        super().__init__(f"HTTP {status} {reason}: {body[:ERROR_CHARS]}")
        self.status = status


class SchemaError(ValueError):
    """A row that doesn't have the declared fields."""


def get_json(url: str, token: str | None = None, timeout: float = TIMEOUT) -> object:
    """The parsed body; None for an empty one and the text for one that isn't JSON."""
    headers = {"Accept": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as answer:
            text = answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        raise HttpError(e.code, e.reason, e.read().decode("utf-8", "replace")) from None
    try:
        return json.loads(text) if text else None
    except ValueError:
        return text


def typed(row: object, schema: StructType, optional: tuple[str, ...] = ()) -> tuple:
    """A JSON object as a row of ``schema``: unknown keys go, and a missing or ill-typed field is an error."""
    if not isinstance(row, dict):
        raise SchemaError(f"not an object: {str(row)[:80]}")
    out = []
    for f in schema:
        value = row.get(f.name)
        if f.name == "currency" and f.name not in row:
            value = DEFAULT_CURRENCY
        if f.name in optional and f.name not in row:
            out.append(None)
        elif isinstance(f.dataType, StructType):
            out.append(typed(value, f.dataType))
        elif f.dataType.typeName() == "double" and isinstance(value, (int, float)) and not isinstance(value, bool):
            out.append(float(value))
        elif f.dataType.typeName() == "string" and isinstance(value, str):
            out.append(value)
        else:
            raise SchemaError(f"{f.name} is {value!r}")
    return tuple(out)


def walk(fetch: Callable[[int], list], signature: Callable[[list], str], page_size: int | None = None, start_page: int = 0, max_pages: int = MAX_PAGES) -> Iterator[tuple[list, bool]]:
    """Pages with whether the walk ended at its cap with that page; see :func:`ledgerloom.operators.paging.walk_pages`."""
    seen: set[str] = set()
    for i in range(max_pages):
        page = fetch(start_page + i)
        mark = signature(page) if page else ""
        if not page or mark in seen:
            return
        seen.add(mark)
        short = page_size is not None and len(page) < page_size
        yield page, i + 1 == max_pages and not short
        if short:
            return


@dataclass
class _Account(InputPartition):
    account_id: str


@dataclass
class HistoryReader(DataSourceReader):
    options: dict[str, str]
    account_ids: list[str] | None = None
    bounds: dict[str, str] = field(default_factory=dict)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            match f:
                case EqualTo(("accountId",), value):
                    self.account_ids = [a for a in self._accounts() if a == value]
                case GreaterThanOrEqual(("date",), value):
                    self.bounds["from"] = max(self.bounds.get("from", FIRST_DATE), value)
                case LessThanOrEqual(("date",), value):
                    self.bounds["to"] = min(self.bounds.get("to", LAST_DATE), value)
        return filters  # a service may ignore what it is asked

    def _accounts(self) -> list[str]:
        return self.account_ids if self.account_ids is not None else [a for a in self.options.get("accounts", "").split(",") if a]

    def partitions(self) -> list[InputPartition]:
        return [_Account(a) for a in self._accounts()]

    def read(self, partition: _Account) -> Iterator[tuple]:
        o = self.options
        size, base = int(o.get("page_size", PAGE_SIZE)), o["url"].rstrip("/")
        start = max(o.get("from", FIRST_DATE), self.bounds.get("from", FIRST_DATE))
        end = min(o.get("to", LAST_DATE), self.bounds.get("to", LAST_DATE))

        def fetch(page: int) -> list[tuple]:
            query = urllib.parse.urlencode({"accountId": partition.account_id, "from": start, "to": end, "page": page, "pageSize": size})
            body = get_json(f"{base}/api/transactions?{query}", o.get("token"), float(o.get("timeout", TIMEOUT)))
            if not isinstance(body, list):
                raise SchemaError("the history isn't an array")
            return [typed(r, TRANSACTION, ("balanceAfter", "category")) for r in body]

        def signature(rows: list[tuple]) -> str:
            return chr(1).join(f"{r[2]}|{r[4][0]}|{r[3]}" for r in rows)

        for rows, capped in walk(fetch, signature, size, int(o.get("start_page", 0)), int(o.get("max_pages", MAX_PAGES))):
            if o.get("mark_truncated", "false").lower() == "true":
                rows = [(*r, capped and i + 1 == len(rows)) for i, r in enumerate(rows)]
            yield from rows


class HistorySource(DataSource):
    """Format ``paged_history``: transactions of the accounts named in the options."""

    @classmethod
    def name(cls) -> str:
        return "paged_history"

    def schema(self) -> StructType:
        marked = self.options.get("mark_truncated", "false").lower() == "true"
        return StructType([*TRANSACTION, StructField("truncated", BooleanType())]) if marked else TRANSACTION

    def reader(self, schema: StructType) -> HistoryReader:
        return HistoryReader(dict(self.options))


@dataclass
class AccountsReader(DataSourceReader):
    options: dict[str, str]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        body = get_json(self.options["url"].rstrip("/") + "/api/accounts", self.options.get("token"), float(self.options.get("timeout", TIMEOUT)))
        if not isinstance(body, list):
            raise SchemaError("the accounts aren't an array")
        for row in (typed(r, ACCOUNT, ("available",)) for r in body):
            if row[2] not in ACCOUNT_TYPES:
                raise SchemaError(f"type is {row[2]!r}")
            yield row


class AccountsSource(DataSource):
    """Format ``bank_accounts``: one list, so one partition."""

    @classmethod
    def name(cls) -> str:
        return "bank_accounts"

    def schema(self) -> StructType:
        return ACCOUNT

    def reader(self, schema: StructType) -> AccountsReader:
        return AccountsReader(dict(self.options))


def register(spark) -> None:
    """Make both formats known to a session, with filters passed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HistorySource)
    spark.dataSource.register(AccountsSource)
