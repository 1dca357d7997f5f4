"""Records inside arbitrary JSON: finding them, picking fields by name hints, and normalising to fixed schemas.

Finding the first record array depends on the order of keys, duplicates and
the kinds of values, which SQL functions on JSON don't keep.  So that step reads
the text in Python, but builds no value but one record at a time: records leave as rows
in Arrow batches of bounded size, however large the body.  ``json_records`` is
the same as a table function for SQL.  All that follows is column expressions.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterable, Iterator, Sequence
from json.decoder import scanstring

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import schemas
from ledgerloom.functions.scalars import guess_type, mask_number, to_iso_date, to_number
from ledgerloom.functions.urls import is_auth_rejection

_ENTRY = T.StructType([T.StructField(c, T.StringType()) for c in ("key", "kind", "val")])
_RECORD = T.StructType([T.StructField("ordinal", T.IntegerType()), T.StructField("record", T.ArrayType(_ENTRY))])
#: Records and characters after which a batch is handed on.
BATCH_RECORDS, BATCH_CHARS = 4096, 4 << 20
#: Why a response gives no account.
REJECTED, FAILED, NOT_JSON, NO_RECORDS = "rejected", "failed", "not_json", "no_records"
_INDEX = re.compile(r"0|[1-9][0-9]{0,9}")


def _ordered(pairs: list[tuple[str, object]]) -> dict[str, object]:
    """The last value of a repeated key in the first one's place; whole-number keys first, ascending."""
    found = dict(pairs)
    whole = [k for k in found if _INDEX.fullmatch(k) and int(k) < 2**32 - 1]
    return {k: found[k] for k in sorted(whole, key=int)} | found if whole else found


def _no_constant(name: str) -> object:
    raise ValueError(name)


_WHOLE = json.JSONDecoder(object_pairs_hook=_ordered, parse_constant=_no_constant)
_SKIP = json.JSONDecoder(object_pairs_hook=lambda pairs: None, parse_constant=_no_constant)  # checks a value and keeps no object of it
_BLANKS = re.compile(r"[ \t\n\r]*")


def _after(text: str, at: int) -> int:
    return _BLANKS.match(text, at).end()


def _next(text: str, at: int) -> int:
    """Past a value's end: where the next element or member begins, or the closing bracket."""
    at = _after(text, at)
    return _after(text, at + 1) if text[at] == "," else at


def _elements(text: str, at: int) -> list[int]:
    """Where the elements of the array at ``at`` begin."""
    found, at = [], _after(text, at + 1)
    while text[at] != "]":
        found.append(at)
        at = _next(text, _SKIP.raw_decode(text, at)[1])
    return found


def _members(text: str, at: int) -> list[int]:
    """Where the values of the object at ``at`` begin, in the order of :func:`_ordered`."""
    found, at = [], _after(text, at + 1)
    while text[at] != "}":
        key, at = scanstring(text, at + 1, True)
        at = _after(text, _after(text, at) + 1)
        found.append((key, at))
        at = _next(text, _SKIP.raw_decode(text, at)[1])
    return list(_ordered(found).values())


def json_start(text: str | None) -> int | None:
    """Where the value of a JSON text begins; None for null and for what isn't JSON."""
    if text is None:
        return None
    try:
        start = _after(text, 0)
        end = _SKIP.raw_decode(text, start)[1]
        return start if _after(text, end) == len(text) else None
    except (ValueError, RecursionError):
        return None


def find_records(text: str, start: int) -> int | None:
    """Where the first array begins whose elements are all objects or arrays, depth first in key order.

    ``text`` is JSON from ``start`` on.  Below the top an empty array doesn't count.
    """
    left = [iter([start])]
    while left:
        at = next(left[-1], None)
        if at is None:
            left.pop()
        elif text[at] == "{":
            left.append(iter(_members(text, at)))
        elif text[at] == "[":
            inner = _elements(text, at)
            if all(text[i] in "[{" for i in inner) and (inner or at == start):
                return at
            left.append(iter(inner))
    return None


def records_of(text: str | None) -> Iterator[dict | list]:
    """The records of a JSON text, one after the other; none if it has none or isn't JSON."""
    start = json_start(text)
    at = None if start is None else find_records(text, start)
    if at is None:
        return
    at = _after(text, at + 1)
    while text[at] != "]":
        record, at = _WHOLE.raw_decode(text, at)
        yield record
        at = _next(text, at)


def _number(value: float) -> str:
    """A double as text: the shortest digits, exponents from 1e21 and below 1e-6."""
    value = float(value)
    if value == int(value) and abs(value) < 1e21:
        return str(int(value))
    text = repr(value)
    if "e" not in text:
        return text
    digits, exponent = text.split("e")
    power = int(exponent)
    if -7 < power < 0:
        return f"{value:.{len(digits.replace('-', '').replace('.', '')) - 1 - power}f}"
    return f"{digits}e{power:+d}"


def _text(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return _number(value)
    if isinstance(value, list):
        return ",".join("" if x is None else _text(x) for x in value)
    return "[object Object]" if isinstance(value, dict) else str(value)


def _entry(key: str, value: object) -> dict[str, str | None]:
    kind = "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"
    return {"key": key, "kind": kind, "val": None if value is None else _text(value)}


def _entries(record: dict | list) -> list[dict[str, str | None]]:
    items = record.items() if isinstance(record, dict) else ((str(i), x) for i, x in enumerate(record))
    return [_entry(k, v) for k, v in items]


@F.udtf(returnType=_RECORD)
class JsonRecords:
    """``ordinal`` (from 0) and ``record``: the entries (key, kind, text) of each record of a JSON text."""

    def eval(self, body: str | None) -> Iterator[tuple]:
        for i, record in enumerate(records_of(body)):
            yield i, [tuple(e.values()) for e in _entries(record)]


def register(spark: SparkSession) -> None:
    """Make ``json_records(body)`` known to SQL: ``SELECT ... FROM t, LATERAL json_records(t.body)``."""
    spark.udtf.register("json_records", JsonRecords)


def _head(text: str | None) -> tuple[str | None, list[str] | None]:
    """What :func:`record_head` gives for one body."""
    first = list(itertools.islice(records_of(text), 3))
    start = None if first else json_start(text)
    parsed = first if first else None if start is None else _WHOLE.raw_decode(text, start)[0]
    sample = None if parsed is None else json.dumps(parsed, ensure_ascii=False, separators=(",", ":"))
    return sample, None if not first else list(first[0]) if isinstance(first[0], dict) else [str(i) for i in range(len(first[0]))]


@F.pandas_udf(T.StructType([T.StructField("sample", T.StringType()), T.StructField("keys", T.ArrayType(T.StringType()))]))
def record_head(body: pd.Series) -> pd.DataFrame:
    """What one parse tells: the first three records as JSON, or the whole body if there are no records, and the first record's keys.

    Both are null for a null body.
    """
    samples, keys = zip(*map(_head, body)) if len(body) else ((), ())
    return pd.DataFrame({"sample": pd.Series(samples, dtype=object), "keys": pd.Series(keys, dtype=object)})


record_head = record_head.asNondeterministic()  # so that Spark doesn't parse again for each use of its fields


def pick(record: Column, keys: Sequence[str]) -> Column:
    """The entry of the first of ``keys`` that the record has, whatever its case; its value may be null."""

    def of(key: str) -> Column:
        return F.get(F.filter(record, lambda e: F.lower(e["key"]) == key.lower()), F.lit(0))

    return F.coalesce(*map(of, keys))


def has_any_key(own: Column, keys: Sequence[str]) -> Column:
    """Whether a record's ``own`` keys have any of ``keys``, whatever its case."""
    low = F.transform(own, F.lower)
    return F.coalesce(F.arrays_overlap(low, F.array(*(F.lit(k.lower()) for k in keys))), F.lit(False))


def entry_number(entry: Column) -> Column:
    """A JSON number as it is, text by :func:`to_number`, anything else 0."""
    return F.when(entry["kind"] == "number", entry["val"].try_cast("double")).when(entry["kind"] == "string", to_number(entry["val"])).otherwise(F.lit(0.0))


def _record_batches(kept: Sequence[str], body_col: str, problems: bool):
    """Arrow batches with the columns ``kept``, ``ordinal`` and ``record``, a row a record; with ``problems`` a row besides for each body without any."""
    kind = pa.list_(pa.struct([(c, pa.string()) for c in ("key", "kind", "val")]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = batch.select(kept)
            rows, ordinals, found, held = [], [], [], 0

            def flush() -> pa.RecordBatch:
                columns = [*others.take(pa.array(rows, pa.int64())).columns, pa.array(ordinals, pa.int32()), pa.array(found, kind)]
                if not problems:
                    return pa.record_batch(columns, [*kept, "ordinal", "record"])
                missing = pa.array([None if r is not None else NOT_JSON if o else NO_RECORDS for o, r in zip(ordinals, found)], pa.string())
                columns[-2] = pa.array([None if r is None else o for o, r in zip(ordinals, found)], pa.int32())
                return pa.record_batch([*columns, missing], [*kept, "ordinal", "record", "problem"])

            for row, body in enumerate(batch.column(batch.schema.get_field_index(body_col))):
                text = body.as_py()
                if problems and next(records_of(text), None) is None:
                    rows.append(row)
                    ordinals.append(int(json_start(text) is None))
                    found.append(None)
                for i, record in enumerate(records_of(text)):
                    entries = _entries(record)
                    rows.append(row)
                    ordinals.append(i)
                    found.append(entries)
                    held += sum(len(e["key"]) + len(e["val"] or "") for e in entries)
                    if len(rows) >= BATCH_RECORDS or held >= BATCH_CHARS:
                        yield flush()
                        rows, ordinals, found, held = [], [], [], 0
            if rows:
                yield flush()

    return run


def explode_records(df: DataFrame, body_col: str) -> DataFrame:
    """All columns but the body, and ``ordinal`` (from 0), ``record`` for each record of each body."""
    kept = [c for c in df.columns if c != body_col]
    return df.mapInArrow(_record_batches(kept, body_col, False), T.StructType([*(df.schema[c] for c in kept), *_RECORD]))


def normalize_accounts(df: DataFrame, body_col: str = "body", keep: Sequence[str] = ()) -> DataFrame:
    """``keep``, ``ordinal`` and the fields of an account for each record with a balance.

    A null balance drops the record; one that is no number is 0.  A name that
    is there but null isn't looked for under another key.
    """
    return _accounts(explode_records(df.select(*keep, body_col), body_col), keep)


def _accounts(rows: DataFrame, keep: Sequence[str], anyway: Column | None = None) -> DataFrame:
    """Accounts of exploded records; rows for which ``anyway`` holds stay without a balance."""
    at = F.col("ordinal")
    name, number, balance = (pick(F.col("record"), k) for k in (schemas.NAME_KEYS, schemas.NUMBER_KEYS, schemas.BALANCE_KEYS))
    rows = rows.select(
        *keep, "ordinal",
        F.coalesce(name["val"], F.concat(F.lit("Cuenta "), at + 1)).alias("name"),
        F.coalesce(number["val"], F.lit("")).alias("full"),
        pick(F.col("record"), ("id",))["val"].alias("own_id"), balance.alias("entry"),
    )
    has_balance = F.col("entry.val").isNotNull()
    return rows.filter(has_balance if anyway is None else has_balance | anyway).select(
        *keep, "ordinal",
        F.when(F.col("full") != "", F.col("full")).otherwise(F.coalesce("own_id", F.concat(F.lit("acct-"), at + 1))).alias("id"),
        "name", guess_type(F.col("name")).alias("type"), mask_number(F.col("full")).alias("number"),
        F.struct(entry_number(F.col("entry")).alias("amount"), F.lit(schemas.DEFAULT_CURRENCY).alias("currency")).alias("balance"),
    )


def scan_accounts(responses: DataFrame, keep: Sequence[str] = ("seq",)) -> DataFrame:
    """Accounts of whole responses (``url, status, body`` and ``keep``), a row each, and a row with ``problem`` for a response that has none.

    The first that holds of: ``rejected`` (asked to log in), ``failed`` (no
    success), ``not_json``, ``no_records``.  The account's fields are null then.  Records
    without a balance are passed over, as :func:`normalize_accounts` does.
    """
    status = F.coalesce(F.col("status"), F.lit(0))
    refused = F.when(is_auth_rejection(status, F.col("url")), REJECTED).when(~status.between(200, 299), FAILED)
    judged = responses.select(*keep, "body", refused.alias("refused"))
    bad = judged.filter(F.col("refused").isNotNull()).select(*keep, F.col("refused").alias("problem"))
    good = judged.filter(F.col("refused").isNull()).select(*keep, "body")
    schema = T.StructType([*(good.schema[c] for c in keep), *_RECORD, T.StructField("problem", T.StringType())])
    parsed = good.mapInArrow(_record_batches(list(keep), "body", True), schema)
    found = _accounts(parsed, [*keep, "problem"], F.col("problem").isNotNull())
    sound = found.withColumns({c: F.when(F.col("problem").isNull(), F.col(c)) for c in ("id", "name", "type", "number", "balance")})
    return sound.unionByName(bad, allowMissingColumns=True)


def normalize_transactions(df: DataFrame, account_id: Column, body_col: str = "body", keep: Sequence[str] = (), id_offset: Column | None = None) -> DataFrame:
    """``keep``, ``ordinal`` and the fields of a transaction for each record with an amount, a null one counting as 0.

    Records without an id are numbered from ``id_offset``, skipped ones too.
    """
    offset = F.lit(0) if id_offset is None else id_offset
    rows = explode_records(df.select(*keep, body_col, account_id.alias("accountId"), offset.alias("id_offset")), body_col)
    found = transaction_fields(rows, [*keep, "accountId", "id_offset"])
    return found.select(*keep, "ordinal", synthetic_id(F.col("own_id"), F.col("id_offset"), F.col("ordinal")).alias("id"), "accountId", "date", "description", "amount")


def transaction_fields(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep, ordinal, own_id, date, description, amount`` of the exploded records that have an amount."""
    own_id, amount, date, name = (pick(F.col("record"), k) for k in (schemas.TRANSACTION_ID_KEYS, schemas.AMOUNT_KEYS, schemas.DATE_KEYS, schemas.NAME_KEYS))
    return rows.withColumn("entry", amount).filter(F.col("entry").isNotNull()).select(
        *keep, "ordinal", own_id["val"].alias("own_id"), to_iso_date(date["val"]).alias("date"), F.coalesce(name["val"], F.lit("—")).alias("description"),
        F.struct(entry_number(F.col("entry")).alias("amount"), F.lit(schemas.DEFAULT_CURRENCY).alias("currency")).alias("amount"),
    )


def synthetic_id(own_id: Column, offset: Column, ordinal: Column) -> Column:
    """A record's own id, or ``tx-`` and its number from 1: its place after the ``offset`` records before its page."""
    return F.coalesce(own_id, F.concat(F.lit("tx-"), offset + ordinal + 1))


def project_account(text: Column) -> Column:
    """An account's JSON as a struct of its declared fields and ``problem``: unknown keys go and a missing currency is the default.

    ``problem`` names the first field that is missing, null or of another
    type, or a type of account that isn't known; ``json`` stands for what is
    no object.  The other fields are null then.  ``available`` may be missing
    but not null.
    """
    whole = F.try_parse_json(text)

    def at(path: str) -> Column:
        return F.try_variant_get(whole, f"$.{path}", "variant")

    def kind(path: str) -> Column:
        """The JSON type; null for a missing field."""
        return F.when(at(path).isNotNull(), F.coalesce(F.schema_of_variant(at(path)), F.lit("VOID")))

    def string(path: str) -> Column:
        return F.when(kind(path) == "STRING", F.try_variant_get(whole, f"$.{path}", "string"))

    def number(path: str) -> Column:
        return F.when(kind(path).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(whole, f"$.{path}", "double"))

    def money(field: str) -> tuple[Column, Column]:
        currency = F.when(kind(f"{field}.currency").isNull(), F.lit(schemas.DEFAULT_CURRENCY)).otherwise(string(f"{field}.currency"))
        amount = number(f"{field}.amount")
        wrong = F.when(amount.isNull(), f"{field}.amount").when(currency.isNull(), f"{field}.currency")
        return F.struct(amount.alias("amount"), currency.alias("currency")), wrong

    fields = {c: string(c) for c in ("id", "name", "type", "number")}
    balance, no_balance = money("balance")
    available, no_available = money("available")
    is_object = lambda path: F.coalesce(kind(path).startswith("OBJECT"), F.lit(False))
    problem = F.when(~F.coalesce(F.schema_of_variant(whole).startswith("OBJECT"), F.lit(False)), "json")
    for c in ("id", "name"):
        problem = problem.when(fields[c].isNull(), c)
    problem = problem.when(~F.coalesce(fields["type"].isin(*schemas.ACCOUNT_TYPES), F.lit(False)), "type").when(fields["number"].isNull(), "number")
    problem = problem.when(~is_object("balance"), "balance").when(no_balance.isNotNull(), no_balance)
    problem = problem.when(kind("available").isNotNull() & ~is_object("available"), "available").when(is_object("available") & no_available.isNotNull(), no_available)
    sound = problem.isNull()
    out = {**fields, "balance": balance, "available": F.when(is_object("available"), available)}
    return F.struct(*(F.when(sound, x).alias(c) for c, x in out.items()), problem.alias("problem"))
