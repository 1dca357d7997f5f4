"""Views of the star-schema tables as accounts, transactions, payloads and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.paging import numbered

# The account type that stands for each market segment.
SEGMENT_TYPES = {"AUTOMOBILE": "credit_card", "BUILDING": "loan", "FURNITURE": "savings", "HOUSEHOLD": "checking", "MACHINERY": "investment"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as accounts: pesos for even keys, dollars for odd ones."""
    kind = F.coalesce(*(F.when(F.col("c_mktsegment") == s, t) for s, t in SEGMENT_TYPES.items()), F.lit("other"))
    currency = F.when(F.col("c_custkey") % 2 == 0, "COP").otherwise("USD")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("seq"), F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), kind.alias("type"),
        F.concat(F.lit("****"), F.right(F.lpad(F.col("c_custkey").cast("string"), 12, "0"), F.lit(4))).alias("number"),
        F.struct(F.col("c_acctbal").alias("amount"), currency.alias("currency")).alias("balance"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions in pesos; urgent ones are debits."""
    signed = F.when(F.col("o_orderpriority").startswith("1"), -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("accountId"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.concat_ws(" / ", F.lit("Order of priority"), "o_orderpriority", "o_orderstatus", F.lit("from the whole history")).alias("description"),
        F.struct(signed.alias("amount"), F.lit("COP").alias("currency")).alias("amount"),
    )


def account_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``c_nationkey, body``: each nation's customers as nested JSON payloads with Spanish keys, one for each 1,000 keys."""
    record = F.struct(
        F.col("c_custkey").alias("orden"), F.concat(F.lit("90"), F.col("c_custkey").cast("string")).alias("numeroProducto"), F.concat(F.lit("Cuenta de ahorros "), F.col("c_name")).alias("Nombre"),
        F.when(F.col("c_custkey") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("$ "), F.translate(F.format_number("c_acctbal", 2), ",.", ".,"))).alias("saldoDisponible"),
    )
    items = F.array_sort(F.collect_list(record))
    body = F.to_json(F.struct(F.lit("ok").alias("estado"), F.array(F.lit(1)).alias("codigos"), F.struct(items.alias("productos")).alias("data")), {"ignoreNullFields": "false"})
    return table(spark, sf_dir, "customer").groupBy("c_nationkey", F.expr("c_custkey div 1000").alias("chunk")).agg(body.alias("body")).drop("chunk")


def order_record() -> Column:
    """An order as JSON with Spanish keys; some lack an id, an amount or a description."""
    key = F.col("o_orderkey")
    return F.to_json(
        F.struct(
            key.alias("orden"), F.when(key % 3 != 0, key.cast("string")).alias("referencia"), F.when(key % 5 != 0, F.round("o_totalprice", 0).cast("long")).alias("valor"),
            F.date_format("o_orderdate", "dd/MM/yyyy").alias("fechaMovimiento"), F.when(key % 2 == 0, F.col("o_orderpriority")).alias("descripcion"),
        )
    )


#: Records of one payload of a history, and order keys that are numbered in one window.
PAYLOAD_RECORDS, NUMBERED = 1000, 1 << 16


def _order_pages(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """``o_custkey, page, body``: each customer's orders in pages of ``size`` from 0, as JSON arrays of :func:`order_record`."""
    placed = numbered(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", NUMBERED)
    items = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), order_record().alias("r"))))
    body = F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: x["r"]), ","), F.lit("]"))
    return placed.groupBy("o_custkey", F.floor(F.col("place") / size).cast("int").alias("page")).agg(body.alias("body"))


def transaction_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``o_custkey, id_offset, body``: each customer's orders in payloads of 1,000, and how many come before."""
    pages = _order_pages(spark, sf_dir, PAYLOAD_RECORDS)
    return pages.select("o_custkey", (F.col("page") * PAYLOAD_RECORDS).alias("id_offset"), "body")


def replayed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``account, page, body``: each customer's orders in pages of four from 1."""
    return _order_pages(spark, sf_dir, 4).select(F.col("o_custkey").cast("string").alias("account"), (F.col("page") + 1).alias("page"), "body")


def account_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``c_custkey, body``: each customer as the JSON of an account, with what is wrong or left to defaults by the key modulo 9."""
    case = (F.col("c_custkey") % 9).cast("int")
    quoted = lambda x: F.to_json(F.struct(x.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(x.alias("x")))) - 6)
    key = F.col("c_custkey").cast("string")
    amount = F.concat(F.lit('"amount":'), F.when(case == 3, '"12"').otherwise(key))
    currency = F.when(case == 1, "").when(case == 2, ',"currency":null').otherwise(',"currency":"USD"')
    parts = [
        F.concat(F.lit('"id":"'), key, F.lit('"')), F.when(case != 4, F.concat(F.lit('"name":'), quoted(F.col("c_name")))),
        F.concat(F.lit('"type":"'), F.when(case == 0, "crypto").otherwise("loan"), F.lit('"')), F.concat(F.lit('"number":'), F.when(case == 8, key).otherwise('"****1"')),
        F.concat(F.lit('"balance":{'), amount, currency, F.lit("}")), F.when(case == 5, '"available":{"amount":5}').when(case == 6, '"available":null'), F.when(case == 7, '"extra":{"a":[1]}'),
    ]
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("body"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as responses: three content types, two hosts, bodies with and without amounts."""
    key = F.col("event_id")
    path = F.when(key % 5 == 0, "/api/cuentas?x=").when(key % 5 == 1, "/api/movimientos?x=").otherwise("/api/data?x=")
    body = (
        F.when(key % 11 == 0, "no json")
        .when(key % 3 == 0, F.concat(F.lit('{"meta":[],"data":[{"Valor":'), F.col("user_id").cast("string"), F.lit("},{},{},{}]}")))
        .otherwise(F.concat(F.lit('{"props":'), F.col("props"), F.lit("}")))
    )
    return table(spark, sf_dir, "events").select(
        key.alias("seq"), F.concat(F.when(key % 4 == 0, "https://transaccion.example.org").otherwise("https://portal.example.com"), path, key.cast("string")).alias("url"),
        F.when(key % 2 == 0, "GET").otherwise("POST").alias("method"), F.lit(200).alias("status"),
        F.when(key % 7 == 0, "text/html").when(key % 7 == 1, F.lit(None)).otherwise("Application/JSON; charset=utf-8").alias("content_type"), body.alias("body"),
    )
