"""Schemas and hint lists of accounts, transactions and captures."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.StructType([T.StructField("amount", T.DoubleType()), T.StructField("currency", T.StringType())])
ACCOUNT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("number", T.StringType()),
        T.StructField("balance", MONEY),
        T.StructField("available", MONEY),
    ]
)
TRANSACTION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("accountId", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("amount", MONEY),
        T.StructField("balanceAfter", MONEY),
        T.StructField("category", T.StringType()),
    ]
)
#: ``seq`` is the order of arrival; ``body`` is JSON text.
RESPONSE = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)

# Enumerations, defaults and key hints in priority order.
ACCOUNT_TYPES = ("savings", "checking", "credit_card", "loan", "investment", "other")
DEBT_TYPES = ("credit_card", "loan")
DEFAULT_CURRENCY = "COP"
ACCOUNT_URL_HINTS = ("cuenta", "account", "producto", "product", "saldo", "balance")
TRANSACTION_URL_HINTS = ("movimiento", "movim", "transaccion", "transaction", "extracto")
BALANCE_KEYS = ("saldo", "balance", "saldoDisponible", "availableBalance")
NUMBER_KEYS = ("numero", "number", "cuenta", "account", "numeroProducto")
NAME_KEYS = ("nombre", "name", "descripcion", "description", "alias", "producto")
AMOUNT_KEYS = ("valor", "amount", "monto", "importe")
DATE_KEYS = ("fecha", "date", "fechaTransaccion", "fechaMovimiento")
TRANSACTION_ID_KEYS = ("id", "referencia", "reference")
