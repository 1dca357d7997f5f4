"""Literal tables for demonstrations and tests: three accounts and a month of one's history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.schemas import ACCOUNT, TRANSACTION

# Fixed values.
ACCOUNTS = (
    ("ahorros-01", "Ahorros a la Mano", "savings", "****1234", (4_250_000.0, "COP"), (4_250_000.0, "COP")),
    ("corriente-01", "Cuenta Corriente", "checking", "****5678", (1_120_500.0, "COP"), None),
    ("tc-visa-01", "Tarjeta de Crédito Visa", "credit_card", "****9012", (890_000.0, "COP"), None),
)
TRANSACTIONS = (
    ("t1", "ahorros-01", "2026-07-03", "Nómina julio", (3_500_000.0, "COP"), (4_250_000.0, "COP"), "income"),
    ("t2", "ahorros-01", "2026-07-10", "Éxito supermercado", (-215_400.0, "COP"), None, "groceries"),
    ("t3", "ahorros-01", "2026-07-18", "Netflix", (-38_900.0, "COP"), None, "subscriptions"),
    ("t4", "ahorros-01", "2026-07-20", "Transferencia PSE", (-120_000.0, "COP"), None, "transfers"),
    ("t5", "ahorros-01", "2026-07-22", "Rappi", (-54_300.0, "COP"), None, "delivery"),
)


def accounts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ACCOUNTS, ACCOUNT)


def transactions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRANSACTIONS, TRANSACTION)
