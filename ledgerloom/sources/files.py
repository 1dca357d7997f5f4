"""State kept as JSON: captures, endpoints and strict account or transaction files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerloom.schemas import ACCOUNT_TYPES, DEFAULT_CURRENCY


def read_strict(spark: SparkSession, path: str, schema: StructType, lines: bool = False) -> DataFrame:
    """Files of one JSON array or object each, or of an object a ``lines``, with exactly typed fields; one bad row fails the read."""
    return spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST").json(path)


def checked_accounts(accounts: DataFrame) -> DataFrame:
    """Accounts with the default currency filled in; an unknown type or a missing field fails the job.

    A null currency is taken as a missing one here, since columns don't tell
    them apart; :func:`ledgerloom.operators.records.project_account` does.
    """
    known = F.coalesce(F.col("type").isin(*ACCOUNT_TYPES), F.lit(False))
    whole = F.col("id").isNotNull() & F.col("name").isNotNull() & F.col("number").isNotNull() & F.col("balance.amount").isNotNull()
    money = lambda c: F.struct(F.col(f"{c}.amount").alias("amount"), F.coalesce(f"{c}.currency", F.lit(DEFAULT_CURRENCY)).alias("currency"))
    filled = accounts.withColumn("balance", money("balance")).withColumn("available", F.when(F.col("available").isNotNull(), money("available")))
    whole = whole & (F.col("available").isNull() | F.col("available.amount").isNotNull())
    return filled.filter(F.assert_true(known & whole, F.lit("an account is incomplete or of an unknown type")).isNull())


def write_json(df: DataFrame, path: str) -> None:
    """A folder of JSON lines; :func:`ledgerloom.sources.json_state.save` writes one file."""
    df.write.mode("overwrite").json(path)


_BROKEN = "_broken"


def read_json_or_none(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """A JSON file, or None if it is missing or any of it isn't JSON with these types; one pass looks at every field."""
    reader = spark.read.schema(StructType([*schema, StructField(_BROKEN, StringType())])).option("multiLine", True).option("columnNameOfCorruptRecord", _BROKEN)
    try:
        found = reader.json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    _, broken = found.agg(F.bit_xor(F.xxhash64(*schema.names)), F.count(_BROKEN)).first()
    return None if broken else read_strict(spark, path, schema)


def pretty(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as indented JSON text."""
    return df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias(name))
