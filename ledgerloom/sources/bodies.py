"""JSON bodies stored as shredded variants, so that a pick reads its own fields and no others.

Variants keep neither the order of keys nor repeated ones, so what depends on
these goes through :mod:`ledgerloom.operators.records`; here are picks from
bodies that are one record each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITE = {"spark.sql.variant.writeShredding.enabled": "true", "spark.sql.variant.inferShreddingSchema": "true"}
_READ = {"spark.sql.variant.allowReadingShredded": "true", "spark.sql.variant.pushVariantIntoScan": "true"}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """These settings for a block that runs an action, and what there was before after it."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def store_bodies(df: DataFrame, path: str, body_col: str = "body") -> None:
    """Write ``df`` as Parquet with ``body_col`` as a shredded variant; what isn't JSON becomes null."""
    with _settings(df.sparkSession, _WRITE):
        df.withColumn(body_col, F.try_parse_json(body_col)).write.mode("overwrite").parquet(path)


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`store_bodies` wrote. Reading it with picks pushed to the scan is set for the session, since results are lazy."""
    for k, v in _READ.items():
        spark.conf.set(k, v)
    return spark.read.parquet(path)


def spellings(df: DataFrame, keys: Sequence[str], body_col: str = "body") -> dict[str, list[str]]:
    """For each of ``keys`` the fields of the bodies, objects all, that it names whatever their case; one pass."""
    found = df.agg(F.schema_of_variant_agg(body_col)).first()[0] or ""
    fields: list[str] = []
    depth, begin = 0, None
    for at, mark in enumerate(found):  # OBJECT<a: BIGINT, `b c`: ARRAY<...>>
        depth += (mark == "<") - (mark == ">")
        if depth == 1 and mark in "<,":
            begin = at + 1
        elif depth == 1 and mark == ":" and begin is not None:
            fields.append(found[begin:at].strip().strip("`"))
            begin = None
    return {k: [f for f in fields if f.lower() == k.lower()] for k in keys}


def pick_field(fields: Sequence[str], body_col: str = "body") -> tuple[Column, Column]:
    """Whether the body has any of ``fields``, and the first one's value as text (null for a JSON null)."""

    def path(field: str) -> str:
        return f"$.{field}" if re.fullmatch(r"\w+", field) else "$['" + field.replace("'", "\\'") + "']"

    held = [(F.try_variant_get(body_col, path(f), "variant"), F.try_variant_get(body_col, path(f), "string")) for f in fields]
    has, value = F.lit(False), F.lit(None).cast("string")
    for own, text in reversed(held):
        has = has | own.isNotNull()
        value = F.when(own.isNotNull(), text).otherwise(value)
    return has, value
