"""A cleaning pipeline over ``documents``: each stage reads what the one before kept.

Every stage but the last returns the columns of ``documents``.  No part of it
is expressed in SQL: the classifier and the encoder aren't.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontam, langid, linededup, neardup, sentencepiece_fst
from ledgerloom.llm.queries import piece_model_path, table
from ledgerloom.llm.scratch import forget, passing, small, stored, without

#: Texts of fewer characters have few n-grams and low scores whatever their language; they stay from this score if their label is the prediction. Texts without a letter have 0.
SHORT_CHARS, LEAST_SCORE = 20, 0.1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts of no known language; a missing ``lang`` becomes the predicted one.

    The least score follows from held-out labelled rows.
    """
    model = langid.learn_from(docs)
    found = langid.identify(docs, model, keep=tuple(docs.columns))
    short = (F.length("text") < SHORT_CHARS) & (F.col("lang") == F.col("lang_pred")) & (F.col("score") >= LEAST_SCORE)
    sure = found.filter((F.col("lang_pred") != langid.UNKNOWN) & ((F.col("score") >= langid.least_score(docs, model)) | F.coalesce(short, F.lit(False))))
    return sure.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines seen before; a document that loses lines and has no word left goes."""
    found = linededup.dedup_lines(docs)
    left = (F.col("n_dropped") == 0) | F.col("kept_text").rlike(r"\S")
    return found.filter(left).withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate component: five-word shingles, similarity 0.8.

    It is the one of the smallest id (a null last), then text hash.  Of rows
    equal in both, the first by all columns stays.
    """
    found = neardup.near_duplicates(docs, choose=True)
    left = without(docs, found.filter(~F.col("chosen"))).select(docs.columns)
    pairs = found.filter("chosen AND n_shingles > 0").groupBy("doc_id", "text_key").count()
    doubled = stored(pairs.filter("count > 1").select("doc_id", "text_key"), "near-doubled")
    if not doubled.limit(1).count():
        return left
    key = ["_id", "_key"]
    again = small(doubled.toDF(*key))
    copies = left.join(again, left["doc_id"].eqNullSafe(again["_id"]) & (F.xxhash64(left["text"]) == again["_key"]))
    first = copies.groupBy(*key).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return without(left, doubled).union(first.select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more stands in benchmark items."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.filter("contaminated")).select(docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode each text, and decode it again as a check."""
    found = sentencepiece_fst.encode(docs, piece_model_path(), keep=("doc_id", "lang", "source"), check="round_trip")
    return found.withColumn("n_tokens", F.coalesce(F.size("token_ids"), F.lit(0)).cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("sentencepiece", sentencepiece),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result a table before the next begins."""
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with passing(spark) as keep:  # a stage's own tables go when its result is stored
            docs = keep(stored(stage(spark, before, sf_dir), f"stage-{name}"))
        if name != STAGES[0][0]:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
