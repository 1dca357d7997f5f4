"""Language ID by string kernels.

A text is the set of its blended-spectrum n-grams (one to three characters,
hashed into ``BUCKETS`` buckets).  The kernel of two texts is the cosine of
these presence vectors.  A bounded number of labelled texts are Nyström
landmarks; every labelled text takes part in the one-versus-rest kernel ridge
regression on them, by sums that Spark adds up.  A batch of texts is scored by
one matrix product with the landmarks' combined weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .scratch import by_bytes, forget, frugal, small_batches, stored

BUCKETS = 1 << 15
ORDERS = 3
#: Characters of a text that are hashed at a time.
WINDOW = 1 << 18
#: Rows of one matrix product.
ROWS = 64
UNKNOWN = "und"

#: Fixed odd multipliers of the n-gram hash.
_MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def presence(text: str, into: np.ndarray) -> None:
    """Set to 1 the buckets of the n-grams of the lower-cased text; runs of white space count as one space."""
    points = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    for start in range(0, len(points), WINDOW):
        part = points[start : start + WINDOW + ORDERS - 1]
        own = part[:WINDOW]
        value = own * np.uint32(_MIX[0])
        into[(value >> shift)] = 1
        for k in range(1, ORDERS):
            more = part[k : k + WINDOW]
            value = (value[: len(more)] ^ (value[: len(more)] >> np.uint32(15))) * np.uint32(_MIX[1]) + more * np.uint32(_MIX[2])
            into[((value ^ (value >> np.uint32(13))) * np.uint32(_MIX[0])) >> shift] = 1


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class LanguageModel:
    """Learned languages and, for each, a weight for every bucket (landmarks times coefficients)."""

    languages: tuple[str, ...]
    weights: np.ndarray  # BUCKETS x languages, float32

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Of each row of presence bits for each language: one product for the batch."""
        norms = np.sqrt(np.maximum(rows.sum(axis=1, dtype=np.float32), 1))[:, None]
        return (rows @ self.weights) / norms

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """A language and a score from 0 to 1 for each text; UNKNOWN and 0 without a letter."""
        names, sure = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if self.languages and has_letter(t)]
        rows = np.zeros((ROWS, BUCKETS), np.float32)
        for start in range(0, len(known), ROWS):
            own = known[start : start + ROWS]
            rows[:] = 0
            for row, i in enumerate(own):
                presence(texts[i], rows[row])
            found = self.scores(rows[: len(own)])
            best = found.argmax(axis=1)
            for row, i in enumerate(own):
                names[i], sure[i] = self.languages[best[row]], float(min(1.0, max(0.0, found[row, best[row]])))
        return names, sure


#: How many times its rows a language keeps before they are ranked.
SLACK = 8


def _rows_of_each(labelled: DataFrame) -> dict[str, int]:
    return {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language


def _by_key(found: dict, column: str):
    """What ``found`` has for the value in ``column``."""
    return F.create_map(*(F.lit(x) for pair in found.items() for x in pair))[F.col(column)]


def sample_rows(labelled: DataFrame, per_language: int, in_all: int, counts: dict[str, int] | None = None) -> DataFrame:
    """``rec_id, text, lang, h``: of each language the ``per_language`` rows with the least hashes ``h``, or all, if fewer; fewer where ``in_all`` would be passed.

    The hash is that of the row's id and text, so rows of one id, or none, are
    told apart; rows equal in both may fill a language's share only if it has
    no others.  A threshold that follows from counts over all labelled rows
    thins each language before its rows are ranked; where too few pass it, all
    of the language's rows are ranked.
    """
    spread = F.pmod(F.xxhash64(F.lit(7), "rec_id", "text"), F.lit(1_000_000)) / 1_000_000
    labelled = labelled.select("rec_id", "text", "lang", F.xxhash64("rec_id", "text").alias("h"), spread.alias("spread"))
    counts = _rows_of_each(labelled) if counts is None else counts
    if not counts:
        return labelled.drop("spread").limit(0)
    most = max(1, min(per_language, in_all // len(counts)))
    share = {lang: min(1.0, SLACK * most / n) for lang, n in counts.items()}
    passing = _rows_of_each(labelled.filter(F.col("spread") < _by_key(share, "lang")))
    share |= {lang: 2.0 for lang, n in counts.items() if passing.get(lang, 0) < min(n, most)}
    place = F.row_number().over(W.partitionBy("lang").orderBy("spread", "h", "rec_id"))
    ranked = labelled.filter(F.col("spread") < _by_key(share, "lang")).withColumn("place", place)
    return ranked.filter(F.col("place") <= most).select("rec_id", "text", "lang", "h")


def _unit_rows(packed: np.ndarray) -> np.ndarray:
    """Packed presence bits as rows of length 1."""
    rows = np.unpackbits(packed, axis=1).astype(np.float32)
    return rows / np.sqrt(np.maximum(rows.sum(axis=1), 1))[:, None]


def _regression_sums(labelled: DataFrame, packed: np.ndarray, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Over all rows of ``labelled``, each language weighing 1: products of kernel values at two landmarks, and the kernel values of each language.

    A task sums its own rows; then Spark adds up each landmark's sums, from
    the diagonal on.  Only the totals come to the driver.
    """
    places = {lang: i for i, lang in enumerate(sorted(counts))}
    sent = labelled.sparkSession.sparkContext.broadcast(packed)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(sent.value, axis=1)
        used = np.flatnonzero(bits.any(axis=0))
        marks, lengths = bits[:, used].T.astype(np.float32), np.sqrt(bits.sum(axis=1, dtype=np.float64))
        del bits
        found, per_lang = np.zeros((len(lengths), len(lengths))), np.zeros((len(lengths), len(places)))
        rows, filled = np.zeros((ROWS, BUCKETS), np.float32), []

        def add() -> None:
            nonlocal found, per_lang
            own = rows[: len(filled)]
            kernel = (own[:, used] @ marks) / (np.sqrt(own.sum(axis=1, dtype=np.float64))[:, None] * lengths)
            weighted = kernel * np.array([1 / counts[x] for x in filled])[:, None]
            found += kernel.T @ weighted
            per_lang += weighted.T @ np.eye(len(places))[[places[x] for x in filled]]
            own[:] = 0
            filled.clear()

        for text, lang in ((t.as_py(), x.as_py()) for batch in batches for t, x in zip(*batch.columns)):
            presence(text, rows[len(filled)])
            filled.append(lang)
            if len(filled) == ROWS:
                add()
        if filled:
            add()
        if per_lang.any():
            sums = [np.concatenate((found[i, i:], per_lang[i])).tobytes() for i in range(len(found))]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums, pa.binary())], names=["landmark", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for place, sums in ((p.as_py(), np.frombuffer(x.as_py())) for batch in batches for p, x in zip(*batch.columns)):
            totals[place] = totals[place] + sums if place in totals else sums
        yield pa.RecordBatch.from_arrays([pa.array(totals, pa.int32()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], names=["landmark", "sums"])

    schema = "landmark int, sums binary"
    parts = labelled.select("text", "lang").mapInArrow(frugal(summed), schema)
    ordered = parts.repartition("landmark").sortWithinPartitions("landmark", "sums")  # one order, so one result
    products, values = np.zeros((len(packed), len(packed))), np.zeros((len(packed), len(places)))
    for r in ordered.mapInArrow(frugal(added), schema).collect():
        own = np.frombuffer(bytes(r.sums))
        products[r.landmark, r.landmark :], values[r.landmark] = own[: -len(places)], own[-len(places) :]
    return np.triu(products) + np.triu(products, 1).T, values


def fit(
    labelled: DataFrame,
    per_language: int = 400,
    landmarks: int = 384,
    ridge: float = 1e-3,
) -> LanguageModel:
    """Learn from all of ``rec_id, text, lang`` (rows with a null in text or lang are ignored).

    Every row takes part in the regression.  Only its landmarks are bounded:
    ``per_language`` a language and ``landmarks`` in all, but one a language
    at least.  What comes to the driver is a packed presence vector for each
    landmark (BUCKETS / 8 bytes), never a text, and its sums over all rows.
    """
    small_batches(labelled.sparkSession)
    labelled = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for text in (x.as_py() for x in batch.column(2)):
                bits = np.zeros(BUCKETS, np.uint8)
                presence(text, bits)
                packed.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["h", "lang", "bits"])

    counts = _rows_of_each(labelled)
    languages = sorted(counts)
    if not languages:
        return LanguageModel((), np.zeros((BUCKETS, 0), np.float32))
    rows = sample_rows(labelled, per_language, landmarks, counts).select("h", "lang", "text")
    found = sorted((r.lang, r.h, bytes(r.bits)) for r in rows.mapInArrow(frugal(vectors), "h long, lang string, bits binary").collect())
    packed = np.frombuffer(b"".join(r[2] for r in found), np.uint8).reshape(len(found), -1)
    marks = _unit_rows(packed)
    products, values = _regression_sums(labelled, packed, counts)
    k_mm = (marks @ marks.T).astype(np.float64)
    left = products + ridge * len(languages) * (k_mm + 1e-6 * np.eye(len(k_mm)))
    alpha = np.linalg.solve(left, values)
    return LanguageModel(tuple(languages), (marks.T @ alpha).astype(np.float32))


def identify(df: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep``, ``lang_pred`` and ``score`` for each row, from its whole text alone.

    A null text, or one without a letter, is ``und`` with score 0, as is every
    text when nothing was learned.  Repeated rows each get their row; an empty
    table gives an empty result; other columns aren't read, and ``lang_pred``
    and ``score`` replace columns of these names.
    """
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats
    names = [c for c in keep if c not in ("lang_pred", "score")]
    inner = [f"c{i}" for i in range(len(names))]

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in by_bytes(batch, len(inner))):
            found, sure = sent.value.predict(part.column(len(inner)).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[: len(inner)], pa.array(found, pa.string()), pa.array(sure, pa.float64())], names=[*inner, "lang_pred", "score"])

    fields = [T.StructField(i, df.schema[c].dataType) for i, c in zip(inner, names)]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    rows = df.select(*(F.col(c).alias(i) for i, c in zip(inner, names)), F.col(text_col).alias("text"))
    return rows.mapInArrow(frugal(predicted), schema).select(*(F.col(i).alias(c) for i, c in zip(inner, names)), "lang_pred", "score")


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of its id as text leaves 2 on division by 4. A null id isn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def learn_from(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> LanguageModel:
    """:func:`fit` on the rows of ``df`` that aren't held out."""
    rows = df.filter(~held_out(id_col)).select(F.col(id_col).alias("rec_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return fit(rows, **bounds)


#: Cells in which a round of :func:`order_statistics` counts.
CELLS = 256


def order_statistics(scores: DataFrame, share: float) -> dict[str, float]:
    """Of each ``part``, the score that ``int(share * n)`` of its ``n`` rows come before (``part, score``), exactly.

    A round cuts the stretch that holds it into CELLS cells and counts their
    rows, until all scores of a cell are equal.  Only counts come to the driver.
    """
    ends = F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("n")
    found = {r.part: (r.low, r.high, int(share * r.n)) for r in scores.groupBy("part").agg(*ends).collect()}
    while wide := {part: x for part, x in found.items() if x[0] < x[1]}:
        low, high = (_by_key({part: x[i] for part, x in wide.items()}, "part") for i in (0, 1))
        inside = scores.filter(F.col("score").between(low, high))
        cell = F.floor((F.col("score") - low) / (high - low) * CELLS).alias("cell")
        for r in sorted(inside.groupBy("part", cell).agg(*ends).collect(), key=lambda r: (r.part, r.cell)):
            before = wide.get(r.part)
            if before is None:
                continue
            if before[2] < r.n:
                found[r.part] = r.low, r.high, wide.pop(r.part)[2]
            else:
                wide[r.part] = *before[:2], before[2] - r.n
    return {part: x[0] for part, x in found.items()}


#: The lowest hundredth of held-out scores, less a fifth as room for texts unlike all of them, and no more than CEILING: a small table shows no hard texts.
QUANTILE, ROOM, CEILING = 0.01, 0.8, 0.3


def least_score(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> float:
    """The score under which a text is of no learned language, from the correct predictions of all held-out labelled rows.

    Their lowest hundredth decides, taken over all and over each language with
    at least one row in its own: the least of these, so that no language is cut off
    for being rare.  Only counts and scores of single places come to the
    driver.  Without a correct prediction it is CEILING.
    """
    rows = df.filter(held_out(id_col) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    right = stored(identify(rows, model, keep=("lang",)).filter("lang = lang_pred").select("lang", "score"), "langid-scores")
    own = [lang for lang, n in _rows_of_each(right).items() if QUANTILE * n >= 1]
    parts = right.select(F.lit("").alias("part"), "score").union(right.filter(F.col("lang").isin(own)).select(F.concat(F.lit("="), "lang"), "score"))
    found = order_statistics(parts, QUANTILE)
    forget(right)
    return min(CEILING, ROOM * min(found.values())) if found else CEILING
