"""Quality rules with adaptive thresholds.

Each text gets counts; ratios of these, in thousandths, go into a mergeable
quantile sketch per language and source: a histogram of integer buckets, whose
counts add up whatever the order of merging.  A group's thresholds come from
its own quantiles, in place of fixed cutoffs, and a join brings them back to
the documents.

A fence is a quantile of the group's ratio, plus a multiple of its spread to a
lower one (at least the middle one of all groups' spreads, so that a small
group isn't cut at its own edge), plus what a few occurrences make in a short text of the
group: a ratio that is 0 for all sound texts has no spread, but one symbol
weighs as much as the group's short texts are short.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .scratch import by_bytes, passing, small, small_batches, stored

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: A ratio's numerator, denominator, scale and top bucket. A bucket is scale * numerator / denominator, rounded down; what lies above the top bucket counts in it.
RATIOS: dict[str, tuple[str, str, int, int]] = {
    "symbol_ratio": ("n_symbols", "word_chars", 1000, 1000),
    "dup_line_ratio": ("n_dup_lines", "n_lines", 1000, 1000),
    "repeat_ratio": ("n_repeat_words", "n_words", 1000, 1000),
    "word_length": ("word_chars", "n_words", 100, 10_000),
}
#: Denominators, whose sketches have STEPS buckets for each doubling.
LENGTHS, STEPS = ("word_chars", "n_lines", "n_words"), 8
#: The share of a group's texts that counts as short.
SHORT = 0.1
#: A ratio's fence, over its group's texts that pass the base: the quantile it starts at, the one its spread is measured to, the spread's factor, and the occurrences that a short text may have besides. Ratios that are 0 for most texts start in the upper tail. A share of unsound texts above the higher quantile can't move a fence: half for word lengths, a fifth for symbols, a twentieth for repeats, most of which fail the base.
FENCES: dict[str, tuple[float, float, int, int]] = {
    "symbol_ratio": (0.8, 0.5, 3, 5),
    "dup_line_ratio": (0.95, 0.9, 2, 1),
    "repeat_ratio": (0.95, 0.9, 2, 10),
    "word_length": (0.5, 0.1, 6, 0),
}
MIN_WORDS = 50


def text_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """COUNTS of one whole text. bytes.split() without an argument splits at SPACES and nothing else."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        upto = 0  # words before this one are counted
        for i, window in enumerate(windows):
            if seen[window] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    return n, chars, symbols, len(lines), len(lines) - len(set(lines)), repeated


def count_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``rec_id``, ``g0``, ``g1`` ... of the groups and COUNTS for each row; a null text counts as empty."""
    keys = ["rec_id", *(f"g{i}" for i in range(len(group_cols)))]
    columns = [id_col, *group_cols]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (few for whole in batches for few in by_bytes(whole, len(keys), 8 << 20)):
            counts = [text_counts(t) for t in batch.column(len(keys)).to_pylist()]
            arrays = [pa.array(x, pa.int64()) for x in (zip(*counts) if counts else [[]] * len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *arrays], names=[*keys, *COUNTS])

    schema = T.StructType([T.StructField(k, df.schema[c].dataType) for k, c in zip(keys, columns)] + [T.StructField(c, T.LongType()) for c in COUNTS])
    return df.select(*(F.col(c).alias(k) for k, c in zip(keys, columns)), F.col(text_col).alias("text")).mapInArrow(counted, schema)


def _bucket(name: str) -> Column:
    over, under, scale, top = RATIOS[name]
    return F.least(F.lit(top), F.when(F.col(under) > 0, F.expr(f"{scale} * {over} div {under}")).otherwise(0)).cast("int")


def sketch(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Mergeable quantile sketches of RATIOS and LENGTHS: ``keys, ratio, bucket, n``. Two tables of sketches merge by adding ``n``.

    Texts without a word tell nothing of their group and are left out.
    """
    size = {c: F.floor(F.log2(F.greatest(c, F.lit(1))) * STEPS).cast("int") for c in LENGTHS}
    buckets = {r: _bucket(r) for r in RATIOS} | size
    cells = F.explode(F.array(*(F.struct(F.lit(r).alias("ratio"), b.alias("bucket")) for r, b in buckets.items())))
    return counts.filter("n_words > 0").select(*keys, cells.alias("cell")).groupBy(*keys, "cell.ratio", "cell.bucket").agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], at: dict[str, float]) -> DataFrame:
    """``keys, ratio`` and one column for each name in ``at``: the bucket that holds the ceil(q * rows)-th value.

    A window holds one group's buckets for one ratio, no more than the ratio's
    top bucket whatever the input.
    """
    one = W.partitionBy(*keys, "ratio")
    ranked = sketches.withColumn("upto", F.sum("n").over(one.orderBy("bucket"))).withColumn("total", F.sum("n").over(one))
    return ranked.groupBy(*keys, "ratio").agg(*(F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("total")), F.col("bucket"))).alias(c) for c, q in at.items()))


def thresholds(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and, for each ratio, ``max_<ratio>``: the largest bucket that a kept document may have."""
    levels = sorted({q for x in FENCES.values() for q in x[:2]} | {SHORT})
    at = {f"q{q}".replace(".", "_"): q for q in levels}
    name = {q: c for c, q in at.items()}
    spread = F.coalesce(*(F.when(F.col("ratio") == r, F.col(name[start]) - F.col(name[low])) for r, (start, low, _, _) in FENCES.items()))
    found = quantiles(sketches, keys, at).withColumn("spread", spread)
    usual = found.groupBy("ratio").agg(F.percentile("spread", F.lit(0.5)).alias("usual"))  # a row for each of RATIOS and LENGTHS
    found = found.join(F.broadcast(usual), "ratio")
    own = lambda ratio, value: F.max(F.when(F.col("ratio") == ratio, value))

    def fence(ratio: str) -> Column:
        start, _, factor, few = FENCES[ratio]
        _, under, scale, _ = RATIOS[ratio]
        short = own(under, F.pow(F.lit(2.0), F.col(name[SHORT]) / STEPS))
        return own(ratio, F.col(name[start]) + F.floor(factor * F.greatest("spread", "usual"))) + F.floor(scale * few / short)

    return found.groupBy(*keys).agg(*(fence(r).cast("int").alias(f"max_{r}") for r in RATIOS))


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Counts, ratios, the group's thresholds and a verdict for each row.

    Returns ``id_col``, COUNTS, the ratios' buckets, ``max_<ratio>``,
    ``base_failed`` (under 50 words, or over half of them in repeated windows)
    and ``kept`` (base passed and every ratio within its group's threshold).
    Null and empty texts have zero counts and fail the base.  Thresholds come
    from the texts that pass it and are null in a group without one.  Rows whose
    language or source is null form a group of their own.  Repeated rows count
    as often as they occur, each with a row of the result.  An empty table
    gives an empty result.
    """
    small_batches(df.sparkSession)
    keys = [f"g{i}" for i in range(len(group_cols))]
    with passing(df.sparkSession) as keep:
        counts = keep(stored(count_texts(df, id_col, text_col, group_cols), "quality-counts"))
        cells = stored(sketch(counts.filter(~_base_failed()), keys), "quality-sketch")
        limits = keep(stored(thresholds(cells, keys), "quality-thresholds"))
    on = [counts[k].eqNullSafe(limits[k]) for k in keys]
    joined = counts.join(small(limits), on, "left")
    within = F.lit(True)
    for r in RATIOS:
        within = within & (F.col(r) <= F.col(f"max_{r}"))
    return (
        joined.drop(*(limits[k] for k in keys))
        .withColumns({r: _bucket(r) for r in RATIOS})
        .withColumn("base_failed", _base_failed())
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False)))
        .select(F.col("rec_id").alias(id_col), *COUNTS, *RATIOS, *(f"max_{r}" for r in RATIOS), "base_failed", "kept")
    )
