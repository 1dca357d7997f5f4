"""Paged histories as tables: signatures, the walk with its stop rules, slices and synthetic ids.

A walk is named by key columns (an account, say), so that walks are spread over
the cluster; each has at most ``max_pages`` pages, and no window holds more.
"""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MAX_PAGES = 50
#: Positions that one window of running sums holds; sums of such blocks are the next level.
BLOCK = 1024
#: A page is sorted out of at most about so many rows, found by counting between FANOUT bounds at a time.
FEW, FANOUT, SAMPLED = 100_000, 64, 8


def signature_text(date: Column, amount_text: Column, description: Column) -> Column:
    """What tells a row's content apart from another's; ids don't count."""
    return F.concat_ws("|", date, amount_text, description)


def page_signatures(rows: DataFrame, keys: Sequence[str], page_col: str, pos_col: str, text: Column) -> DataFrame:
    """``keys, page, n, sig``: the rows' texts in order, joined by U+0001, for each page."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos_col).alias("pos"), text.alias("text"))))
    return rows.groupBy(*keys, F.col(page_col).alias("page")).agg(F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda r: r["text"]), chr(1)).alias("sig"))


def repeated_pages(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``pages`` with ``repeated``: an earlier page of the walk has the same signature."""
    return pages.withColumn("repeated", F.row_number().over(W.partitionBy(*keys, "sig").orderBy("page")) > 1)


def walk_pages(pages: DataFrame, keys: Sequence[str], start_page: int = 0, page_size: int | None = None, max_pages: int = MAX_PAGES) -> DataFrame:
    """The pages that a walk takes: ``keys, page, n, truncated``.

    It begins at ``start_page`` and stops before a page that is missing, empty
    or repeated, after one shorter than a known ``page_size``, and at
    ``max_pages``.  ``truncated`` says that all those pages were taken and the
    last isn't short; it is the same for all pages of a walk.
    """
    near = pages.filter((F.col("page") >= start_page) & (F.col("page") < start_page + max_pages))
    in_order = W.partitionBy(*keys).orderBy("page")
    short = F.lit(False) if page_size is None else F.col("n") < page_size
    stops = repeated_pages(near, keys).withColumn("gap", F.col("page") != start_page + F.row_number().over(in_order) - 1)
    upto = in_order.rowsBetween(W.unboundedPreceding, 0)
    before = in_order.rowsBetween(W.unboundedPreceding, -1)
    kept = stops.withColumn("stopped", F.max(F.col("gap") | F.col("repeated") | (F.col("n") == 0)).over(upto) | F.coalesce(F.max(short).over(before), F.lit(False))).filter("NOT stopped")
    whole = W.partitionBy(*keys)
    truncated = (F.count("*").over(whole) == max_pages) & ~F.max(short).over(whole)
    return kept.withColumn("truncated", truncated).select(*keys, "page", "n", "truncated")


def walk_rows(rows: DataFrame, pages: DataFrame, keys: Sequence[str], page_col: str) -> DataFrame:
    """Rows of the pages that a walk took."""
    return rows.join(pages.withColumnRenamed("page", page_col).select(*keys, page_col), [*keys, page_col], "left_semi")


def _lower(bound: Row, order: Sequence[str], rows: DataFrame) -> Column:
    values = F.struct(*(F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, bound)))
    plain = F.lit(True) if bound[0] is None else F.col(order[0]) >= F.lit(bound[0])  # reaches the scan
    return plain & (F.struct(*order) >= values)


def _upper(bound: Row, order: Sequence[str], rows: DataFrame) -> Column:
    values = F.struct(*(F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, bound)))
    plain = F.lit(True) if bound[0] is None else F.col(order[0]).isNull() | (F.col(order[0]) <= F.lit(bound[0]))
    return plain & (F.struct(*order) < values)


def rank_range(rows: DataFrame, order: Sequence[str], begin: int, end: int, few: int = FEW, fanout: int = FANOUT) -> tuple[DataFrame, int]:
    """Rows of a stretch of ``order`` that holds those of ranks ``begin`` to ``end``, and how many rows come before it.

    Each round counts the rows between at most ``fanout`` bounds taken from the rows themselves,
    which needs no shuffle of rows, and goes on with the one or few stretches that hold the ranks, until
    ``few`` rows are left.  The bounds are conditions on the columns of ``order``,
    so later rounds skip most of a table that is stored in about that order.
    """
    part, before, n = rows, 0, rows.count()
    while n > max(few, 4 * (end - begin)):
        hashed = part.select(*order).orderBy(F.xxhash64(*order)).limit(SAMPLED * fanout)
        bounds = [b for b, _ in itertools.groupby(hashed.orderBy(*order).collect())][:: SAMPLED // 2][1:fanout]
        if not bounds:
            break
        known = F.array(*(F.struct(*(F.lit(v).cast(part.schema[c].dataType).alias(c) for c, v in zip(order, b))) for b in bounds))
        place = F.size(F.filter(known, lambda b: b <= F.struct(*order)))
        counts = dict(part.groupBy(place.alias("place")).count().collect())  # fanout rows
        ends = list(itertools.accumulate(counts.get(i, 0) for i in range(len(bounds) + 1)))
        first = next((i for i, x in enumerate(ends) if x > begin - before), len(bounds))
        last = next((i for i, x in enumerate(ends) if x >= end - before), len(bounds))
        skipped = ends[first - 1] if first else 0
        left = ends[last] - skipped
        if left >= n:
            break
        if first:
            part = part.filter(_lower(bounds[first - 1], order, part))
        if last < len(bounds):
            part = part.filter(_upper(bounds[last], order, part))
        before, n = before + skipped, left
    return part, before


def page_slice(rows: DataFrame, order: Sequence[str], page: int, page_size: float | None, few: int = FEW) -> DataFrame:
    """Page ``page`` (from 0, negative as 0) in a total order, nulls first; everything without a positive ``page_size``.

    The page's place is found by counts (:func:`rank_range`), so a deep page sorts no
    more rows than a shallow one.  To read on from a page, :func:`next_slice` needs no counts.
    """
    if page_size is None or page_size != page_size or page_size in (float("inf"), float("-inf")) or page_size <= 0:
        return rows
    begin = max(0, page) * int(page_size)
    part, before = rank_range(rows, order, begin, begin + int(page_size), few)
    return part.orderBy(*order).offset(begin - before).limit(int(page_size))


def next_slice(rows: DataFrame, order: Sequence[str], after: Sequence[object], page_size: int) -> DataFrame:
    """The ``page_size`` rows that follow ``after`` (values of ``order``, none of them null) in a total order.

    The condition reaches the scan, and a task keeps one page's rows.
    """
    beyond, same = F.lit(False), F.lit(True)
    for c, value in zip(order, after):
        beyond = beyond | (same & (F.col(c) > F.lit(value)))
        same = same & (F.col(c) == F.lit(value))
    least = F.col(order[0]) >= F.lit(after[0])  # a plain bound for the scan
    return rows.filter(least & beyond).orderBy(*order).limit(page_size)


def running_before(counts: DataFrame, keys: Sequence[str], order: str, value: str, block: int = BLOCK) -> DataFrame:
    """``keys, order, before``: the sum of ``value`` over the key's rows with a smaller whole number ``order``.

    Sums of blocks of ``block`` numbers run first, then those within a block, so that a
    key with a large share of all rows is spread over as many windows as it has blocks.
    """
    placed = counts.select(*keys, order, value, F.floor(F.col(order) / block).alias("_block"))
    blocks = placed.groupBy(*keys, "_block").agg(F.sum(value).alias("_total"))
    earlier = lambda by, c: F.coalesce(F.sum(c).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("_ahead", earlier(W.partitionBy(*keys).orderBy("_block"), "_total")).drop("_total")
    inside = placed.withColumn("_inside", earlier(W.partitionBy(*keys, "_block").orderBy(order), value))
    return inside.join(blocks, [*keys, "_block"]).select(*keys, order, (F.col("_ahead") + F.col("_inside")).alias("before"))


def numbered(rows: DataFrame, keys: Sequence[str], order: str, width: int) -> DataFrame:
    """``rows`` with ``place``: from 0 in each key by the distinct whole numbers ``order``, ``width`` of which make a window."""
    placed = rows.withColumn("_stretch", F.floor(F.col(order) / width))
    counts = placed.groupBy(*keys, "_stretch").agg(F.count("*").alias("_n"))
    ahead = running_before(counts, keys, "_stretch", "_n")
    inside = F.row_number().over(W.partitionBy(*keys, "_stretch").orderBy(order)) - 1
    return placed.withColumn("_inside", inside).join(ahead, [*keys, "_stretch"]).withColumn("place", F.col("before") + F.col("_inside")).drop("_stretch", "_inside", "before")


class TruncationWarning(UserWarning):
    """Some histories are as long as a walk may be."""


@dataclass
class TruncationWatch:
    """What an action saw of walks: ``walks``, ``truncated_walks``, ``pages`` or ``rows``.

    The counts are observed metrics, so they reach the caller's process whichever executors the work ran on.
    """

    observation: Observation = field(default_factory=Observation)

    def pages(self, walked: DataFrame, start_page: int = 0) -> DataFrame:
        """``walked``, pages of :func:`walk_pages`, counted as they go by."""
        first = F.col("page") == start_page
        return walked.observe(self.observation, F.count_if(first).alias("walks"), F.count_if(first & F.col("truncated")).alias("truncated_walks"), F.count(F.lit(1)).alias("pages"))

    def rows(self, history: DataFrame) -> DataFrame:
        """``history``, in which ``truncated`` marks the last row of a walk that ended at its cap, counted as it goes by."""
        return history.observe(self.observation, F.count_if("truncated").alias("truncated_walks"), F.count(F.lit(1)).alias("rows"))

    def report(self) -> dict[str, int]:
        """The counts, once an action has run; a warning if any walk was cut."""
        seen = self.observation.get
        if seen["truncated_walks"]:
            warnings.warn(f"{seen['truncated_walks']} histories reached the page cap and may be incomplete", TruncationWarning, stacklevel=2)
        return seen


def synthetic_ids(rows: DataFrame, keys: Sequence[str], page_col: str, pos_col: str, kept: Column, own_id: Column) -> DataFrame:
    """Kept rows with ``tx_id``: their own id or ``tx-`` and a number.

    The number is the count of rows kept on earlier pages and the row's place
    (from 0, skipped rows included) plus one, so a page with a skipped row can
    share a number with the next.
    """
    marked = rows.withColumn("_kept", kept)
    counts = marked.groupBy(*keys, page_col).agg(F.count_if("_kept").alias("_n"))
    offsets = running_before(counts, keys, page_col, "_n").withColumnRenamed("before", "_offset")
    numbered = marked.filter("_kept").join(offsets, [*keys, page_col])
    return numbered.withColumn("tx_id", F.coalesce(own_id, F.concat(F.lit("tx-"), F.col("_offset") + F.col(pos_col) + 1))).drop("_kept", "_offset")
