"""Hard negatives by a full sort of each anchor's scores.

Rows are dealt into blocks and anchors into bands, both of bounded size, and each
block meets each band once, in a task of its own.  There all scores are computed as
whole numbers and sorted by score and id.  A first round keeps the best rows of the
anchor's label; a second one finds each positive's upper limit by binary search and
reads rows of other labels from there down to the lower one.  What blocks give for an
anchor is merged by Spark, so no task or driver holds all scores of an anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import passing, stored

#: Rows of a block, anchors of a band, and anchors whose scores are computed at once.
BLOCK, BAND, STEP = 8192, 8192, 64
#: Bytes of a block's or a band's numbers at most; wide vectors make smaller ones.
TILE_BYTES = 64 << 20
#: A component counts as floor(SCALE * x).
SCALE = 256

#: An anchor's columns have names of their own: the two sides of a cogroup that read one table must not share any.
ANCHOR = {"id": "anchor_id", "label": "anchor_label", "vector": "anchor_vector", "row": "anchor"}
_BEST = "anchor long, anchor_id long, label long, positive_id long, score long"
_FOUND = "anchor long, anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long"


def _matrix(vectors: pa.ChunkedArray, scale: int) -> np.ndarray:
    """Scaled whole numbers, a row a vector; what a shorter vector lacks is 0."""
    lists = vectors.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exact: doubles are, below 2^53; beyond that long integers; more is an error."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = width * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if most >= 2.0**63:
        raise OverflowError("scores of these vectors don't fit 64 bits")
    return a.astype(np.int64) @ b.T.astype(np.int64)


def _sorted_by_id(rows: pa.Table) -> pa.Table:
    """Ascending ids, a missing one last."""
    return rows.take(pc.sort_indices(rows["id"], null_placement="at_end"))


def _best_of_label(scale: int, positives: int):
    """For each anchor of a band the best rows of its label in a block, itself left out."""

    def run(key, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows = _sorted_by_id(rows)
        a, r = _matrix(anchors["anchor_vector"], scale), _matrix(rows["vector"], scale)
        own, labels, numbers = anchors["anchor_label"].to_numpy(), rows["label"].to_numpy(), rows["row"].to_numpy()
        names = anchors["anchor"].to_numpy()
        who, which, scores = [], [], []
        for label in np.unique(own):
            same = np.flatnonzero(labels == label)
            mine = np.flatnonzero(own == label)
            for begin in range(0, len(mine) if len(same) else 0, STEP):
                part = mine[begin : begin + STEP]
                product = _products(a[part], r[same])
                order = np.argsort(-product, axis=1, kind="stable")[:, : positives + 1]  # ids ascend already
                other = numbers[same[order]] != names[part][:, None]
                first = other & (np.cumsum(other, axis=1) <= positives)
                line, at = np.nonzero(first)
                who.append(part[line])
                which.append(same[order[line, at]])
                scores.append(product[line, order[line, at]])
        who, which, scores = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (who, which, scores))
        return pa.table([anchors["anchor"].take(who), anchors["anchor_id"].take(who), anchors["anchor_label"].take(who), rows["id"].take(which), pa.array(scores)], ["anchor", "anchor_id", "label", "positive_id", "score"])

    return run


def _below_limits(scale: int, negatives: int, low: int, high: int):
    """For each anchor and positive the first rows of another label between both limits, in a block."""

    def run(key, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows = _sorted_by_id(rows)
        a, r = _matrix(anchors["anchor_vector"], scale), _matrix(rows["vector"], scale)
        labels, own = rows["label"].to_numpy(), anchors["anchor_label"].to_numpy()
        ids = np.arange(len(rows))  # their order
        limits = anchors["positive_scores"].to_pylist()
        who, places, which, scores = [], [], [], []
        for begin in range(0, len(anchors), STEP):
            product = _products(a[begin : begin + STEP], r)
            for line, score in enumerate(product):
                i = begin + line
                order = np.lexsort((ids, -score))
                order = order[labels[order] != own[i]]
                falling = -score[order]
                for place, positive in enumerate(limits[i]):
                    least, most = -((-low * positive) // 100), high * positive // 100
                    start, end = np.searchsorted(falling, -most, "left"), np.searchsorted(falling, -least, "right")
                    taken = order[start : min(end, start + negatives)]
                    who.append(np.full(len(taken), i))
                    places.append(np.full(len(taken), place))
                    which.append(taken)
                    scores.append(score[taken])
        who, places, which, scores = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (who, places, which, scores))
        flat = lambda c: pc.list_flatten(anchors[c]).combine_chunks()
        starts = np.concatenate([[0], np.cumsum([len(x) for x in limits])]).astype(np.int64)
        at = pa.array(starts[who] + places)
        columns = [anchors["anchor"].take(who), anchors["anchor_id"].take(who), pa.array(places.astype(np.int32)), flat("positive_ids").take(at), flat("positive_scores").take(at), rows["id"].take(which), pa.array(scores)]
        return pa.table(columns, [c.split()[0] for c in _FOUND.split(",")])

    return run


def _meet(anchors: DataFrame, rows: DataFrame, run, schema: str) -> DataFrame:
    """``run`` for each band of ``anchors`` with each block of ``rows``."""
    bands, blocks = (int(df.agg(F.max(c)).first()[0] or 0) for df, c in ((anchors, "band"), (rows, "block")))
    spread = lambda most: F.explode(F.sequence(F.lit(0), F.lit(most)))
    left = anchors.withColumn("block", spread(blocks)).groupBy("band", "block")
    right = rows.withColumn("band", spread(bands)).groupBy("band", "block")
    return left.cogroup(right).applyInArrow(run, schema)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A score is the inner product of components floor(scale * x); higher ones come first, equal ones by
    smaller id, a missing id last.  An anchor's positives are its first ``positives`` other rows
    of the same label; for each, the first ``negatives`` rows of another label are returned whose
    score is from ``low`` to ``high`` hundredths of the positive's.  Rows without a label or a
    vector, or with a component that is missing or not finite, take no part.  Repeated rows are
    rows of their own, and each is an anchor if ``is_anchor`` (of the columns of ``vectors``) holds;
    a null there is false.  What a shorter vector lacks counts as 0.  Scores beyond 64 bits are
    an error.  Other columns aren't read; an empty table or one without anchors gives an empty result.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    asked = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asked"))
    asked = asked.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", finite)).withColumn("row", F.monotonically_increasing_id())
    with passing(vectors.sparkSession) as keep:
        rows = stored(asked, "vectors")
        n, n_anchors, width = rows.agg(F.count("*"), F.count_if("asked"), F.max(F.size("vector"))).first()
        most = max(1, TILE_BYTES // (8 * max(1, width or 0)))
        rows = rows.withColumn("block", F.pmod("row", F.lit(n // min(BLOCK, most) + 1)).cast("int"))
        anchors = rows.filter("asked").select(*(F.col(c).alias(a) for c, a in ANCHOR.items()), F.pmod("row", F.lit(n_anchors // min(BAND, most) + 1)).cast("int").alias("band"))
        rows = rows.select("id", "label", "vector", "row", "block")

        best = _meet(anchors, rows, _best_of_label(scale, positives), _BEST)
        first = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("positive_id")))
        best = best.withColumn("place", first).filter(F.col("place") <= positives)
        lists = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", F.col("score").alias("s"), F.col("positive_id").alias("p")))).alias("x"))
        lists = stored(lists.select("anchor", F.col("x.s").alias("positive_scores"), F.col("x.p").alias("positive_ids")), "positives")
        ready = anchors.join(lists, "anchor")

        found = _meet(ready, rows, _below_limits(scale, negatives, low, high), _FOUND)
        place = F.row_number().over(W.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id")))
        ranked = found.withColumn("rank", place).filter(F.col("rank") <= negatives)
        return keep(stored(ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives"))
