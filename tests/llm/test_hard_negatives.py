import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, id long, row int, band string, block int, score long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3, 4) for r in rows], SCHEMA)


def brute(rows, every=10, positives=5, negatives=10):
    sound = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda e: (-e[0], e[1] is None, e[1] or 0)
    out = []
    for k, (i, v, y) in enumerate(sound):
        if i is None or i % every:
            continue
        scored = [(sum(p * q for p, q in zip(v, w)), j, z, m) for m, (j, w, z) in enumerate(sound)]
        same = sorted((e for e in scored if e[2] == y and e[3] != k), key=key)[:positives]
        others = sorted((e for e in scored if e[2] != y), key=key)
        for p in same:
            ok = [e for e in others if 30 * p[0] <= 100 * e[0] <= 90 * p[0]][:negatives]
            out += [(i, p[1], n + 1, e[1], p[0], e[0]) for n, e in enumerate(ok)]
    return sorted(map(str, out))


def answer(df):
    return sorted(str(tuple(r)) for r in df.collect())


def vectors(seed, n, size=6):
    rng = random.Random(seed)
    grid = [x / 8 for x in range(-6, 9)]  # few values, so that scores tie
    return [(i, [rng.choice(grid) for _ in range(size)], rng.randrange(3)) for i in range(n)]


@pytest.mark.parametrize(("block", "band"), [(hn.BLOCK, hn.BAND), (7, 3)])
def test_equals_brute_force(spark, monkeypatch, block, band):
    monkeypatch.setattr(hn, "BLOCK", block)
    monkeypatch.setattr(hn, "BAND", band)
    rows = vectors(1, 120)
    assert answer(hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0)) == brute(rows)


def test_nulls_repeats_lengths_and_what_is_not_finite(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 20)
    rows = vectors(2, 60)
    rows += [(None, *vectors(3, 1)[0][1:]), (None, [1.0] * 6, 1), (10, [0.5] * 6, 1), (10, [0.5] * 6, 1), rows[20], rows[20], (70, None, 1), (80, [0.5] * 6, None)]
    rows += [(90, [None, 0.5], 1), (100, [float("nan")], 1), (110, [float("-inf")], 2), (120, [], 1), (130, [1.0], 1), (140, [1.0] * 9, 1), (150, [1.0] * 9, 0), (160, [-1.0] * 6, 1)]
    assert answer(hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0)) == brute(rows)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**20 + i), 3.0, float(-i)], i % 2) for i in range(30)]
    assert answer(hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0)) == brute(rows)
    with pytest.raises(Exception, match="64 bits"):
        hn.hard_negatives(frame(spark, [(i, [1e30], 1) for i in range(3)]), F.col("vec_id") >= 0).collect()


def test_wide_vectors_make_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(hn, "TILE_BYTES", 8 * 6 * 10)  # ten vectors of six
    rows = vectors(5, 60)
    blocks = []
    meet = hn._meet
    monkeypatch.setattr(hn, "_meet", lambda a, r, run, schema: blocks.append(r.groupBy("block").count().agg(F.max("count")).first()[0]) or meet(a, r, run, schema))
    assert answer(hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0)) == brute(rows)
    assert max(blocks) <= 12


def test_tables_without_rows_or_anchors(spark):
    rows = vectors(4, 20)
    assert hn.hard_negatives(frame(spark, rows), F.lit(False)).count() == 0
    assert hn.hard_negatives(frame(spark, rows).limit(0), F.lit(True)).count() == 0
    assert answer(hn.hard_negatives(frame(spark, rows[:1]), F.lit(True))) == []
