import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import neardup
from ledgerloom.llm.components import components
from tests.llm.texts import corpus, frame


def shingle_set(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size, percent=80):
    sets = {i: shingle_set(t, size) for i, t in rows}
    low = {i: i for i in sets}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                low[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def answer(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize(("seed", "size", "leaf"), [(1, 4, 1000), (2, 5, 4)])
def test_equals_brute_force(spark, seed, size, leaf):
    """Also with leaves so small that nodes branch to the last depth and are cut in blocks."""
    rows = corpus(seed, 120)
    assert answer(neardup.near_duplicates(frame(spark, rows), size=size, leaf=leaf)) == brute(rows, size)


def near_copies(rng, n, words, changed):
    """Texts that differ from one in a few places each."""
    base = [f"w{rng.integers(10**6)}" for _ in range(words)]
    for i in range(n):
        own = list(base)
        for k in rng.integers(words, size=changed):
            own[k] = f"x{i}_{k}"
        yield " ".join(own)


def test_dense_nodes_and_what_stands_beside_them(spark):
    """A cluster far larger than a leaf is one component; sets at its edge are linked as brute force does."""
    rng = np.random.default_rng(7)
    texts = [*near_copies(rng, 150, 120, 2), *near_copies(rng, 60, 120, 6)]
    mixed = texts[0].split(" ")
    texts += [" ".join(mixed[k:] + [f"tail{j}" for j in range(k)]) for k in range(4, 40, 3)]
    rows = list(enumerate(texts))
    got = answer(neardup.near_duplicates(frame(spark, rows), leaf=16))
    assert got == brute(rows, 5)
    assert len({c for _, c, _ in got.values()}) > 10


def test_rows_of_a_dense_node_grow_with_its_sets(spark):
    """Near copies make two rows a set, nothing once they are one component, and little over one more beside a few others."""
    for n in (400, 1600):
        large = spark.range(n).select(F.lit(1).cast("long").alias("node"), F.col("id").cast("string").cast("binary").alias("cid"), F.lit(n).cast("long").alias("n"))
        assert neardup.dealt(large, 100).count() == 2 * n
        tagged = large.withColumn("label", F.lit(b"x"))
        assert neardup.against_largest(tagged, 100).count() == 0
        strays = large.withColumn("label", F.when(F.col("cid").cast("string").cast("int") < 20, F.col("cid")).otherwise(F.lit(b"x")))
        assert neardup.against_largest(strays, 100).count() < 3 * n


def test_heavy_nodes_are_cut_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(neardup, "NODE_BYTES", 4096)
    rows = corpus(31, 60)
    assert answer(neardup.near_duplicates(frame(spark, rows), size=4, leaf=12)) == brute(rows, 4)
    members = spark.createDataFrame([(1, bytes([i])) for i in range(40)] + [(2, b"\x01"), (2, b"\x02")], "node long, cid binary")
    cut = neardup.by_set_bytes(members, members.select("cid", F.lit(100).alias("n")).distinct()).collect()
    met = {}
    for r in cut:
        met.setdefault(r.node, set()).add(bytes(r.cid))
    assert met.pop(2) == {b"\x01", b"\x02"} and max(map(len, met.values())) < 30
    assert all(any({bytes([i]), bytes([j])} <= m for m in met.values()) for i in range(40) for j in range(i))


def test_recall_where_nodes_branch(spark):
    """Found links over true ones, with leaves of 8 sets and without what stays larger: at least 0.9."""
    rng = np.random.default_rng(9)
    texts = [t for _ in range(500) for t in near_copies(rng, 4, 100, 1)]
    common = [f"c{i}" for i in range(60)]  # shared by all, so that nodes are large and branch
    rows = [(i, t + " " + " ".join(common)) for i, t in enumerate(texts)]
    signed = neardup.sign(neardup._keyed(frame(spark, rows), "doc_id", "text"), 5)
    classes = neardup.stored(signed.groupBy("cid").agg(*(F.any_value(c).alias(c) for c in ("rec_id", "n", "sketch", "low", "signs"))), "recall")
    fine, _ = neardup.leaves(classes, neardup.trees_for(80), 8)
    met = {}
    for r in fine.join(classes.select("cid", "rec_id"), "cid").collect():
        met.setdefault(r.node, []).append(r.rec_id)
    found = {(a, b) for m in met.values() for a in m for b in m if a < b}
    sets = {i: shingle_set(t, 5) for i, t in rows}
    true = [(a, b) for a in sets for b in range(a + 1, 4 * (a // 4) + 4) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    recall = sum(p in found for p in true) / len(true)
    print("recall", recall, "of", len(true), "links, trees", neardup.trees_for(80))
    assert len(true) > 2000 and recall >= 0.9


def test_trees_and_slack_follow_the_threshold():
    assert (neardup.trees_for(80), neardup.least_agreeing(80)) == (5, 84)
    assert neardup.trees_for(50) > neardup.trees_for(80) > neardup.trees_for(95)


def test_nulls_repeats_and_ids(spark):
    text = "a b c d e f g"
    rows = [(None, text), (5, text), (5, text), (3, text.upper()), (None, None), (9, ""), (8, "ä Ä"), (7, "Ä ä"), (6, "only"), (4, "ONLY")]
    out = neardup.near_duplicates(frame(spark, rows))
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in out.collect())
    assert got == [(False, 0, 0, None, True), (False, 0, 3, 3, False), (True, 3, 3, 3, True), (True, 4, 1, 4, True), (True, 5, 3, 3, False), (True, 5, 3, 3, False), (True, 6, 1, 4, False), (True, 7, 1, 7, True), (True, 8, 1, 8, True), (True, 9, 0, 9, True)]


def test_empty_table(spark):
    assert neardup.near_duplicates(frame(spark, [(1, "x")]).limit(0)).collect() == []


def test_threshold_is_inclusive(spark):
    """9 shingles of which 8 are common to 10 in all: 80 %."""
    one = [f"w{i}" for i in range(12)]
    two = [*one[:-1], "other"]
    sets = [shingle_set(" ".join(x), 4) for x in (one, two)]
    assert 100 * len(sets[0] & sets[1]) == 80 * len(sets[0] | sets[1])
    got = answer(neardup.near_duplicates(frame(spark, [(1, " ".join(one)), (2, " ".join(two))]), size=4))
    assert got[2][1] == 1


def test_components_of_a_long_chain(spark):
    links = [(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"\x80", b"\x81")]
    got = {bytes(r.node): bytes(r.label) for r in components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    assert set(got[bytes([i])] for i in range(41)) == {b"\x00"} and got[b"\x81"] == b"\x80"


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    both = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    a, b = np.unique(both[:800]), np.unique(np.concatenate((both[100:800], both[800:])))
    agree = np.mean(neardup.sketch(a) == neardup.sketch(b))
    assert abs(agree - 700 / 900) < 0.15
