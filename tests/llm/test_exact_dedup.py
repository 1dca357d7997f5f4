import hashlib
import random
from collections import Counter

from ledgerloom.llm import exact_dedup, scratch
from tests.llm.texts import corpus, frame, recorded_plans

LOWER = str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER)


def brute(rows):
    folded = [(i, (t or "").translate(LOWER)) for i, t in rows]
    size = Counter(t for _, t in folded)
    best = {}
    for i, t in folded:
        if t not in best or (best[t] is None and i is not None) or (i is not None and i > best[t]):
            best[t] = i
    return sorted((str(i), str(best[t]), size[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in folded)


def answer(df):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in df.collect())


def test_equals_brute_force_at_any_block_size(spark, monkeypatch):
    rows = corpus(4)
    rows += [(2000 + i, t.swapcase() if t and i % 2 else t) for i, (_, t) in enumerate(rows)]
    rows += [(3000, "École " * 400), (3001, "école " * 400), (3002, "eCole " * 400), (3003, "ECOLE " * 400)]
    for block in (100, 1 << 20):
        found = exact_dedup.exact_duplicates(frame(spark, rows), block_bytes=block)
        assert answer(found) == brute(rows)
        assert all(r.kept == (r.doc_id == r.keep_id) for r in found.collect())


def test_frequent_blocks_are_named_from_their_distinct_values(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "OFTEN", 3)
    rng = random.Random(1)
    parts = ["".join(rng.choice("ab") for _ in range(8)) for _ in range(3)]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 7)))) for i in range(120)]
    for limit in (scratch.BROADCAST_BYTES, -1):
        monkeypatch.setattr(scratch, "BROADCAST_BYTES", limit)
        assert answer(exact_dedup.exact_duplicates(frame(spark, rows), block_bytes=8)) == brute(rows)


def test_equal_hashes_do_not_make_texts_equal(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: exact_dedup.F.lit(7).cast("long"))
    for often in (2, 100):
        monkeypatch.setattr(exact_dedup, "OFTEN", often)
        rows = [(i, f"text {i % 5} " * 3) for i in range(20)]
        assert answer(exact_dedup.exact_duplicates(frame(spark, rows), block_bytes=8)) == brute(rows)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "a"), (None, "A"), (5, None), (6, ""), (7, "x"), (7, "x"), (7, "X"), (8, " ")]
    found = exact_dedup.exact_duplicates(frame(spark, rows))
    assert answer(found) == brute(rows)
    kept = Counter(r.text_sha256 for r in found.collect() if r.kept)
    assert set(kept.values()) == {1} and len(kept) == 4  # one row of each group, whatever ids repeat or lack
    assert exact_dedup.exact_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_one_long_text_and_its_copy(spark):
    text = "".join(random.Random(2).choice("abcdé ") for _ in range(600_000))
    rows = [(1, text), (2, text), (3, text[:-1] + "z"), (4, text[:-1])]
    assert answer(exact_dedup.exact_duplicates(frame(spark, rows))) == brute(rows)


def test_no_python_on_the_way(spark, monkeypatch):
    plans = recorded_plans(monkeypatch, exact_dedup, lambda: exact_dedup.exact_duplicates(frame(spark, corpus(2))))
    assert plans and not any(x in p for p in plans for x in ("Python", "Arrow", "Pandas", "CartesianProduct"))
