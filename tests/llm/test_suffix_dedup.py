import random
from collections import Counter

import pytest

from ledgerloom.llm import scratch, suffix_dedup
from tests.llm.texts import corpus, frame, sentence


def brute(rows, length):
    seen = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        seen.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        spans = []
        for p, g in enumerate(gone):
            if g and (not p or not gone[p - 1]):
                spans.append([p, p])
            if g:
                spans[-1][1] = p + 1
        out.append((i, len(b), tuple(map(tuple, spans)), bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def answer(df):
    return sorted(((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in df.collect()), key=str)


@pytest.mark.parametrize(("seed", "length", "part"), [(1, 400, 1000), (2, 60, 3), (3, 101, 2)])
def test_equals_brute_force(spark, seed, length, part):
    """Also with parts so small that ranks are split and matched across parts."""
    rows = corpus(seed, 50)
    expected = brute(rows, length)
    assert sum(len(x[2]) for x in expected) > 5
    assert answer(suffix_dedup.remove_repeats(frame(spark, rows), length, part=part)) == expected


def test_overlapping_copies_in_one_text_and_edges(spark):
    rng = random.Random(4)
    own = sentence(rng, 30)
    rows = [(1, "ab" * 35), (2, "x" * 60), (3, "x" * 59 + "y"), (4, own + "é" + own), (5, own[10:90]), (6, None), (7, "")]
    assert answer(suffix_dedup.remove_repeats(frame(spark, rows), 60)) == brute(rows, 60)


def test_repeated_rows_are_copies(spark):
    text = "z" + sentence(random.Random(5), 40)
    rows = [(1, text), (1, text), (None, text[5:]), (2, "short")]
    assert answer(suffix_dedup.remove_repeats(frame(spark, rows), 60)) == brute(rows, 60)


def test_empty_table_and_shuffle_joins(spark, monkeypatch):
    assert suffix_dedup.remove_repeats(frame(spark, [(1, "x")]).limit(0)).collect() == []
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", -1)
    rows = corpus(6, 30)
    assert answer(suffix_dedup.remove_repeats(frame(spark, rows), 100)) == brute(rows, 100)


def test_samples_cover_every_string_across_blocks(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 64)
    data = bytes(random.Random(7).choices(b"abc", k=500))
    at, _, first, last, _ = suffix_dedup.samples(data, 20)
    covered = [p for a, b in zip(first, last) for p in range(a, b + 1)]
    assert covered == list(range(len(data) - 19))
    assert all(b <= x <= a + 15 for x, a, b in zip(at, first, last))  # the quarter lies in each of its strings


def test_long_runs_of_one_byte_and_of_a_period(spark):
    """Few anchors speak for a periodic stretch, and its strings are found all the same, whatever stands before."""
    text = b"x" * 100_000
    at, _, first, last, _ = suffix_dedup.samples(text, 400)
    assert len(at) < 2 * len(text) / 301 and first[0] == 0 and last[-1] == len(text) - 400
    rng = random.Random(8)
    rows = [(1, "q" + "ab" * 300 + sentence(rng, 5)), (2, "ab" * 100 + "c" + "x" * 2000), (3, sentence(rng, 30) + "x" * 150), (4, "ba" * 40 + "x" * 70), (5, "a" * 99)]
    assert answer(suffix_dedup.remove_repeats(frame(spark, rows), 100)) == brute(rows, 100)


def test_offsets_of_the_rounds():
    assert suffix_dedup.rounds(400) == [25, 50, 100] and suffix_dedup.offsets(400) == [0, 25, 50, 75]
    for length in range(4, 500):
        short, _, quarter = suffix_dedup.rounds(length)
        assert max(suffix_dedup.offsets(length)) + short == quarter
