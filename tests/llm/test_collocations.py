import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import collocations as co
from tests.llm.texts import corpus

SCHEMA = "doc_id long, text string, lang string, n long, hash long, phrase string, word string, ids int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, y, 1, 2, "x", "y", 3) for i, (t, y) in enumerate(rows)], SCHEMA)


def brute(rows, least, longest=5, top=2000, cover=100):
    out = []
    texts = defaultdict(list)
    for t, y in rows:
        folded = (t or "").translate(str.maketrans(co.UPPER, co.LOWER))
        texts["und" if y is None else y] += [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", folded)]
    for lang, pieces in texts.items():
        f = Counter(tuple(p[i : i + k]) for p in pieces for k in range(1, longest + 1) for i in range(len(p) - k + 1))
        n = sum(map(len, pieces))
        candidates = [p for p, a in f.items() if len(p) > 1 and a >= least]
        covered = {}
        for p in candidates:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    covered[p[i : i + k]] = max(covered.get(p[i : i + k], 0), f[p])
        found = []
        for p in candidates:
            a = f[p]
            if p in covered and 100 * covered[p] >= cover * a:
                continue
            score, _, left, right = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def answer(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def prose(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Été", "a\x00b", "x\xa0y", "C++"]
    ends = [" ", " ", " ", "\t", ", ", ". ", "\n", "\r", "; ", "  "]
    return [("".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 80))), rng.choice(["en", "de", None])) for _ in range(n)]


SMALL = {"slice_bytes": 50, "chunk_words": 30, "group_keys": 20}


@pytest.mark.parametrize(("asked", "limits"), [((4, 5, 2000, 100), {}), ((4, 5, 2000, 100), SMALL), ((6, 3, 7, 60), SMALL), ((3, 2, 5, 100), {})])
def test_equals_brute_force(spark, asked, limits):
    rows = prose(1, 60) + [(t, "en") for _, t in corpus(3)[:40]] + [(None, "fr"), ("", None), ("a a a a a a a", "fr"), (" \t\n", "es")]
    rows += [("the same phrase here " * 30, "en"), ("q " * 400 + "z", "it"), ("y" * 300, "it")]
    assert answer(co.collocations(frame(spark, rows), *asked, **limits)) == brute(rows, *asked)


def test_clashing_words_are_hashed_anew(spark, monkeypatch):
    rows = prose(2, 20)
    asked = []
    unique = co._unique
    monkeypatch.setattr(co, "_unique", lambda df, c: asked.append(c) or (len(asked) > 2 and unique(df, c)))
    counts, clashed = co._group_counts, [1]
    monkeypatch.setattr(co, "_group_counts", lambda *a: None if clashed and clashed.pop() else counts(*a))
    assert answer(co.collocations(frame(spark, rows), 3)) == brute(rows, 3)
    assert asked == ["id", "id", "id", "hash", "id", "hash"]


def test_empty_tables_and_scores_beyond_64_bits(spark):
    assert co.collocations(frame(spark, prose(1, 3)).limit(0)).count() == 0
    assert co.collocations(frame(spark, [(None, None), ("", "en")])).count() == 0
    big = spark.sql("SELECT 90000000000000000L AS c0, 99999999999999999L AS n, 90000000000000000L AS c1, 90000000000000001L AS c2")
    assert big.select(co._score("c1", "c2")).first()[0] == 1000 * 90000000000000000 * 99999999999999999 // (90000000000000000 * 90000000000000001)


def test_perfect_hash_has_a_slot_for_each_and_tells_others_apart():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        hashes = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert sorted(co.PerfectHash(hashes).slots(hashes)) == list(range(len(hashes)))
    words = rng.integers(-(2**63), 2**63, (500, 2), dtype=np.int64)
    table = co.Slots(hashes[:500], list(words), 3)
    assert (table.find(hashes[:500], lambda rows: words.view(np.uint64)[rows], 2) >= 0).all()
    assert (table.find(hashes[:500], lambda rows: words.view(np.uint64)[rows][:, ::-1], 2) < 0).all()
    assert table.clashes == 500  # other words under a hash that is stored
    assert (table.find(hashes[500:], lambda rows: np.zeros((len(rows), 2), np.uint64), 2) < 0).all()
    assert table.clashes == 500
