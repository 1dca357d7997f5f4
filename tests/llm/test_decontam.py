import hashlib
import random
import re

from ledgerloom.llm import decontam, scratch
from tests.llm.texts import corpus, frame, recorded_plans, sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    out = {}
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for item, text in items:
            q = words(text)
            n = min(window, len(q))
            for s in range(len(q) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == q[s : s + n]:
                        hit.update(range(p, p + n))
                        found.add(item)
        names = sorted(str(x) for x in found if x is not None)
        out[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def answer(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def case():
    rng = random.Random(5)
    docs = corpus(5, 40)
    items = [(k, sentence(rng, rng.randint(10, 40))) for k in range(12)] + [(100, None), (101, ""), (102, "three Short words"), (10, "ß Été, naïve " * 6)]
    items.append((103, items[0][1]))
    for k, (_, text) in enumerate(items):
        if text:
            parts = text.split(" ")
            cut = parts[rng.randint(0, 3) :][: rng.randint(8, 30)]
            docs.append((500 + k, sentence(rng, 30) + " " + "; ".join(cut).upper() + "! " + sentence(rng, rng.randint(1, 400))))
            docs.append((600 + k, text.replace(" ", "-")))
    docs.append((700, "the " * 60 + "three short WORDS"))
    items.append((104, "the " * 20))
    return docs, items


def test_equals_brute_force(spark):
    docs, items = case()
    expected = brute(docs, items)
    assert sum(e[4] for e in expected.values()) > 5
    got = decontam.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert answer(got) == expected


def test_shuffle_joins_give_the_same(spark, monkeypatch):
    """With no side small enough to be broadcast."""
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", -1)
    docs, items = case()
    got = decontam.contamination(frame(spark, docs[:25] + docs[-10:]), spark.createDataFrame(items, "item_id long, text string"))
    assert answer(got) == brute(docs[:25] + docs[-10:], items)


def test_repeats_null_ids_and_empty_tables(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    items = spark.createDataFrame([(1, item), (1, item), (None, "x y z")], "item_id long, text string")
    rows = [(1, item), (1, item), (1, "x y z"), (None, item), (2, None)]
    out = decontam.contamination(frame(spark, rows), items)
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in out.collect())
    assert got == [(0, 13, 13, 1, True), (1, 3, 3, 0, True), (1, 13, 13, 1, True), (1, 13, 13, 1, True), (2, 0, 0, 0, False)]
    assert decontam.contamination(frame(spark, rows).limit(0), items).collect() == []
    assert {r.n_hit for r in decontam.contamination(frame(spark, rows), items.limit(0)).collect()} == {0}


def test_long_items_take_work_in_proportion(spark):
    """An item of 20,000 words that stands whole in a document, beside one of a single word again and again."""
    rng = random.Random(6)
    item = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(20_000))
    rows = [(1, "before " + item + " after"), (2, " ".join(item.split()[500:512])), (3, " ".join(item.split()[500:513])), (4, "the " * 300)]
    items = spark.createDataFrame([(1, item), (2, "the " * 200)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontam.contamination(frame(spark, rows), items).collect()}
    assert got == {1: (20_002, 20_000, 1), 2: (12, 0, 0), 3: (13, 13, 1), 4: (300, 300, 1)}


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    docs = [(1, "x " + item), (2, "x " + item.replace("beta gamma", "gamma beta")), (3, item.replace("alpha", "omega"))]
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    found = {(r.rec_id, r.exact) for r in decontam.matches(frame(spark, docs), items, slop=1).collect()}
    assert (1, True) in found and (2, False) in found and not any(i == 3 for i, _ in found) and (2, True) not in found


def test_no_plan_has_python(spark, monkeypatch):
    """None of the stored steps, nor the last."""
    docs, items = case()
    plans = recorded_plans(monkeypatch, decontam, lambda: decontam.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")))
    assert len(plans) > 5 and not any(x in p for p in plans for x in ("Python", "Arrow", "Pandas"))
