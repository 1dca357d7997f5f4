"""Each stage of the pipeline on small tables, against brute force where there is one."""

import base64
import random
import string
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from ledgerloom.llm import langid
from ledgerloom.llm.queries import piece_model_path
from ledgerloom.llm.scratch import clear, stored
from tests.llm import test_decontam, test_linededup, test_neardup
from tests.llm.texts import corpus, frame, sentence

SMALL = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage got and gave, over the smallest tables."""
    if not Path(SMALL).exists():
        pytest.skip("no test tables")
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, SMALL), f"test-{name}")
        out[name] = docs, after
        docs = after
    yield out
    clear(spark)


def test_all_but_the_last_return_documents(steps, spark):
    columns = spark.read.parquet(f"{SMALL}/documents.parquet").dtypes
    assert all(after.dtypes == columns for name, (_, after) in steps.items() if name != "sentencepiece")


def test_language_id_drops_what_has_no_language(steps, spark):
    before, after = steps["language_id"]
    assert after.count() >= 0.98 * before.count()
    odd = spark.createDataFrame([(-1, None, None, "s", 0), (-2, "123 ?", "en", "s", 5), (-3, before.first().text, None, "s", 5)], before.schema)
    kept = {r.doc_id: r.lang for r in STAGES["language_id"](spark, before.union(odd), SMALL).filter("doc_id < 0").collect()}
    assert kept == {-3: before.first().lang}


FOREIGN = [
    "Suomen kieli on itämerensuomalainen kieli, jota puhuu noin viisi miljoonaa ihmistä. Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах.",
]


def test_language_id_drops_unseen_languages_and_gibberish(steps, spark):
    """And keeps every held-out labelled document."""
    before, after = steps["language_id"]
    rng = random.Random(13)
    noise = [" ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9))) for _ in range(120)) for _ in range(5)]
    noise.append(base64.b64encode(rng.randbytes(500)).decode())
    odd = [(-1 - i, t, None, "s", len(t)) for i, t in enumerate(FOREIGN + noise)]
    got = {r.doc_id for r in STAGES["language_id"](spark, before.union(spark.createDataFrame(odd, before.schema)), SMALL).collect()}
    assert not {i for i in got if i < 0}
    assert {r.doc_id for r in before.filter(langid.held_out()).collect()} <= got


def test_line_dedup_equals_brute_force(steps):
    before, after = steps["line_dedup"]
    expected = {i: t for i, (t, _, n) in test_linededup.brute(texts(before)).items() if not n or t.split()}
    assert dict(texts(after)) == expected
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_near_dedup_equals_brute_force(steps, spark):
    """On what line dedup leaves, and on that with near copies of some documents: line dedup takes those of whole lines first."""
    before, after = steps["near_dedup"]
    kept = {i for i, (_, _, k) in test_neardup.brute(texts(before), 5).items() if k}
    assert {i for i, _ in texts(after)} == kept
    copies = [(10_000 + i, f"opening {t} and a tail", "en", "s", len(t) + 19) for i, t in texts(before)[:40] if t]
    more = before.union(spark.createDataFrame(copies, before.schema))
    kept = {i for i, (_, _, k) in test_neardup.brute(texts(more), 5).items() if k}
    got = {i for i, _ in texts(STAGES["near_dedup"](spark, more, SMALL))}
    assert got == kept and len(kept) < more.count() - 20


def test_near_dedup_keeps_one_row_of_a_component(spark):
    rng = random.Random(14)
    one, two, three = (sentence(rng, 120) for _ in range(3))
    near = lambda t: t + " tail"
    rows = [(1, one), (1, one), (2, one), (5, two), (5, near(two)), (None, three), (None, three), (None, near(three)), (7, "alone"), (None, None), (None, None)]
    got = texts(STAGES["near_dedup"](spark, frame(spark, rows), SMALL))
    assert len(got) == 6 and got.count((1, one)) == 1 and got.count((7, "alone")) == 1 and got.count((None, None)) == 2
    assert [i for i, t in got if t in (two, near(two))] == [5] and [i for i, t in got if t in (three, near(three))] == [None]


def test_decontamination_equals_brute_force(steps, spark):
    before, after = steps["decontaminate"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    bad = {i for i, x in test_decontam.brute(texts(before), items).items() if x[4]}
    assert bad and {i for i, _ in texts(after)} == {i for i, _ in texts(before)} - bad


def test_encoding_equals_the_library(steps):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
    before, after = steps["sentencepiece"]
    expected = {i: library.encode(t) for i, t in texts(before)}
    rows = after.collect()
    assert len(rows) == before.count() and all(r.round_trip and list(r.token_ids) == expected[r.doc_id] and r.n_tokens == len(expected[r.doc_id]) for r in rows)


def test_run_is_all_stages(steps, spark):
    got = {(r.doc_id, tuple(r.token_ids)) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == {(r.doc_id, tuple(r.token_ids)) for r in steps["sentencepiece"][1].collect()}


@pytest.mark.parametrize("name", list(STAGES))
def test_odd_rows_and_empty_tables(spark, name):
    docs = frame(spark, [*corpus(12, 12), (3, "again"), (3, "again"), (None, "no id"), (None, None)])
    given, after = Counter(texts(docs)), STAGES[name](spark, docs, SMALL)
    if name == "sentencepiece":
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
        found = Counter((r.doc_id, None if r.token_ids is None else tuple(r.token_ids), r.n_tokens, r.round_trip) for r in after.collect())
        ids = lambda t: None if t is None else tuple(library.encode(t))
        same = lambda t: None if t is None else library.decode(library.encode(t)) == t
        assert found == Counter((i, ids(t), len(ids(t) or ()), same(t)) for i, t in given.elements())
    else:
        got = Counter(texts(after))
        if name == "line_dedup":
            lines = {}
            for i, t in given:
                lines.setdefault(i, set()).update((t or "").split("\n"))
            assert all((t is None and (i, t) in given) or set(t.split("\n")) <= lines[i] for i, t in got)
        else:
            assert got <= given  # rows of the table, none more often than before
        assert got[3, "again"] in {"language_id": (0, 2), "line_dedup": (2,), "near_dedup": (1,), "decontaminate": (2,)}[name]
        if name == "decontaminate":
            assert got == given
        if name == "near_dedup":
            assert {t for _, t in given} - {t for _, t in got} <= {t for _, t in corpus(12, 12)} and got[None, None] == 1
    assert STAGES[name](spark, docs.limit(0), SMALL).collect() == []
