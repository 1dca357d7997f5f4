"""Small corpora with what real ones have: nulls, empty and long texts, copies, near copies, ties."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "the er on an in re ha ti ou es th st wh ing ed sh nd at or ea".split()


def word(rng: random.Random) -> str:
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))


def sentence(rng: random.Random, n: int) -> str:
    return (" ".join(word(rng) for _ in range(n))).capitalize() + "."


def corpus(seed: int, n: int = 60) -> list[tuple[int, str | None]]:
    """(id, text) with ids in no order; a third of the texts are copies or near copies of earlier ones."""
    rng = random.Random(seed)
    common = sentence(rng, 70)
    texts: list[str | None] = [None, "", " \n\t", "One.", "two words", common]
    while len(texts) < n:
        kind = rng.random()
        old = rng.choice([t for t in texts if t])
        if kind < 0.12:
            texts.append(old)
        elif kind < 0.4:
            words = old.split(" ")
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = word(rng)
            texts.append(" ".join(words))
        elif kind < 0.5:
            texts.append(sentence(rng, rng.randint(5, 60)) + "\n" + common + "\n" + sentence(rng, rng.randint(5, 60)))
        elif kind < 0.55:
            texts.append((word(rng) + " ") * rng.randint(150, 400))
        else:
            texts.append("\n".join(sentence(rng, rng.randint(3, 120)) for _ in range(rng.randint(1, 4))))
    texts.append(" ".join(word(rng) for _ in range(6000)) + " " + common)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


def frame(spark: SparkSession, rows: list[tuple[int | None, str | None]]) -> DataFrame:
    """``documents`` of these rows, with extra columns whose names the operators use themselves."""
    full = [(i, t, ("en", "de", None)[k % 3], ("src0", None)[k % 2], len(t or "")) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).selectExpr("*", "1 AS rec_id", "2 AS text_key", "'x' AS name", "3 AS n", "4 AS size", "5 AS line", "6 AS label", "7 AS k1", "8 AS kept")


def recorded_plans(monkeypatch, module, run) -> list[str]:
    """The plans of all tables that a module stores in ``run``, and of what it returns."""
    plans: list[str] = []
    store = module.stored

    def recording(df: DataFrame, name: str) -> DataFrame:
        plans.append(df._jdf.queryExecution().toString())
        return store(df, name)

    monkeypatch.setattr(module, "stored", recording)
    plans.append(run()._jdf.queryExecution().toString())
    return plans
