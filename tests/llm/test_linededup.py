import hashlib
import random

from ledgerloom.llm import linededup, scratch
from tests.llm.texts import corpus, frame, recorded_plans, sentence


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(rows, near=20):
    """Texts without dropped lines; ids are unique here."""
    first = {}
    for i, t in sorted(rows):
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            if line.strip(" \t\n\x0b\x0c\r"):
                first.setdefault(line, (i, k))
    long = {line: at for line, at in first.items() if len(line) >= near}
    close = {line for line, at in long.items() for other, before in long.items() if before < at and one_edit(line, other)}
    out = {}
    for i, t in rows:
        lines = t.split("\n") if t is not None else []
        kept = [x for k, x in enumerate(lines) if x not in first or (first[x] == (i, k) and x not in close)]
        out[i] = (None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def edited(rng, line):
    k = rng.randrange(len(line))
    return rng.choice([line[:k] + line[k + 1 :], line[:k] + rng.choice("xyzé") + line[k + 1 :], line[:k] + "q" + line[k:]])


def answer(df):
    return {r.doc_id: (r.kept_text, r.n_lines, r.n_dropped) for r in df.select("doc_id", "kept_text", "n_lines", "n_dropped").collect()}


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows = corpus(3)
    lines = [x for _, t in rows if t for x in t.split("\n") if len(x) >= 20][:40] + ["p. " + "1" * 20, "aaaaaaaaaaaaaaaaaaaaaaa"]
    for _ in range(120):
        lines.append(edited(rng, rng.choice(lines)))
    rng.shuffle(lines)
    rows += [(1000 + i, "\n".join(lines[4 * i : 4 * i + 4])) for i in range(len(lines) // 4)]
    expected = brute(rows)
    assert sum(n for _, _, n in expected.values()) > 100
    assert answer(linededup.dedup_lines(frame(spark, rows))) == expected


def test_earliest_stays_and_short_repeats_go(spark):
    """Short lines go only for an equal one, and blank lines stay."""
    a = "a line of more than twenty characters"
    rows = [(2, a + "\nshort\n" + a), (1, a.replace("twenty", "twentx")), (3, "short\n\nshart\n "), (4, None), (5, ""), (6, "\n ")]
    expected = {1: (a.replace("twenty", "twentx"), 1, 0), 2: ("short", 3, 2), 3: ("\nshart\n ", 4, 1), 4: (None, 0, 0), 5: ("", 1, 0), 6: ("\n ", 2, 0)}
    assert brute(rows) == expected
    assert answer(linededup.dedup_lines(frame(spark, rows))) == expected


def test_least_length_of_near_lines_is_a_parameter(spark):
    rows = [(1, "short"), (2, "shart\nother"), (3, "shart")]
    assert answer(linededup.dedup_lines(frame(spark, rows), near_chars=5)) == brute(rows, 5) == {1: ("short", 1, 0), 2: ("other", 2, 1), 3: ("", 1, 1)}


def test_shuffle_joins_give_the_same(spark, monkeypatch):
    """With no side small enough to be broadcast."""
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", -1)
    rows = corpus(9, 40)
    rows += [(500 + i, edited(random.Random(i), "a line of more than twenty characters")) for i in range(12)]
    assert answer(linededup.dedup_lines(frame(spark, rows))) == brute(rows)


def test_repeated_rows_share_a_fate_and_null_ids_come_first(spark):
    a = "a line of more than twenty characters"
    rows = [(1, a), (1, a), (None, a)]
    got = sorted((r.doc_id is None, r.n_dropped) for r in linededup.dedup_lines(frame(spark, rows)).collect())
    assert got == [(False, 1), (False, 1), (True, 0)]


def test_columns_stay_and_empty_table(spark):
    docs = frame(spark, [(1, "x")])
    out = linededup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "kept_text", "n_lines", "n_dropped"]
    assert linededup.dedup_lines(docs.limit(0)).collect() == []


def test_no_plan_has_python(spark, monkeypatch):
    """None of the stored steps, nor the last."""
    plans = recorded_plans(monkeypatch, linededup, lambda: linededup.dedup_lines(frame(spark, [(1, sentence(random.Random(1), 9))])))
    assert len(plans) > 5 and not any(x in p for p in plans for x in ("Python", "Arrow", "Pandas"))


def test_digest_of_kept_text(spark):
    from pyspark.sql import functions as F

    out = linededup.dedup_lines(frame(spark, [(1, "é\nb")])).select(F.sha2(F.col("kept_text").cast("binary"), 256).alias("s")).first()
    assert out.s == hashlib.sha256("é\nb".encode()).hexdigest()


def test_long_lines_in_linear_work(spark):
    """Lines of a megabyte, one edit or two apart, beside some of a few thousand characters."""
    rng = random.Random(21)
    long = "".join(rng.choice("abcdefgh é") for _ in range(1_000_000))
    mid = [sentence(rng, 700) for _ in range(3)]
    rows = [(0, long), (1, long[:400_003] + "X" + long[400_003:]), (2, long[:999_999] + "z"), (3, "q" + long[1:-1] + "q"), (4, long[1:]), (5, long[:500_000] + "??" + long[500_002:])]
    rows += [(10 + i, m) for i, m in enumerate(mid)] + [(20 + i, edited(rng, m)) for i, m in enumerate(mid)] + [(30 + i, edited(rng, edited(rng, m))) for i, m in enumerate(mid)]
    got = {i: n for i, (_, _, n) in answer(linededup.dedup_lines(frame(spark, rows))).items()}
    assert {i for i, n in got.items() if n} >= {1, 2, 4, 20, 21, 22} and not got[0] and not got[5] and not got[3]
    small_rows = [r for r in rows if r[0] >= 10]
    want = brute(small_rows)
    assert all(got[i] == want[i][2] for i, _ in small_rows)


def test_parts_are_cut_again_at_any_length(spark, monkeypatch):
    monkeypatch.setattr(linededup, "PIECE", 2)
    rng = random.Random(22)
    lines = ["".join(rng.choice("ab") for _ in range(rng.randint(20, 60))) for _ in range(40)]
    lines += [edited(rng, rng.choice(lines)) for _ in range(60)]
    rows = [(i, "\n".join(lines[5 * i : 5 * i + 5])) for i in range(20)]
    assert answer(linededup.dedup_lines(frame(spark, rows))) == brute(rows)
