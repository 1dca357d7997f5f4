"""Token counts, SentencePiece, sharding, quality rules and language ID."""

import math
import random
import statistics
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import langid, quality, sentencepiece_fst, sharding, token_counts
from ledgerloom.llm.queries import piece_model_path
from ledgerloom.llm.scratch import new_folder
from tests.llm.texts import corpus, frame, sentence

ODD = ["", " ", "   leading and  double   ", "tab\tand\nnew\n\nline", "é ß 漢字 🎉 ​", "▁mark ▁▁ in text", "x" * 3000, " " * 2000 + "a", "<s> </s> <unk> <0x0A>", "a b" * 4000, "1,234.50 and 0123456789", "�\x00\x7f"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_model_path())


def test_token_counts_equal_the_library(spark, library):
    rows = [*corpus(1), *((1000 + i, t) for i, t in enumerate(ODD)), (5, "again"), (5, "again"), (None, "x")]
    out = token_counts.count_tokens(frame(spark, rows), piece_model_path(), piece_chars=50, batch_bytes=200).collect()
    expected = Counter((i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in rows)
    assert Counter(map(tuple, out)) == expected
    assert token_counts.count_tokens(frame(spark, rows).limit(0), piece_model_path()).collect() == []


def test_cuts_are_safe(library):
    assert token_counts.can_cut(library)
    for text in ODD:
        for limit in (1, 7, 100):
            pieces = list(token_counts.safe_pieces(text, limit))
            assert " ".join(pieces) == text
            assert [x for p in pieces for x in library.encode(p)] == library.encode(text)


def test_texts_without_spaces_are_cut(spark, library):
    """Also between characters of which no piece has both, in frames; what can't be cut is encoded whole."""
    rng = random.Random(16)
    signs = "漢字仮名交文日本語中国人大小上下天地" + "ñßé🎉ж"
    texts = ["".join(rng.choices(signs, k=5000)), "".join(rng.choices(signs + "ab 1", k=3000)), "ab" * 3000, "字" * 4000, "▁字" * 900]
    counter = token_counts._Counter.of(piece_model_path())
    assert len(list(counter.pieces(texts[0], 50))) > 20
    assert all("".join(p for p, _ in counter.pieces(t, 50)) == t for t in texts if " " not in t)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame(spark, list(enumerate(texts))), piece_model_path(), piece_chars=50, batch_bytes=500).collect()}
    assert got == {i: len(library.encode(t)) for i, t in enumerate(texts)}


def test_transducer_equals_the_library(library):
    model = sentencepiece_fst.Transducer.of(piece_model_path())
    rng = random.Random(2)
    texts = ODD + [t for _, t in corpus(2) if t] + ["".join(rng.choices("ab  ▁\n\ttheéñß漢🎉.,01' quick", k=rng.randrange(50))) for _ in range(2000)]
    for text in texts:
        ids = library.encode(text)
        assert model.encode(text) == ids
        assert model.decode(ids) == library.decode(ids)
        if "▁" not in text:
            assert model.decode(ids) == text
    for _ in range(300):
        ids = [rng.randrange(3, 259) if rng.random() < 0.3 else rng.randrange(259, 32_000) for _ in range(8)]
        assert model.decode(ids).replace("�", "") == library.decode(ids).replace("�", "")


def test_long_and_short_stretches_take_the_same_paths(monkeypatch):
    """Long stretches take the paths of all their prefixes in order, short ones those that they ask for."""
    model = sentencepiece_fst.Transducer.of(piece_model_path())
    texts = [t for _, t in corpus(21) if t] + ODD
    short = [model.encode(t) for t in texts]
    monkeypatch.setattr(sentencepiece_fst, "MEMO_CHARS", 0)
    model.memo.clear()
    model.older.clear()
    assert [model.encode(t) for t in texts] == short


def test_normaliser_states():
    """Without trimming every space is a mark; with it, those at the ends go and runs are one."""
    for text in ("", " ", "  a  b ", "a", " a"):
        assert sentencepiece_fst.Normaliser(True, False).apply(text) == (("▁" if text else "") + text.replace(" ", "▁"))
        words = text.split()
        assert sentencepiece_fst.Normaliser(True, True).apply(text) == "".join("▁" + w for w in words)
        assert sentencepiece_fst.Normaliser(False, True).apply(text) == "▁".join(words)


def test_transducer_of_a_unigram_model():
    """Scores add up: the least sum wins, and unknown characters without byte fallback are the unknown piece."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.trainer_spec.model_type = 1
    proto.normalizer_spec.remove_extra_whitespaces = True
    for piece, score, kind in [("<unk>", 0, 2), ("▁", -3, 1), ("a", -2, 1), ("b", -2, 1), ("ab", -3, 1), ("▁a", -2.5, 1), ("▁ab", -6, 1)]:
        proto.pieces.add(piece=piece, score=score, type=kind)
    model = sentencepiece_fst.Transducer(proto.SerializeToString())
    assert model.encode("ab") == [5, 3]  # 4.5 against 6 for the whole and for the mark with ab
    assert model.encode("  b ab  ") == [1, 3, 5, 3]
    assert model.encode("ax") == [5, 0] and model.encode("") == []


def test_encode_and_decode_frames(spark, library):
    rows = [*corpus(3, 30), (5, "again"), (5, "again"), (None, "x")]
    docs = frame(spark, rows).withColumn("token_ids", F.lit(1))
    encoded = sentencepiece_fst.encode(docs, piece_model_path(), keep=("doc_id", "text", "rec_id"))
    got = Counter((r.doc_id, r.text, r.rec_id, None if r.token_ids is None else tuple(r.token_ids)) for r in encoded.collect())
    assert got == Counter((i, t, 1, None if t is None else tuple(library.encode(t))) for i, t in rows)
    decoded = sentencepiece_fst.decode(encoded, piece_model_path(), keep=("doc_id", "text"))
    assert all(r.decoded == r.text for r in decoded.collect())
    assert sentencepiece_fst.decode(encoded.limit(0), piece_model_path()).collect() == []


def test_shards_are_even_and_gapless(spark):
    rows = [*corpus(4, 300), (5, "again"), (5, "again"), (None, "x"), (None, None), (None, "x")]
    path = new_folder(spark, "map")
    out = sharding.assign_shards(frame(spark, rows), map_path=path, n_shards=5, n_slots=256).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    places = {s: sorted(r.slot for r in out if r.shard == s) for s in range(5)}
    assert all(p == list(range(len(p))) for p in places.values())
    held = [sum(r["size"] for r in out if r.shard == s) for s in range(5)]
    assert max(held) - min(held) <= max(size(t) for _, t in rows)
    kept = sharding.SlotMap.read(spark, path)
    assert kept.version == 1 and {(r.virtual_slot, r.shard) for r in out} <= set(enumerate(kept.shards))
    assert sharding.assign_shards(frame(spark, rows).limit(0)).collect() == []


def test_one_id_and_floods_of_rows(spark):
    """Rows of one id are dealt by their texts; rows equal in both get places of their own, numbered in parts."""
    rows = [(1, f"text {i}" * 9) for i in range(600)] + [(2, "same")] * 500 + [(None, "same")] * 300
    out = sharding.assign_shards(frame(spark, rows).repartition(7), n_shards=4, n_slots=512).collect()
    assert len({r.shard for r in out if r.doc_id == 1}) == 4 and len({r.virtual_slot for r in out if r.doc_id == 2}) == 1
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    held = [sum(r["size"] for r in out if r.shard == s and r.doc_id == 1) for s in range(4)]
    assert max(held) < 1.5 * sum(held) / 4


def test_rebalancing_moves_few_slots(spark):
    rng = random.Random(5)
    size = [rng.randrange(100) for _ in range(400)]
    old = sharding.plan_map(size, [1] * 400, 6)
    assert max(old.loads()) - min(old.loads()) <= 2
    size[7] += 900
    new = sharding.rebalance(old, size, [1] * 400)
    grown = sharding.rebalance(new, size, [1] * 400, n_shards=7)
    for m, before in ((new, old), (grown, new)):
        assert m.version == before.version + 1 and max(m.loads()) <= sum(size) / m.n_shards * 1.03
    assert sum(a != b for a, b in zip(old.shards, new.shards)) < 120
    moved = [b for a, b in zip(new.shards, grown.shards) if a != b]
    assert moved.count(6) > 0.7 * len(moved) and len(moved) < 120
    path = new_folder(spark, "maps")
    for m in (old, new, grown):
        m.write(spark, path)
    assert sharding.SlotMap.read(spark, path) == grown and sharding.SlotMap.read(spark, path, 2) == new


def test_write_shards_follows_the_map(spark):
    docs = frame(spark, corpus(6, 40))
    m = sharding.plan_map([1] * 64, [1] * 64, 3)
    path = new_folder(spark, "shards")
    sharding.write_shards(docs, m, path)
    back = spark.read.parquet(path)
    want = {r.doc_id: r.shard for r in sharding.assign_shards(docs, m).collect()}
    assert {r.doc_id: r.shard for r in back.collect()} == want


def brute_counts(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    repeated = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines = [x for x in (text or "").split("\n") if any(c not in " \t\n\x0b\x0c\r" for c in x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts():
    rng = random.Random(7)
    texts = [t for _, t in corpus(7)] + ODD + ["".join(rng.choices("ab \n#\x0b\xa0", k=rng.randrange(80))) for _ in range(500)]
    for text in texts:
        assert quality.text_counts(text) == brute_counts(text)


def test_thresholds_follow_each_group(spark):
    """Thresholds are the quantiles of a group's own texts, and an outlier there goes though other groups are full of such."""
    rng = random.Random(8)
    plain = [(i, sentence(rng, 80)) for i in range(40)]
    marked = [(100 + i, sentence(rng, 80).replace(" ", " ###")) for i in range(40)]
    schema = "doc_id long, text string, lang string, source string"
    rows = [(i, t, "en", "a") for i, t in plain] + [(i, t, None, "b") for i, t in marked] + [(900, marked[0][1], "en", "a"), (901, None, "en", "a"), (902, "", None, None), (903, "few words", "en", "a")]
    out = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, schema)).collect()}
    assert all(out[i].kept for i, _ in plain + marked)
    assert not out[900].kept and not out[900].base_failed and out[900].max_symbol_ratio < 40 < out[100].max_symbol_ratio
    assert all(out[i].base_failed and not out[i].kept for i in (901, 902, 903))
    assert quality.judge(spark.createDataFrame(rows, schema).limit(0)).collect() == []


def test_repeat_thresholds_differ_between_groups(spark):
    """A fifth of repeated lines goes where no other text has any, and stays where a tenth of the texts do."""
    rng = random.Random(12)
    lined = lambda again: "\n".join([*(x := [sentence(rng, 20) for _ in range(8)]), *x[:again]])
    rows = [(i, lined(0), "en", "plain") for i in range(60)] + [(100 + i, lined(2 if i % 8 == 0 else 0), "en", "verse") for i in range(64)]
    rows.append((900, lined(2), "en", "plain"))
    out = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not out[900].base_failed and out[900].dup_line_ratio == 200 and not out[900].kept
    assert all(r.kept for i, r in out.items() if i != 900)
    for ratio in ("max_dup_line_ratio", "max_repeat_ratio"):
        assert out[0][ratio] < out[100][ratio]


def brute_verdicts(rows):
    """(fences, kept) of each id, from the sorted ratios of each group."""
    counts = {i: brute_counts(t) for i, t, _, _ in rows}
    group = {i: (g, h) for i, _, g, h in rows}
    passed = [i for i, c in counts.items() if c[0] >= 50 and 2 * c[5] <= c[0]]
    over = lambda a, b, scale, top: min(top, scale * a // b if b else 0)
    ratios = {i: (over(c[2], c[1], 1000, 1000), over(c[4], c[3], 1000, 1000), over(c[5], c[0], 1000, 1000), over(c[1], c[0], 100, 10_000)) for i, c in counts.items()}
    at = lambda values, q: sorted(values)[math.ceil(q * len(values)) - 1]
    members = {g: [j for j in passed if group[j] == g] for g in set(group.values())}
    out = {}
    for i in counts:
        own = members[group[i]]
        fences = []
        for k, (start, low, factor, few, under, scale) in enumerate([(0.8, 0.5, 3, 5, 1, 1000), (0.95, 0.9, 2, 1, 3, 1000), (0.95, 0.9, 2, 10, 0, 1000), (0.5, 0.1, 6, 0, 0, 100)]):
            if own:
                here = [ratios[j][k] for j in own]
                spreads = [at(x, start) - at(x, low) for m in members.values() if m for x in [[ratios[j][k] for j in m]]]
                spread = max(at(here, start) - at(here, low), statistics.median(spreads))
                short = 2 ** (math.floor(math.log2(at([max(1, counts[j][under]) for j in own], 0.1)) * 8) / 8)
                fences.append(at(here, start) + math.floor(factor * spread) + math.floor(scale * few / short))
        out[i] = (tuple(fences) or (None,) * 4, bool(own) and i in passed and all(r <= f for r, f in zip(ratios[i], fences)))
    return out


def test_verdicts_equal_brute_force(spark):
    """And the fences of two groups differ for every ratio."""
    rng = random.Random(15)
    rows = []
    for i in range(160):
        source = "ab"[i % 2]
        lines = [sentence(rng, rng.randint(12, 30) if source == "a" else rng.randint(5, 9)) for _ in range(rng.randint(3, 9) if source == "a" else rng.randint(12, 30))]
        if rng.random() < (0.1 if source == "a" else 0.4):
            lines.append(rng.choice(lines))
        text = "\n".join(lines)
        if rng.random() < 0.15:
            text = text.replace("th", "#*th" if source == "a" else "%th")
        rows.append((i, text if source == "a" else text.replace("er ", "ererer "), rng.choice(["en", None]), source))
    rows += [(900, None, "en", "a"), (901, "alone " * 5, "en", "c"), (902, sentence(rng, 60), None, None)]
    got = {r.doc_id: ((r.max_symbol_ratio, r.max_dup_line_ratio, r.max_repeat_ratio, r.max_word_length), r.kept) for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    expected = brute_verdicts(rows)
    assert got == expected
    assert 5 < sum(not k for _, k in got.values()) < 80
    fences = {(g, h): got[i][0] for i, _, g, h in rows if i < 900}
    assert all(fences["en", "a"][k] != fences["en", "b"][k] for k in range(4))


def test_quantile_sketches_merge_and_are_exact(spark):
    counts = quality.count_texts(frame(spark, corpus(9, 200)))
    keys = ["g0", "g1"]
    whole = quality.sketch(counts, keys)
    parts = quality.sketch(counts.filter("rec_id % 3 = 0"), keys).union(quality.sketch(counts.filter("rec_id % 3 <> 0"), keys)).groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
    at = {"q10": 0.1, "q50": 0.5}
    got = {tuple(r) for r in quality.quantiles(whole, keys, at).collect()}
    assert got == {tuple(r) for r in quality.quantiles(parts, keys, at).collect()}
    group = sorted(1000 * r.n_repeat_words // r.n_words for r in counts.filter("g0 = 'en' AND g1 = 'src0' AND n_words > 0").collect())
    (low, mid), = [x[3:] for x in got if x[:3] == ("en", "src0", "repeat_ratio")]
    assert (low, mid) == (group[-(-len(group) // 10) - 1], group[-(-len(group) // 2) - 1])


@pytest.mark.parametrize("shared", [None, 4, 5, 6])
def test_no_language_is_lost_where_its_rows_share_an_id(spark, shared):
    """Six hundred different texts of one language under one id, or none, beside others with ids of their own."""
    rng = random.Random(12)
    text = lambda letters: " ".join("".join(rng.choices(letters, k=5)) for _ in range(20))
    rows = [(i, text("abcdefgh"), "aa") for i in range(600)] + [(shared, text("äöüxyzvw"), "bb") for _ in range(600)] + [(700, "same same same", "cc")] * 300
    df = spark.createDataFrame(rows, "rec_id long, text string, lang string").repartition(3)
    found = langid.sample_rows(df, 50, 8000).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in found} == {"aa": 50, "bb": 50, "cc": 50}
    assert langid.sample_rows(df, 50, 90).count() == 90
    model = langid.fit(df, per_language=50, landmarks=60)
    names, _ = model.predict([text("äöüxyzvw"), text("abcdefgh"), "same same"])
    assert names == ["bb", "aa", "cc"]


def test_language_of_held_out_texts(spark):
    rng = random.Random(10)
    letters = {"aa": "abcdefgh", "bb": "cdefghij", "cc": "äöüabcde"}
    rows = []
    for i in range(400):
        lang = rng.choice(list(letters))
        rows.append((i, " ".join("".join(rng.choices(letters[lang], k=5)) for _ in range(rng.randint(5, 200))), None if i % 9 == 0 else lang, lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    odd = spark.createDataFrame([(1000, None, "aa", ""), (1001, "", "bb", ""), (1002, "123 !?", "cc", ""), (None, "abc", "aa", ""), (7, rows[7][1], "aa", "")], docs.schema)
    model = langid.learn_from(docs.union(odd), per_language=60, landmarks=60)
    out = langid.identify(docs.union(odd), model, keep=("doc_id", "source")).withColumn("held_out", langid.held_out()).collect()
    assert len(out) == 405
    held = [r for r in out if r.held_out and r.doc_id < 1000]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out if r.doc_id is not None)
    assert len(held) > 60 and sum(r.lang_pred == r.source for r in held) >= 0.97 * len(held)
    assert {(r.lang_pred, r.score) for r in out if r.doc_id in (1000, 1001, 1002)} == {("und", 0.0)}
    assert all(0 <= r.score <= 1 for r in out)
    nothing = langid.learn_from(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).collect() == []


def test_fit_equals_dense_kernel_ridge(spark):
    """With every row a landmark, the Nyström solution is that of the whole kernel matrix."""
    import numpy as np

    rng = random.Random(17)
    rows = [(i, " ".join("".join(rng.choices("abcdefgh" if i % 3 else "efghijkl", k=5)) for _ in range(rng.randint(3, 40))), "ab"[i % 3 == 0]) for i in range(60)]
    model = langid.fit(spark.createDataFrame(rows, "rec_id long, text string, lang string"), landmarks=1000, ridge=1e-2)
    bits = np.zeros((len(rows), langid.BUCKETS), np.float32)
    for row, (_, text, _) in zip(bits, rows):
        langid.presence(text, row)
    unit = bits / np.linalg.norm(bits, axis=1)[:, None]
    kernel = (unit @ unit.T).astype(np.float64)
    target = np.array([[lang == x for x in model.languages] for _, _, lang in rows], float)
    weight = 1 / (target @ target.sum(axis=0))
    dense = np.linalg.solve(kernel + 1e-2 * 2 * np.diag(1 / weight), target)
    assert np.abs(model.scores(bits) - kernel @ dense).max() < 2e-3


def test_every_row_takes_part_in_the_regression(spark):
    """The landmarks are bounded, the rows that the weights follow from aren't."""
    import numpy as np

    rng = random.Random(18)
    letters = {"a": "abcdefgh", "b": "efghijkl", "c": "klmnopab"}
    rows = [(i, " ".join("".join(rng.choices(letters[lang], k=5)) for _ in range(rng.randint(3, 40))), lang) for i, lang in enumerate(rng.choices("abc", (6, 3, 1), k=300))]
    df = spark.createDataFrame(rows, "rec_id long, text string, lang string").repartition(3)
    model = langid.fit(df, per_language=10, landmarks=30, ridge=1e-2)
    bits = {i: np.zeros(langid.BUCKETS, np.float32) for i, _, _ in rows}
    for i, text, _ in rows:
        langid.presence(text, bits[i])
    unit = {i: x / np.linalg.norm(x) for i, x in bits.items()}
    marks = np.stack([unit[r.rec_id] for r in langid.sample_rows(df, 10, 30).collect()]).astype(np.float64)
    assert len(marks) == 30 and model.languages == ("a", "b", "c")
    kernel = np.stack([unit[i] for i, _, _ in rows]) @ marks.T
    target = np.array([[lang == x for x in model.languages] for _, _, lang in rows], float)
    weight = (target / target.sum(axis=0)).sum(axis=1)[:, None]
    square = marks @ marks.T
    alpha = np.linalg.solve(kernel.T @ (kernel * weight) + 1e-2 * 3 * (square + 1e-6 * np.eye(30)), kernel.T @ (target * weight))
    assert np.abs(model.scores(np.stack([bits[i] for i, _, _ in rows])) - kernel @ alpha).max() < 2e-3


def test_least_score_is_of_all_held_out_rows(spark, monkeypatch):
    """More than any bound of old; a rare language, harder than the other, has its own lowest hundredth."""
    monkeypatch.setattr(langid, "CEILING", 1.0)
    rng = random.Random(19)
    letters = {"aa": "abcdefgh", "bb": "abcdefghijkl", None: "abcd"}
    rows = [(i, " ".join("".join(rng.choices(letters[lang], k=5)) for _ in range(rng.randint(2, 12))), lang) for i, lang in enumerate(rng.choices(["aa", "bb", None], (40, 2, 1), k=24_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.learn_from(docs, landmarks=60)
    found = [r for r in langid.identify(docs.filter(langid.held_out()), model, keep=("lang",)).collect() if r.lang == r.lang_pred]
    lowest = lambda own: sorted(own)[int(0.01 * len(own))]
    each = [[r.score for r in found if r.lang in langs] for langs in (["aa", "bb"], ["aa"], ["bb"])]
    assert len(each[0]) > 5000 and len(each[2]) >= 100
    least = langid.ROOM * min(map(lowest, each))
    assert langid.least_score(docs, model) == least < langid.ROOM * lowest(each[1])


def test_order_statistics_with_ties_and_near_values(spark):
    rng = random.Random(20)
    rows = [("x", rng.choice([0.0, 0.25, 0.25 + 2**-40, 1.0])) for _ in range(500)] + [("y", rng.random()) for _ in range(999)] + [("z", 0.5)]
    df = spark.createDataFrame(rows, "part string, score double")
    for share in (0.01, 0.3, 0.5, 0.999):
        expected = {p: (own := sorted(s for q, s in rows if q == p))[int(share * len(own))] for p in "xyz"}
        assert langid.order_statistics(df, share) == expected
    assert langid.order_statistics(df.limit(0), 0.5) == {}


def test_presence_is_the_same_in_windows(monkeypatch):
    import numpy as np

    text = " ".join(t for _, t in corpus(11, 30) if t)
    one, two = np.zeros(langid.BUCKETS, np.uint8), np.zeros(langid.BUCKETS, np.uint8)
    langid.presence(text, one)
    monkeypatch.setattr(langid, "WINDOW", 100)
    langid.presence(text, two)
    assert (one == two).all() and 0 < one.sum() < langid.BUCKETS
