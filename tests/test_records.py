"""Records of JSON bodies as rows, and what is built on numbers of rows."""

import json
import random
import stat
import warnings

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import paging, records, summary
from ledgerloom.plans import service
from ledgerloom.sources import bodies, http, json_state, mock
from tests.test_finance import Bank, bank  # noqa: F401  a fixture


def parse(text):
    try:
        return json.loads(text, object_pairs_hook=records._ordered, parse_constant=records._no_constant)
    except (ValueError, RecursionError):
        return None


def expected(text):
    """The first record array by a plain descent of the parsed body."""

    def find(body, top):
        inner = list(body.values()) if isinstance(body, dict) else body if isinstance(body, list) else []
        if isinstance(body, list) and all(isinstance(x, (dict, list)) for x in body) and (body or top):
            return body
        return next((f for f in (find(x, False) for x in inner) if f), None)

    return find(parse(text), True) or []


def body(rng, depth=0):
    kind = rng.random()
    if depth > 4 or kind < 0.3:
        return rng.choice(["null", "true", "-1.5e3", '"a\\"]}{[,:"', '"é"', "0", '""', " 12 "])
    blank = rng.choice(["", " ", "\n\t "])
    if kind < 0.65:
        return "[" + blank + ("," + blank).join(body(rng, depth + 1) for _ in range(rng.randint(0, 4))) + blank + "]"
    return "{" + blank + f"{blank},".join(f'"{rng.choice(["a", "b", "7", "3", "a\\u0062", ""])}"{blank}:{blank}{body(rng, depth + 1)}' for _ in range(rng.randint(0, 4))) + "}"


def test_records_are_those_of_the_parsed_body():
    rng = random.Random(5)
    for _ in range(3000):
        text = rng.choice(["", " ", "\n"]) + body(rng) + rng.choice(["", " ", "\n"])
        assert list(records.records_of(text)) == expected(text), text
        cut = text[: rng.randrange(len(text) + 1)] + rng.choice(["", "]", "x", ","])
        assert list(records.records_of(cut)) == expected(cut), cut


def test_what_is_no_json():
    for text in (None, "", " ", "[1,]", "{]", "NaN", "[NaN]", "[{}] x", '{"a":1,}', "﻿[{}]", "[" * 200_000, '{"a":[{"b":"\x01"}]}'):
        assert records.json_start(text) is None and not list(records.records_of(text))
    deep = '{"a":' * 300 + '[{"x":1}]' + "}" * 300
    assert list(records.records_of(deep)) == [{"x": 1}]


def test_rows_leave_in_batches(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(records, "BATCH_RECORDS", 3)
    bodies = [json.dumps([{"k": i} for i in range(n)]) for n in (0, 1, 7, 3)] + ["x", None]
    given = pa.record_batch([pa.array(range(6)), pa.array(bodies)], ["id", "body"])
    out = list(records._record_batches(["id"], "body", False)([given]))
    assert max(b.num_rows for b in out) == 3 and [r for b in out for r in b.column("id").to_pylist()] == [1] + [2] * 7 + [3] * 3
    assert [r for b in out for r in b.column("ordinal").to_pylist()] == [0, *range(7), *range(3)]
    out = pa.Table.from_batches(records._record_batches(["id"], "body", True)([given])).to_pylist()
    assert {(r["id"], r["problem"]) for r in out} == {(0, "no_records"), (1, None), (2, None), (3, None), (4, "not_json"), (5, "not_json")}


def test_a_body_of_100_mb(spark):
    """One body's records become rows in batches; nothing holds them as one value."""
    n, width = 400_000, 215
    record = F.concat(F.lit('{"valor":'), F.col("id").cast("string"), F.lit(',"nota":"'), F.repeat(F.lit("x"), F.lit(width)), F.lit('"}'))
    one = spark.range(n).repartition(1).select(record.alias("r")).agg(F.concat(F.lit('{"meta":{"a":[]},"data":['), F.array_join(F.collect_list("r"), ","), F.lit("]}")).alias("body"))
    rows = records.normalize_transactions(one, F.lit("a"))
    found = rows.agg(F.count("*").alias("n"), F.sum("amount.amount").alias("s"), F.max("ordinal").alias("last")).first()
    assert (found.n, found.s, found.last) == (n, n * (n - 1) / 2, n - 1)


def test_table_function_in_sql(spark):
    records.register(spark)
    spark.createDataFrame([(1, '{"b":[{"x":1},[2]],"7":[{"y":null}]}'), (2, "[]"), (3, None)], "i int, body string").createOrReplaceTempView("bodies")
    rows = spark.sql("SELECT i, r.* FROM bodies, LATERAL json_records(body) r").collect()
    assert [(r.i, r.ordinal, [tuple(e) for e in r.record]) for r in rows] == [(1, 0, [("y", "null", None)])]


def test_scan_tells_what_is_wrong_with_each_response(spark):
    rows = [
        (1, "https://h.co/api", 200, '[{"numero":"12345","saldo":"1.000"},{"x":1},{"saldo":2}]'), (2, "https://h.co/login", 200, "[]"), (3, "https://h.co/api", 403, "x"), (4, "https://h.co/api", 500, "[]"),
        (5, "https://h.co/api", 200, "<html>"), (6, "https://h.co/api", 204, None), (7, None, 200, "[]"), (8, "https://h.co/api", 200, '{"a":1}'), (9, "https://h.co/api", None, "[]"),
    ]
    out = records.scan_accounts(spark.createDataFrame(rows, "seq long, url string, status int, body string")).orderBy("seq", "ordinal").collect()
    assert [(r.seq, r.problem) for r in out] == [(1, None), (1, None), (2, "rejected"), (3, "rejected"), (4, "failed"), (5, "not_json"), (6, "not_json"), (7, "no_records"), (8, "no_records"), (9, "failed")]
    assert [(r.id, r.name, r.number, r.balance.amount) for r in out[:2]] == [("12345", "Cuenta 1", "****2345", 1000), ("acct-3", "Cuenta 3", "****", 2)]
    assert all(r[c] is None for r in out[2:] for c in ("id", "name", "type", "number", "balance"))


def test_deep_pages_by_counts(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.choice([None, *range(5)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "x string, y int, z int").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2]))
    for page, size in ((0, 10), (7, 100), (29, 100), (30, 100), (299, 10), (1, 2500), (10**6, 10), (-2, 5)):
        begin = max(0, page) * size
        assert [tuple(r) for r in paging.page_slice(df, ["x", "y", "z"], page, size, few=40).collect()] == order[begin : begin + size]
    part, before = paging.rank_range(df, ["x", "y", "z"], 2500, 2510, few=40, fanout=8)
    assert before + part.count() >= 2510 and before <= 2500 and part.count() <= 40
    same = spark.createDataFrame([(1,)] * 500, "x int")
    assert paging.page_slice(same, ["x"], 3, 100, few=40).count() == 100  # ties can't be parted


def test_running_sums_of_blocks(spark):
    rng = random.Random(4)
    rows = sorted({("hot" if rng.random() < 0.6 else f"k{rng.randrange(9)}", rng.randrange(-300, 5000)) for _ in range(2000)})
    counts = spark.createDataFrame([(k, p, p % 7) for k, p in rows], "k string, page int, n int")
    got = {(r.k, r.page): r.before for r in paging.running_before(counts, ["k"], "page", "n", block=16).collect()}
    sums: dict[str, int] = {}
    want = {}
    for k, p in rows:
        want[k, p] = sums.get(k, 0)
        sums[k] = sums.get(k, 0) + p % 7
    assert got == want
    places = {(r.k, r.page): r.place for r in paging.numbered(counts, ["k"], "page", 64).collect()}
    seen: dict[str, int] = {}
    for k, p in rows:
        assert places[k, p] == seen.get(k, 0)
        seen[k] = seen.get(k, 0) + 1


def test_no_window_holds_a_hot_account(spark):
    """A third of all rows belongs to one account; the largest window is a block of its pages."""
    rows = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE string(id % 1000) END AS k", "id div 10 AS page", "int(id % 10) AS pos")
    got = paging.synthetic_ids(rows, ["k"], "page", "pos", F.col("pos") != 4, F.lit(None).cast("string"))
    plain = rows.filter("pos <> 4").groupBy("k", "page").count().collect()
    assert got.count() == sum(r["count"] for r in plain)
    hot = sorted((r.page, r["count"]) for r in plain if r.k == "hot")
    want = {p: sum(n for q, n in hot if q < p) for p, _ in hot[:: len(hot) // 7]}
    assert all(int(r.tx_id[3:]) == want[r.page] + r.pos + 1 for r in got.filter(F.col("k") == "hot").collect() if r.page in want)
    plan = got._jdf.queryExecution().toString()
    assert plan.count("Window") and "windowspecdefinition(k#" in plan and "_block" in plan


def test_truncation_reaches_the_caller(spark):
    pages = spark.createDataFrame([(w, p, 0, str(p)) for w, n in (("a", 5), ("b", 2), ("c", 7)) for p in range(n)], "w string, page int, pos int, v string")
    watch = paging.TruncationWatch()
    walked = watch.pages(paging.walk_pages(paging.page_signatures(pages, ["w"], "page", "pos", F.col("v")), ["w"], max_pages=5))
    assert walked.count() == 12
    with pytest.warns(paging.TruncationWarning, match="2 histories"):
        assert watch.report() == {"walks": 3, "truncated_walks": 2, "pages": 12}


def test_truncation_of_a_live_history(spark, bank):  # noqa: F811
    http.register(spark)
    load = lambda cap: spark.read.format("paged_history").options(url=bank, token="t", accounts="a,b", page_size=2, max_pages=cap, mark_truncated="true").load()
    for cap, cut, n in ((1, 2, 4), (3, 0, 10)):
        watch = paging.TruncationWatch()
        assert watch.rows(load(cap)).count() == n
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            assert watch.report() == {"truncated_walks": cut, "rows": n}
    assert "truncated" not in spark.read.format("paged_history").options(url=bank, accounts="a").load().columns


def test_pages_out_of_the_walk_are_not_parsed(spark):
    pages = [(p, json.dumps([{"valor": p, "fecha": "01/07/2026"}])) for p in range(8)]
    out = service.replayed_history(spark.createDataFrame(pages, "page int, body string"), "2026-07-01", "2026-07-31", "acc", start_page=2, max_pages=3)
    assert [(r.id, r.amount.amount, r.truncated) for r in out.orderBy("page").collect()] == [("tx-1", 2.0, True), ("tx-2", 3.0, True), ("tx-3", 4.0, True)]
    assert "MapInArrow" not in out._jdf.queryExecution().toString()  # what is parsed was stored


def test_pages_are_chosen_before_they_are_parsed(spark, monkeypatch):
    plans = []
    fields = records.transaction_fields
    monkeypatch.setattr(records, "transaction_fields", lambda rows, keep: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or fields(rows, keep))
    service.replayed_history(spark.createDataFrame([("a", 1, "[]")], "account string, page int, body string"), "2026-07-01", "2026-07-31")
    (plan,) = plans
    assert plan.count("MapInArrow") == 1 and "Filter" in plan.partition("MapInArrow")[2]


def test_state_files_are_replaced_whole(spark, tmp_path):
    path = tmp_path / "state" / "captures.json"
    rows = spark.range(10).repartition(3).select("id", F.struct((F.col("id") * 2).alias("x")).alias("s"), F.lit("é").alias("t"), F.lit(None).cast("string").alias("u"))
    json_state.save(rows, str(path))
    assert sorted(json.loads(path.read_text()), key=lambda r: r["id"]) == [{"id": i, "s": {"x": 2 * i}, "t": "é", "u": None} for i in range(10)]
    assert stat.S_IMODE(path.stat().st_mode) == 0o600 and stat.S_IMODE(path.parent.stat().st_mode) == 0o700
    before = path.read_bytes()
    failing = rows.withColumn("id", F.when(F.col("id") == 7, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        json_state.save(failing, str(path))
    assert path.read_bytes() == before and [p.name for p in path.parent.iterdir()] == ["captures.json"]
    json_state.save(rows.limit(2), str(path), "append")
    assert len(json.loads(path.read_text())) == 12
    json_state.save(rows.limit(0), str(path))
    assert json.loads(path.read_text()) == [] and spark.read.json(str(path), multiLine=True).count() == 0


def test_literal_tables(spark):
    moved = mock.transactions(spark).groupBy("amount.currency").agg(F.count("*").alias("n"), F.sum("amount.amount").alias("moved")).first()
    assert tuple(moved) == ("COP", 5, 3_071_400.0)
    assert [tuple(r) for r in summary.net_worth(mock.accounts(spark)).collect()] == [("COP", 4_480_500.0)]


def test_picks_from_stored_variants_read_their_fields_only(spark, tmp_path):
    rows = [(1, '{"Valor":5,"big":{"x":[1,2]}}'), (2, '{"valor":null,"MONTO":7}'), (3, '{"monto":"a"}'), (4, '{"a b":1}'), (5, "no json"), (6, None)]
    bodies.store_bodies(spark.createDataFrame(rows, "i int, body string"), f"{tmp_path}/b")
    stored = bodies.read_bodies(spark, f"{tmp_path}/b")
    found = bodies.spellings(stored, ("valor", "monto", "a b", "none"))
    assert found == {"valor": ["Valor", "valor"], "monto": ["MONTO", "monto"], "a b": ["a b"], "none": []}
    has, value = bodies.pick_field([f for k in ("valor", "monto") for f in found[k]])
    picked = stored.select("i", has.alias("has"), value.alias("value"))
    assert [tuple(r) for r in picked.orderBy("i").collect()] == [(1, True, "5"), (2, True, None), (3, True, "a"), (4, False, None), (5, False, None), (6, False, None)]
    plan = picked._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.index("ReadSchema") :]
    assert "body:struct<" in read and "variant" in read and "binary" not in read  # fields of the body, not the whole
    assert spark.conf.get("spark.sql.variant.inferShreddingSchema", None) in (None, "false", "true")
