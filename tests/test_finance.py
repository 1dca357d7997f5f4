import json
import threading
import unicodedata
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.functions import urls as U
from ledgerloom.operators import paging, records, summary
from ledgerloom.plans import service
from ledgerloom.schemas import ACCOUNT, ACCOUNT_URL_HINTS, RESPONSE, TRANSACTION_URL_HINTS
from ledgerloom.sources import files, http
from ledgerloom.streaming import capture


def each(spark, column, values, kind="string"):
    """The column of each value, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").repartition(2)
    return [r.x for r in df.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


NUMBERS = {
    "4.250.000": 4250000, "1.234": 1234, "-215.400": -215400, "1.234,50": 1234.5, "12,50": 12.5, "1.234.567,89": 1234567.89, "$ 4.250.000": 4250000,
    "COP 1.000": 1000, " -1.500 ": -1500, "abc": 0, "": 0, None: 0, "100-": 100, "(500)": 500, "1e5": 15, "0.500": 500, "USD 1,234.50": 1.2345,
    "1,234,567": 1.234, "1234.567": 1234567, "5d": 5, ".5": 0.5, "5.": 5, "-": 0, "1.2345": 1.2345, ",5": 0.5, "1-2": 12, "12.345\n": 12345,
}


def test_numbers(spark):
    assert each(spark, S.to_number, NUMBERS) == [float(x) for x in NUMBERS.values()]


@pytest.mark.parametrize("form", ["NFC", "NFD"])
def test_types(spark, form):
    names = {
        "Ahorros a la Mano": "savings", "Cuenta Corriente": "checking", "Tarjeta de Crédito Visa": "credit_card", "Tarjeta de Crédito": "credit_card", "Crédito Hipotecario": "loan",
        "Préstamo de Libre Inversión": "loan", "Crédito de Vivienda": "loan", "CDT a 360 días": "investment", "Inversión Fiduciaria": "investment", "Algo Raro": "other", "Discard": "credit_card",
    }
    assert each(spark, S.guess_type, [unicodedata.normalize(form, n) for n in names]) == list(names.values())
    assert each(spark, S.fold_text, [unicodedata.normalize(form, n) for n in ("Crédito Hipotecario", "Inversión", "Ÿ Ñandú^")]) == ["credito hipotecario", "inversion", "y nandu"]


def test_folding_leaves_other_letters(spark):
    assert each(spark, S.fold_text, ["Straße", "LØAN", "ﬁn"]) == ["straße", "løan", "ﬁn"]


DATES = {
    "2026-07-03": "2026-07-03", "2026-07-03T10:00:00-05:00": "2026-07-03", "03/07/2026": "2026-07-03", "3/7/2026": "2026-07-03", "03-07-2026": "2026-07-03",
    "03/07/2026 14:30": "2026-07-03", "": "1970-01-01", " \n": "1970-01-01", None: "1970-01-01", "2026/07/03": "2026/07/03", "31/02/2026": "2026-02-31", "sometime in July": "sometime i",
}


def test_dates(spark):
    got = each(spark, S.to_iso_date, DATES)
    assert got == list(DATES.values())
    assert each(spark, S.to_iso_date, got) == got
    assert each(spark, S.is_date_text, ["2026-07-01", "2026-07-01\n", "2026-7-1", "2026-99-99"]) == [True, False, False, True]


def test_masks_and_display(spark):
    assert each(spark, S.mask_number, ["912345671234", "12", "", None]) == ["****1234", "****12", "****", "****"]
    assert each(spark, S.mask_user, ["abcd", "abcdefg", "", "ab"]) == ["****", "ab***fg", "", "**"]
    assert each(spark, lambda c: S.pad_right(c, 3), ["a", "abcd", "abc"]) == ["a  ", "abcd", "abc"]
    assert each(spark, lambda c: S.format_money(c, F.lit("COP")), [2.5, -2.5, 1234567.0], "double") == ["$ 3", "-$ 3", "$ 1.234.567"]
    assert each(spark, lambda c: S.format_money(c, F.lit("USD")), [1234.5], "double") == ["USD 1.234,50"]
    assert each(spark, lambda c: S.format_money(c, F.lit("JPY")), [100.0, -1234.5, 0.0, 1000000.25], "double") == ["JPY 100", "-JPY 1.234,5", "JPY 0", "JPY 1.000.000,25"]
    assert each(spark, lambda c: S.preview(c, 3), ["ab", "abc", "abcd"]) == ["ab", "abc…", "abc…"]


def test_expiry(spark):
    now = F.lit("2026-07-25T12:00:00Z").cast("timestamp")
    assert each(spark, lambda c: S.is_expired(c, now), [None, "2026-07-20T00:00:00Z", "2026-12-31T23:59:59Z", "not-a-date", "2026-07-25T12:00:00Z"]) == [False, True, False, False, True]


def test_url_hints(spark):
    urls = ["https://transaccion.co/api/v1/productos/cuentas", "https://transaccion.co/api/movimientos?x=1", "https://transaccion.co/app.js", "https://h.co/api/data?tipo=EXTRACTO", "https://h.co", "saldo here"]
    assert each(spark, lambda c: U.url_matches(c, TRANSACTION_URL_HINTS), urls) == [False, True, False, True, False, False]
    assert each(spark, lambda c: U.url_matches(c, ACCOUNT_URL_HINTS), urls) == [True, False, False, False, False, True]
    assert each(spark, lambda c: U.same_origin(c, "https://h.co"), ["https://h.co/x", "https://h.co.evil/", "http://h.co"]) == [True, True, False]


def test_auth_rejection(spark):
    urls = ["https://h.co/login", "https://h.co/LOGIN/x", "https://h.co/login-info", "https://h.co/x?redirect=/login", None, "not a url /login"]
    assert each(spark, lambda c: U.is_auth_rejection(F.lit(200), c), urls) == [True, True, False, False, False, True]
    assert each(spark, lambda c: U.is_auth_rejection(F.lit(403), c), [None]) == [True]


def test_set_parameter(spark):
    urls = {
        "https://x.co/api/tx": "https://x.co/api/tx?page=3", "https://x.co/tx?page=1&acc=5": "https://x.co/tx?page=3&acc=5", "https://x.co?a=b c&page=1&page=2#f": "https://x.co/?a=b+c&page=3#f",
        "/rel?x=1": "/rel?x=1&page=3", "rel": "rel?page=3", "https://x.co/?page": "https://x.co/?page=3",
    }
    assert each(spark, lambda c: U.with_query_param(c, "page", "3"), urls) == list(urls.values())


def test_rescope(spark):
    urls = {
        "https://x.co/movimientos?numeroCuenta=OLD&fechaInicial=a&fechaFinal=b&x=keep": "https://x.co/movimientos?numeroCuenta=ACC-NEW&fechaInicial=2026-08-01&fechaFinal=2026-08-31&x=keep",
        "https://x.co/tx?account=OLD&from=a&to=b": "https://x.co/tx?account=ACC-NEW&from=2026-08-01&to=2026-08-31", "https://x.co/movimientos?token=abc": "https://x.co/movimientos?token=abc",
        "not a url": "not a url", "https://x.co/t?from=1&from=2&y=1": "https://x.co/t?from=2026-08-01&y=1", "https://x.co": "https://x.co/",
    }
    assert each(spark, lambda c: U.rescope(c, "ACC-NEW", "2026-08-01", "2026-08-31"), urls) == list(urls.values())


PRODUCTS = {"data": {"productos": [{"numeroProducto": "912345671234", "nombre": "Ahorros", "saldoDisponible": "4.250.000"}, {"numeroProducto": "998877665678", "descripcion": "Tarjeta", "saldo": 890000}]}}


def accounts_of(spark, *bodies):
    df = spark.createDataFrame([(b if isinstance(b, str) else json.dumps(b, ensure_ascii=False),) for b in bodies], "body string")
    return [(r.id, r.name, r.type, r.number, r.balance.amount) for r in records.normalize_accounts(df).orderBy("ordinal").collect()]


def test_accounts(spark):
    assert accounts_of(spark, PRODUCTS) == [("912345671234", "Ahorros", "savings", "****1234", 4250000), ("998877665678", "Tarjeta", "credit_card", "****5678", 890000)]
    assert accounts_of(spark, [{"foo": "bar"}]) == [] and accounts_of(spark, "no json") == []
    assert accounts_of(spark, [{"nombre": "Cuenta Vacía", "saldo": 0}, {"nombre": "x", "saldo": None}]) == [("acct-1", "Cuenta Vacía", "other", "****", 0)]
    assert accounts_of(spark, [{"nombre": "Corta", "numero": "12", "saldo": 100}])[0][3] == "****12"
    assert accounts_of(spark, [{"nombre": None, "descripcion": "X", "saldo": 1}])[0][1] == "Cuenta 1"
    assert [a[4] for a in accounts_of(spark, '[{"saldo":1.234},{"saldo":"1.234"},{"saldo":true},{"SALDO":"abc"}]')] == [1.234, 1234, 0, 0]


def test_key_order_duplicates_and_numbers(spark):
    """The first array in key order wins, whole-number keys come first, and a repeated key has its last value."""
    assert [a[4] for a in accounts_of(spark, '{"meta":[{"saldo":1}],"data":[{"saldo":2}]}')] == [1]
    assert [a[4] for a in accounts_of(spark, '{"b":[{"saldo":1}],"7":[{"saldo":2}]}')] == [2]
    assert [a[4] for a in accounts_of(spark, '[{"saldo":1,"saldo":3}]')] == [3]
    assert [a[4] for a in accounts_of(spark, '{"a":[],"b":[1,{"x":[{"saldo":5}]}]}')] == [5]
    assert [a[0] for a in accounts_of(spark, '[{"numero":1234567890,"saldo":1},{"numero":1e21,"saldo":1},{"numero":0.00001,"saldo":1},{"numero":1e-7,"saldo":1}]')] == ["1234567890", "1e+21", "0.00001", "1e-7"]


def transactions_of(spark, body, offset=0):
    df = spark.createDataFrame([(json.dumps(body),)], "body string")
    out = records.normalize_transactions(df, F.lit("ahorros-01"), id_offset=F.lit(offset))
    return [(r.id, r.accountId, r.date, r.description, r.amount.amount) for r in out.orderBy("ordinal").collect()]


def test_transactions(spark):
    body = [{"referencia": "A1", "fechaMovimiento": "2026-07-03T10:00:00", "descripcion": "n", "valor": 3500000}, {"referencia": "A2", "fecha": "10/07/2026", "nombre": "m", "valor": "-215.400"}]
    assert transactions_of(spark, body) == [("A1", "ahorros-01", "2026-07-03", "n", 3500000), ("A2", "ahorros-01", "2026-07-10", "m", -215400)]
    assert [t[0] for t in transactions_of(spark, [{"valor": 1}, {"valor": 2}], 2)] == ["tx-3", "tx-4"]
    assert transactions_of(spark, [{"x": 1}, {"valor": None}]) == [("tx-2", "ahorros-01", "1970-01-01", "—", 0)]


def walked(spark, pages, **options):
    rows = [("w", p, i, str(v)) for p, page in enumerate(pages) for i, v in enumerate(page)]
    df = spark.createDataFrame(rows, "w string, page int, pos int, v string")
    taken = paging.walk_pages(paging.page_signatures(df, ["w"], "page", "pos", F.col("v")), ["w"], **options)
    kept = paging.walk_rows(df, taken, ["w"], "page")
    return [r.v for r in kept.orderBy("page", "pos").collect()], {r.truncated for r in taken.collect()}


def by_loop(pages, **options):
    out, capped = [], False
    for page, capped in http.walk(lambda i: pages[i] if i < len(pages) else [], str, **options):
        out += map(str, page)
    return out, {capped} if out else set()


@pytest.mark.parametrize(
    ("pages", "options"),
    [
        ([[1, 2, 3], [4, 5, 6], [7]], {"page_size": 3}), ([], {"page_size": 10}), ([[1, 2]] * 9, {"page_size": 2}), ([["A", "B"], ["C", "D"], []], {"page_size": 2}),
        ([[10 * p, 10 * p + 1] for p in range(9)], {"page_size": 2, "max_pages": 4}), ([[1], [2], []], {}), ([[1], [], [2]], {}), ([[1, 2], [3]], {"page_size": 2, "max_pages": 2}),
        ([[1], [2]], {"page_size": 1, "max_pages": 2}), ([[0], [1], [2]], {"start_page": 1}), ([[1], [2], [1], [3]], {}),
    ],
)
def test_page_walk(spark, pages, options):
    """The windows take the same pages as a loop that fetches one by one."""
    assert walked(spark, pages, **options) == by_loop(pages, **options)


def test_page_slices(spark):
    df = spark.range(10)
    ids = lambda page, size: [r.id for r in paging.page_slice(df, ["id"], page, size).collect()]
    assert ids(1, 4) == [4, 5, 6, 7] and ids(2, 4) == [8, 9] and ids(-3, 4) == [0, 1, 2, 3] and len(ids(0, None)) == len(ids(5, 0)) == len(ids(1, float("inf"))) == 10


def test_synthetic_ids_can_collide(spark):
    """A page with a skipped row and the next share a number."""
    rows = spark.createDataFrame([("w", 0, 0, False), ("w", 0, 1, True), ("w", 1, 0, True)], "w string, page int, pos int, ok boolean")
    out = paging.synthetic_ids(rows, ["w"], "page", "pos", F.col("ok"), F.lit(None).cast("string"))
    assert [r.tx_id for r in out.orderBy("page").collect()] == ["tx-2", "tx-2"]


def money(*rows):
    return [(str(i), "n", t, "****", {"amount": float(a), "currency": c}, None) for i, (t, a, c) in enumerate(rows)]


def test_net_worth(spark):
    total = lambda *rows: {r.currency: r.total for r in summary.net_worth(spark.createDataFrame(money(*rows), ACCOUNT)).collect()}
    assert total(("savings", 4250000, "COP"), ("checking", 1120500, "COP"), ("credit_card", 890000, "COP"), ("loan", 2000000, "COP")) == {"COP": 2480500}
    assert total(("savings", 100, "COP"), ("savings", 50, "USD")) == {"COP": 100, "USD": 50}
    assert total() == {} and total(("credit_card", -5, "COP")) == {"COP": 5}


def test_ranges_compare_text(spark):
    df = spark.createDataFrame([("a", d) for d in ("2026-07-01", "2026-07-31", "2026-07-31T10:00", "2026/07/03", "1970-01-01")], "accountId string, date string")
    assert [r.date for r in summary.in_range(df, "2026-07-01", "2026-07-31", "a").orderBy("date").collect()] == ["2026-07-01", "2026-07-31"]


def test_text_table(spark):
    df = spark.createDataFrame([("1", "\x1b[31mlong name\x1b[0m"), ("22", None)], "a string, b string")
    rows = summary.text_table(df, ["ID", "B"]).collect()
    assert rows[0].header == "ID  B        " and rows[0].rule == "──  ─────────"
    assert sorted(r.line for r in rows) == ["1   \x1b[31mlong name\x1b[0m", "22           "]


def test_balance_lookup_and_ranges(spark):
    df = spark.createDataFrame(money(("savings", 1, "COP"), ("loan", 2, "COP")), ACCOUNT)
    assert service.get_balance(df, "1", "number").first().balance.amount == 2
    with pytest.raises(service.NotFound):
        service.get_balance(df, "9", "number")
    assert service.date_range("2026-99-99", "0000-00-00")
    for bad in ("2026-07-01\n", "2026-7-1"):
        with pytest.raises(ValueError):
            service.date_range(bad, "2026-07-01")


RESPONSES = [
    (1, "https://h.co/app.js", "GET", 200, "text/html", "{}"),
    (2, "https://h.co/api/cuenta/movimientos", "GET", 500, "application/json", "[]"),
    (3, "https://h.co/api/saldos", "POST", 200, "Application/JSON; x", '{"a":[{"x":1},{"x":2},{"x":3},{"x":4}]}'),
    (4, "https://h.co/api/other", "GET", 200, "application/json", '[{"Monto":1}]'),
    (5, "https://h.co/api/nothing", "GET", 200, "application/json", '[{"y":1}]'),
    (6, "https://h.co/api/saldo", "GET", 200, "application/json", "null"),
    (7, "https://else.co/api/saldo", "GET", 200, "application/json", "{}"),
    (8, "https://h.co/api/saldo", "GET", 200, None, "{}"),
]


def test_captures_in_batch_and_stream(spark, tmp_path):
    batch = capture.captures(spark.createDataFrame(RESPONSES, RESPONSE), "https://h.co")
    rows = {r.seq: r for r in batch.collect()}
    assert sorted(rows) == [2, 3, 4] and json.loads(rows[3].sample) == [{"x": 1}, {"x": 2}, {"x": 3}] and rows[2].sample == "[]"
    ends = capture.infer_endpoints(batch).first()
    assert (ends.accounts_url, ends.transactions_url) == ("https://h.co/api/saldos", "https://h.co/api/cuenta/movimientos")
    for k, part in enumerate((RESPONSES[:3], RESPONSES[3:])):
        spark.createDataFrame(part, RESPONSE).write.mode("append").json(f"{tmp_path}/in")
        capture.stream_captures(spark, f"{tmp_path}/in", "https://h.co", f"{tmp_path}/out", f"{tmp_path}/progress").awaitTermination()
    assert sorted(spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(batch.collect())


def test_no_endpoints(spark):
    none = capture.infer_endpoints(spark.createDataFrame([], "seq long, url string"))
    assert none.collect() == [(None, None)]


class Bank(BaseHTTPRequestHandler):
    asked: list[dict] = []

    def do_GET(self):
        query = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
        ok = self.headers.get("Authorization") == "Bearer t"
        self.asked.append(query)
        if "accounts" in self.path:
            body = [{"id": "a", "name": "n", "type": "loan", "number": "1", "balance": {"amount": 5}, "extra": 1}]
        else:
            page, size = int(query.get("page", 0)), int(query.get("pageSize", 2))
            every = [{"id": str(i), "accountId": query.get("accountId"), "date": f"2026-07-{i + 1:02}", "description": "d", "amount": {"amount": i, "currency": "COP"}} for i in range(5)]
            body = [t for t in every if query["from"] <= t["date"] <= query["to"]][page * size : page * size + size]
        data = json.dumps(body).encode() if ok else b"x" * 900
        self.send_response(200 if ok else 401)
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *args):
        pass


@pytest.fixture
def bank():
    server = HTTPServer(("127.0.0.1", 0), Bank)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def test_sources(spark, bank):
    http.register(spark)
    history = spark.read.format("paged_history").option("url", bank).option("token", "t").option("accounts", "a,b").option("page_size", 2).load()
    assert history.count() == 10
    Bank.asked.clear()
    some = history.filter("accountId = 'b' AND date >= '2026-07-02' AND date <= '2026-07-04'").orderBy("id").collect()
    assert [(r.id, r.amount.amount) for r in some] == [("1", 1.0), ("2", 2.0), ("3", 3.0)]
    assert {(q["accountId"], q["from"], q["to"]) for q in Bank.asked} == {("b", "2026-07-02", "2026-07-04")}
    account = spark.read.format("bank_accounts").option("url", bank).option("token", "t").load().first()
    assert account.balance.currency == "COP" and account.available is None
    with pytest.raises(http.HttpError) as e:
        http.get_json(bank + "api/accounts")
    assert e.value.status == 401 and len(str(e.value)) < 560


def test_strict_rows():
    with pytest.raises(http.SchemaError):
        http.typed({"id": "a", "name": "n", "type": "loan", "number": "1", "balance": {"amount": "5"}}, ACCOUNT, ("available",))
    with pytest.raises(http.SchemaError):  # a null isn't an absent field
        http.typed({"id": "a", "name": "n", "type": "loan", "number": "1", "balance": {"amount": 5}, "available": None}, ACCOUNT, ("available",))


def test_files(spark, tmp_path):
    good = spark.createDataFrame(money(("loan", 1, "COP")), ACCOUNT)
    files.write_json(good, f"{tmp_path}/a")
    back = files.read_strict(spark, f"{tmp_path}/a", ACCOUNT)
    assert files.checked_accounts(back).count() == 1
    files.write_json(spark.createDataFrame(money(*[("loan", i, "COP") for i in range(7)]), ACCOUNT).coalesce(1), f"{tmp_path}/lines")
    assert files.read_strict(spark, f"{tmp_path}/lines", ACCOUNT, lines=True).count() == 7
    with pytest.raises(Exception, match="incomplete"):
        files.checked_accounts(spark.createDataFrame(money(("yacht", 1, "COP")), ACCOUNT)).collect()
    assert files.read_json_or_none(spark, f"{tmp_path}/none", ACCOUNT) is None
    (tmp_path / "bad.json").write_text("[{")
    assert files.read_json_or_none(spark, f"{tmp_path}/bad.json", ACCOUNT) is None
    (tmp_path / "typed.json").write_text('[{"id":"a","balance":{"amount":1}},{"id":"b","balance":{"amount":"x"}}]')
    assert files.read_json_or_none(spark, f"{tmp_path}/typed.json", ACCOUNT) is None
    assert files.read_json_or_none(spark, f"{tmp_path}/a", ACCOUNT).count() == 1
    assert '"id"' in files.pretty(good).first().json


def test_replayed_history(spark):
    pages = [(1, json.dumps([{"x": 1}, {"valor": 1, "fecha": "01/07/2026"}])), (2, json.dumps([{"valor": 2, "fecha": "02/07/2026"}])), (3, json.dumps([{"x": 1}])), (4, json.dumps([{"valor": 3}]))]
    out = service.replayed_history(spark.createDataFrame(pages, "page int, body string"), "2026-07-01", "2026-07-31", "acc").orderBy("page").collect()
    assert [(r.id, r.accountId, r.amount.amount, r.truncated) for r in out] == [("tx-2", "acc", 1.0, False), ("tx-2", "acc", 2.0, False)]
    url = service.replay_url("https://x.co/m?cuenta=1&desde=a", "acc", "2026-07-01", "2026-07-31", 2).first().url
    assert url == "https://x.co/m?cuenta=acc&desde=2026-07-01&page=2"


def test_sessions_never_show_tokens(spark):
    rows = spark.createDataFrame([("connect", "somebody", "secret", True, "2026", "2026-07-20T00:00:00Z")], "method string, user string, token string, hasStorageState boolean, createdAt string, expiresAt string")
    out = service.session_info(rows, F.lit("2026-07-25T00:00:00Z").cast("timestamp")).first()
    assert "token" not in out and out.user == "so****dy" and out.expired
