"""A query for each operator, over whole tables, and its SQL."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerloom.functions import scalars as S
from ledgerloom.functions import urls as U
from ledgerloom.operators import paging, records, summary
from ledgerloom.plans import service
from ledgerloom.schemas import ACCOUNT, AMOUNT_KEYS, MONEY
from ledgerloom.sources import bodies, files, response_log
from ledgerloom.sources.shared import delete_folders, work_folder
from ledgerloom.streaming import capture, session

from .views import account_payloads, account_texts, accounts, replayed_pages, responses, table, transaction_payloads, transactions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# The views of .views in SQL.
_ACCOUNTS = """
SELECT c_custkey AS seq, c_custkey::VARCHAR AS id, c_name AS name,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'credit_card' WHEN 'BUILDING' THEN 'loan' WHEN 'FURNITURE' THEN 'savings' WHEN 'HOUSEHOLD' THEN 'checking' WHEN 'MACHINERY' THEN 'investment' ELSE 'other' END AS type,
       '****' || right(lpad(c_custkey::VARCHAR, 12, '0'), 4) AS number, c_acctbal AS amount, CASE WHEN c_custkey % 2 = 0 THEN 'COP' ELSE 'USD' END AS currency
FROM customer"""
_TRANSACTIONS = """
SELECT o_orderkey AS seq, o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS accountId, strftime(o_orderdate, '%Y-%m-%d') AS date,
       'Order of priority / ' || o_orderpriority || ' / ' || o_orderstatus || ' / from the whole history' AS description,
       CASE WHEN o_orderpriority LIKE '1%' THEN -o_totalprice ELSE o_totalprice END AS amount
FROM orders"""
_URL_FILE = "coalesce(nullif(regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '#.*$', ''), ''), '')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _money_sql(amount: str, currency: str) -> str:
    """Display of an amount: rounded half away from zero, by hand."""
    cents = f"(CASE WHEN {currency} = 'COP' THEN round(abs({amount}), 0) * 100 ELSE round(round(abs({amount}), 2) * 100, 0) END)::BIGINT"
    whole = f"regexp_replace(reverse(regexp_replace(reverse(({cents} // 100)::VARCHAR), '([0-9]{{3}})', '\\1.', 'g')), '^[.]', '')"
    return f"CASE WHEN {amount} < 0 THEN '-' ELSE '' END || CASE WHEN {currency} = 'COP' THEN '$ ' ELSE {currency} || ' ' END || {whole} || CASE WHEN {currency} = 'COP' THEN '' ELSE ',' || lpad(({cents} % 100)::VARCHAR, 2, '0') END"


@query(f"SELECT currency, round(sum(CASE WHEN type IN ('credit_card', 'loan') THEN -amount ELSE amount END), 2) AS total FROM ({_ACCOUNTS}) GROUP BY currency")
def net_worth_by_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.net_worth(accounts(spark, sf_dir)).select("currency", F.round("total", 2).alias("total"))


@query(f"""SELECT (SELECT count(*) FROM customer)::BIGINT AS n_accounts,
  round(sum(CASE WHEN type IN ('credit_card', 'loan') THEN -amount ELSE amount END) FILTER (currency = 'COP'), 2) AS cop,
  round(sum(CASE WHEN type IN ('credit_card', 'loan') THEN -amount ELSE amount END) FILTER (currency = 'USD'), 2) AS usd FROM ({_ACCOUNTS})""")
def financial_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = accounts(spark, sf_dir)
    both = own.agg(F.count("*").alias("n_accounts")).crossJoin(summary.totals_map(own))  # one row each
    return both.select("n_accounts", *(F.round(F.col("totals")[c], 2).alias(c.lower()) for c in ("COP", "USD")))


@query(f"SELECT id, name, type, number, amount, currency FROM ({_ACCOUNTS})")
def account_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts(spark, sf_dir).select("id", "name", "type", "number", "balance.amount", "balance.currency")


@query(ORACLE_SQL["account_scan"])
def account_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts written as JSON files and read back with exactly their types, each checked."""
    path = work_folder(spark, "accounts")
    files.write_json(accounts(spark, sf_dir).withColumn("available", F.lit(None).cast(MONEY)), path)
    found = files.checked_accounts(files.read_strict(spark, path, ACCOUNT, lines=True))
    return found.select("id", "name", "type", "number", "balance.amount", "balance.currency")


@query(f"SELECT id, json_object('id', id, 'name', name, 'type', type, 'number', number)::VARCHAR AS json FROM ({_ACCOUNTS})")
def account_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each account as the JSON of a response, without its balance."""
    return accounts(spark, sf_dir).select("id", F.to_json(F.struct("id", "name", "type", "number")).alias("json"))


@query(f"SELECT id, name, amount, currency FROM ({_ACCOUNTS}) WHERE id = '42' ORDER BY seq LIMIT 1")
def account_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.first_match(accounts(spark, sf_dir), F.col("id") == "42", "seq", ["id", "name", "balance.amount", "balance.currency"])


@query(f"SELECT id, accountId, date, amount FROM ({_TRANSACTIONS}) WHERE date >= '1995-01-01' AND date <= '1995-12-31'")
def tx_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.in_range(transactions(spark, sf_dir), "1995-01-01", "1995-12-31").select("id", "accountId", "date", "amount.amount")


@query(f"SELECT id, accountId, date, amount, amount > 0 AS credit FROM ({_TRANSACTIONS}) WHERE accountId = '7' AND date >= '0000-00-00' AND date <= '9999-99-99'")
def tx_account_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summary.in_range(transactions(spark, sf_dir), account_id="7")
    return found.select("id", "accountId", "date", "amount.amount", S.is_credit(F.col("amount.amount")).alias("credit"))


@query(f"SELECT id, date FROM (SELECT *, row_number() OVER (ORDER BY date, seq) AS rn FROM ({_TRANSACTIONS})) WHERE rn > 300 AND rn <= 400")
def tx_page_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.page_slice(transactions(spark, sf_dir), ["date", "seq"], 3, 100, few=1000).select("id", "date")


@query(f"SELECT id, date FROM (SELECT *, row_number() OVER (ORDER BY date, seq) AS rn FROM ({_TRANSACTIONS})) WHERE rn > 1200 AND rn <= 1300")
def tx_deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later page, whose rows are found by counts."""
    return paging.page_slice(transactions(spark, sf_dir), ["date", "seq"], 12, 100, few=400).select("id", "date")


@query(f"SELECT date, left(description, 40) AS description, {_money_sql('amount', chr(39) + 'COP' + chr(39))} AS amount FROM ({_TRANSACTIONS})")
def tx_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.transaction_display(transactions(spark, sf_dir))


@query(f"SELECT id, name, type, number, {_money_sql('amount', 'currency')} AS balance FROM ({_ACCOUNTS})")
def account_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.account_display(accounts(spark, sf_dir))


@query(f"SELECT rpad(number, greatest(10, length(number))::INT, ' ') AS number, rpad(name, greatest(24, length(name))::INT, ' ') AS name, {_money_sql('amount', 'currency')} AS balance FROM ({_ACCOUNTS})")
def balance_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.balance_display(accounts(spark, sf_dir))


@query("""WITH r AS (SELECT r_regionkey::VARCHAR AS k, r_name AS n FROM region), w AS (SELECT greatest(2, max(length(k)))::INT AS a, greatest(4, max(length(n)))::INT AS b FROM r)
SELECT rpad('ID', a, ' ') || '  ' || rpad('NAME', b, ' ') AS header, repeat('─', a) || '  ' || repeat('─', b) AS rule, rpad(k, a, ' ') || '  ' || rpad(n, b, ' ') AS line FROM r, w""")
def text_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.text_table(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), ["ID", "NAME"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN -c::DOUBLE ELSE CASE WHEN o_orderkey % 3 = 0 THEN c::DOUBLE ELSE c / 100.0 END END AS amount
FROM (SELECT o_orderkey, round(o_totalprice * 100, 0)::BIGINT AS c FROM orders)""")
def parse_cop_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals in cents written in three ways: points for thousands, with a decimal comma, negative with a sign and a currency."""
    cents = F.round(F.col("o_totalprice") * 100, 0).cast("long")
    grouped = lambda x: F.replace(F.format_number(x, 0), F.lit(","), F.lit("."))
    key = F.col("o_orderkey") % 3
    whole, rest = F.expr("cents div 100"), F.lpad((F.col("cents") % 100).cast("string"), 2, "0")
    text = F.when(key == 0, F.concat(F.lit("$ "), grouped(F.col("cents")))).when(key == 1, F.concat(grouped(whole), F.lit(","), rest)).otherwise(F.concat(F.lit(" -"), grouped(F.col("cents")), F.lit(" COP")))
    return table(spark, sf_dir, "orders").select("o_orderkey", cents.alias("cents")).select("o_orderkey", S.to_number(text).alias("amount"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN o_orderkey % 5 = 3 THEN '1970-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date,
       o_orderkey % 5 NOT IN (3, 4) AND o_orderkey % 5 = 0 AS is_date FROM orders""")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    key = F.col("o_orderkey") % 5
    text = (
        F.when(key == 0, F.date_format(day, "yyyy-MM-dd")).when(key == 1, F.date_format(day, "d/M/yyyy HH:mm")).when(key == 2, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(key == 3, F.lit(" ")).otherwise(F.date_format(day, "yyyy/MM/dd"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", S.to_iso_date(text).alias("date"), S.is_date_text(text).alias("is_date"))


@query("SELECT doc_id, md5(strip_accents(lower(text))) AS folded FROM documents")
def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(S.fold_text(F.col("text"))).alias("folded"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'credit_card' WHEN 1 THEN 'loan' WHEN 2 THEN 'savings' WHEN 3 THEN 'checking' WHEN 4 THEN 'investment' ELSE 'other' END AS type FROM part""")
def guess_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey") % 6
    names = ("Tarjeta de Crédito ", "PRÉSTAMO de Libre Inversión ", "Ahorros a la Mano ", "Cuenta Corriente ", "Inversión ", "Algo Raro ")
    name = F.coalesce(*(F.when(key == i, F.concat(F.lit(n), F.col("p_partkey").cast("string"))) for i, n in enumerate(names)))
    return table(spark, sf_dir, "part").select("p_partkey", S.guess_type(name).alias("type"))


@query("SELECT c_custkey, '****' || right(c_custkey::VARCHAR, 4) AS number FROM customer")
def mask_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", S.mask_number(F.col("c_custkey").cast("string")).alias("number"))


@query("SELECT c_custkey, CASE WHEN length(u) <= 4 THEN repeat('*', length(u)) ELSE left(u, 2) || repeat('*', length(u) - 4) || right(u, 2) END AS user_name FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_custkey::VARCHAR END AS u FROM customer)")
def mask_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", S.mask_user(name).alias("user_name"))


@query("SELECT event_id, event_id % 9 <> 0 AND event_id % 9 <> 1 AND date_trunc('second', ts) <= TIMESTAMP '2024-01-15 00:00:00' AS expired FROM events")
def expiry_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id") % 9
    text = F.when(key == 0, "not-a-date").when(key == 1, F.lit(None)).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, sf_dir, "events").select("event_id", S.is_expired(text, F.lit("2024-01-15T00:00:00Z").cast("timestamp")).alias("expired"))


@query(f"SELECT page_id, contains(lower({_URL_FILE}), 'page') OR contains(lower({_URL_FILE}), 'fr/') AS hit FROM pages")
def url_hint_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.url_matches(F.col("url"), ("page", "fr/")).alias("hit"))


@query(f"SELECT page_id, {_URL_FILE} AS path_query, starts_with(url, 'http://th') AS same FROM pages")
def url_path_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.path_query(F.col("url")).alias("path_query"), U.same_origin(F.col("url"), "http://th").alias("same"))


@query("SELECT page_id, page_id % 10 = 0 OR page_id % 3 = 0 AS rejected FROM pages")
def auth_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third URL is sent to a login page, others to one that only looks so."""
    key = F.col("page_id")
    host = F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0)
    url = F.concat(host, F.when(key % 3 == 0, "/a/LOGIN/").when(key % 3 == 1, "/login-info").otherwise("/x?redirect=/login"))
    return table(spark, sf_dir, "pages").select("page_id", U.is_auth_rejection(F.when(key % 10 == 0, 403).otherwise(200), url).alias("rejected"))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS base, regexp_extract(url, '[?]([^#]*)', 1) AS q, regexp_extract(url, '(#.*)$', 1) AS f FROM pages)
SELECT page_id, base || '?' || CASE WHEN q = '' THEN 'page=3' WHEN regexp_matches(q, '(^|&)page=') THEN regexp_replace(q, '(^|&)page=[^&]*', '\\1page=3') ELSE q || '&page=3' END || f AS url FROM p""")
def url_set_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.with_query_param(F.col("url"), "page", "3").alias("url"))


@query("SELECT page_id, 'https://h.co/' || page_id || '?numeroCuenta=A+1&x=keep&fechaInicial=2026-08-01&fechaFin=2026-08-31&TO=2026-08-31' AS url FROM pages")
def url_rescope(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://h.co/"), F.col("page_id").cast("string"), F.lit("?numeroCuenta=OLD&x=keep&fechaInicial=a&fechaFin="), F.col("page_id").cast("string"), F.lit("&TO=&numeroCuenta=2"))
    return table(spark, sf_dir, "pages").select("page_id", U.rescope(url, "A 1", "2026-08-01", "2026-08-31").alias("url"))


_RESPONSES = """
SELECT event_id AS seq, CASE WHEN event_id % 4 = 0 THEN 'https://transaccion.example.org' ELSE 'https://portal.example.com' END AS host,
       CASE event_id % 5 WHEN 0 THEN '/api/cuentas?x=' WHEN 1 THEN '/api/movimientos?x=' ELSE '/api/data?x=' END || event_id AS path, *
FROM events"""
_CAPTURED = f"SELECT * FROM ({_RESPONSES}) WHERE event_id % 4 <> 0 AND event_id % 7 > 1 AND event_id % 11 <> 0 AND (event_id % 5 < 2 OR event_id % 3 = 0)"


@query(f"SELECT seq, host || path AS url, CASE WHEN seq % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, 200 AS status, CASE WHEN seq % 3 = 0 THEN '[{{\"Valor\":' || user_id || '}},{{}},{{}}]' ELSE '{{\"props\":' || replace(props, ' ', '') || '}}' END AS sample FROM ({_CAPTURED})")
def capture_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.captures(responses(spark, sf_dir), "https://portal.example.com")


@query(f"SELECT (SELECT arg_min(host || path, seq) FROM ({_CAPTURED}) WHERE contains(path, 'cuenta')) AS accounts_url, (SELECT arg_min(host || path, seq) FROM ({_CAPTURED}) WHERE contains(path, 'movim')) AS transactions_url")
def infer_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.infer_endpoints(capture.captures(responses(spark, sf_dir), "https://portal.example.com"))


@query("SELECT conv_id, turn, left(text, 160) || CASE WHEN length(text) >= 160 THEN '…' ELSE '' END AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS rn FROM conversations) WHERE rn <= 3")
def capture_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three turns of each conversation, as previews; Spark keeps three rows a conversation before it shuffles."""
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "text"))
    first = table(spark, sf_dir, "conversations").withColumn("place", place).filter("place <= 3")
    return first.select("conv_id", "turn", S.preview(F.col("text")).alias("text"))


_PAGES = "SELECT l_orderkey, l_linenumber - 1 AS page, count(*) AS n, string_agg(strftime(l_shipdate, '%Y') || '|' || (l_quantity::BIGINT % 3) || '|' || l_returnflag, chr(1) ORDER BY l_partkey, l_suppkey) AS sig FROM lineitem GROUP BY ALL"


def _line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as the pages of a walk; a signature is a year, a quantity modulo 3 and a flag."""
    rows = table(spark, sf_dir, "lineitem").withColumn("page", F.col("l_linenumber") - 1).withColumn("pos", F.struct("l_partkey", "l_suppkey"))
    text = paging.signature_text(F.date_format("l_shipdate", "yyyy"), S.number_text(F.col("l_quantity") % 3), F.col("l_returnflag"))
    return paging.page_signatures(rows, ["l_orderkey"], "page", "pos", text)


@query(f"SELECT l_orderkey, page, n, md5(sig) AS sig FROM ({_PAGES})")
def page_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_pages(spark, sf_dir).select("l_orderkey", "page", "n", F.md5("sig").alias("sig"))


@query(f"SELECT l_orderkey, page, row_number() OVER (PARTITION BY l_orderkey, sig ORDER BY page) > 1 AS repeated FROM ({_PAGES})")
def page_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.repeated_pages(_line_pages(spark, sf_dir), ["l_orderkey"]).select("l_orderkey", "page", "repeated")


@query(f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, sig ORDER BY page) > 1 AS rep, page <> row_number() OVER (PARTITION BY l_orderkey ORDER BY page) - 1 AS gap FROM ({_PAGES}) WHERE page < 5),
k AS (SELECT * FROM p q WHERE NOT EXISTS (SELECT 1 FROM p r WHERE r.l_orderkey = q.l_orderkey AND (r.page <= q.page AND (r.rep OR r.gap) OR r.page < q.page AND r.n < 1)))
SELECT l_orderkey, page, n, count(*) OVER (PARTITION BY l_orderkey) = 5 AS truncated FROM k""")
def page_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.walk_pages(_line_pages(spark, sf_dir), ["l_orderkey"], page_size=1, max_pages=5)


@query(f"SELECT count(DISTINCT l_orderkey) AS walks, count(DISTINCT l_orderkey) FILTER (truncated) AS truncated_walks, count(*) AS pages FROM ({ORACLE_SQL['page_walk']})")
def truncated_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the caller of a walk learns of those that ended at their cap, from the metrics of the action that ran it."""
    watch = paging.TruncationWatch()
    watch.pages(page_walk(spark, sf_dir)).write.format("noop").mode("overwrite").save()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", paging.TruncationWarning)
        seen = watch.report()
    return spark.createDataFrame([(seen["walks"], seen["truncated_walks"], seen["pages"])], "walks long, truncated_walks long, pages long")


@query("""WITH r AS (SELECT user_id, event_id, event_id // 40 AS page, event_id % 40 AS pos, event_id % 3 <> 0 AS kept, CASE WHEN event_id % 5 = 0 THEN event_id::VARCHAR END AS own FROM events),
c AS (SELECT user_id, page, sum(kept::INT) AS n FROM r GROUP BY ALL), o AS (SELECT user_id, page, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM c)
SELECT event_id, coalesce(own, 'tx-' || (before + pos + 1)) AS tx_id FROM r JOIN o USING (user_id, page) WHERE kept""")
def synthetic_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr("event_id div 40").alias("page"), (key % 40).alias("pos"))
    out = paging.synthetic_ids(rows, ["user_id"], "page", "pos", key % 3 != 0, F.when(key % 5 == 0, key.cast("string")))
    return out.select("event_id", "tx_id")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') END AS val, event_id % 2 = 0 AS found FROM events")
def json_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key of events' properties in another case, beside a null that mustn't win."""
    key = F.when(F.col("event_id") % 2 == 0, "Amount").otherwise("other")
    body = F.concat(F.lit('[{"importe":null,"'), key, F.lit('":'), F.get_json_object("props", "$.k"), F.lit("}]"))
    rows = records.explode_records(table(spark, sf_dir, "events").select("event_id", body.alias("body")), "body")
    entry = records.pick(F.col("record"), AMOUNT_KEYS)
    return rows.select("event_id", entry["val"].alias("val"), entry["val"].isNotNull().alias("found"))


@query(ORACLE_SQL["json_pick"])
def shredded_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pick of json_pick from stored variants, of which the scan reads the fields asked for and no others."""
    key = F.when(F.col("event_id") % 2 == 0, "Amount").otherwise("other")
    body = F.concat(F.lit('{"props":'), F.col("props"), F.lit(',"'), key, F.lit('":'), F.get_json_object("props", "$.k"), F.lit("}"))
    path = work_folder(spark, "bodies")
    bodies.store_bodies(table(spark, sf_dir, "events").select("event_id", body.alias("body")), path)
    rows = bodies.read_bodies(spark, path)
    found = bodies.spellings(rows, AMOUNT_KEYS)
    has, value = bodies.pick_field([f for k in AMOUNT_KEYS for f in found[k]])
    return rows.select("event_id", value.alias("val"), has.alias("found"))


@query("""SELECT c_nationkey, '90' || c_custkey AS id, 'Cuenta de ahorros ' || c_name AS name, 'savings' AS type, '****' || right('90' || c_custkey, 4) AS number, round(c_acctbal, 2) AS amount, 'COP' AS currency
FROM customer WHERE c_custkey % 7 <> 0""")
def normalize_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.normalize_accounts(account_payloads(spark, sf_dir), keep=["c_nationkey"])
    return rows.select("c_nationkey", "id", "name", "type", "number", F.round("balance.amount", 2).alias("amount"), "balance.currency")


@query("""SELECT o_custkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey::VARCHAR ELSE 'tx-' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS id, strftime(o_orderdate, '%Y-%m-%d') AS date,
       CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '—' END AS description, round(o_totalprice, 0) AS amount FROM orders QUALIFY o_orderkey % 5 <> 0""")
def normalize_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.normalize_transactions(transaction_payloads(spark, sf_dir), F.col("o_custkey").cast("string"), keep=["o_custkey"], id_offset=F.col("id_offset"))
    return rows.select("o_custkey", "id", "date", "description", "amount.amount")


ORIGIN = "https://portal.example.com"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream over JSON files of responses has put in its sink; its input and progress are deleted."""
    arrived, progress, out = (work_folder(spark, f"stream-{x}") for x in ("in", "progress", "out"))
    responses(spark, sf_dir).write.json(arrived)
    capture.stream_captures(spark, arrived, ORIGIN, out, progress).awaitTermination()
    delete_folders(spark, arrived, progress)
    return spark.read.parquet(out)


@query(ORACLE_SQL["capture_filter"])
def stream_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capture filter as a stream; rows equal those of capture_filter."""
    return _stream(spark, sf_dir)


@query(ORACLE_SQL["infer_endpoints"])
def stream_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints inferred from the sink of a stream."""
    return capture.infer_endpoints(_stream(spark, sf_dir))


def _restarted(spark: SparkSession, sf_dir: str, sink: Callable[..., session.DataStreamWriter]) -> str:
    """The folder that a stream over a log of responses filled, which ended after the first segment and was begun again after two more."""
    log, progress, out = (work_folder(spark, f"log-{x}") for x in ("segments", "progress", "out"))
    every = responses(spark, sf_dir)
    for part in ((0,), (1, 2)):
        for k in part:
            response_log.push(every.filter(F.col("seq") % 3 == k), log)
        sink(response_log.read_stream(spark, log), ORIGIN, out, progress).trigger(availableNow=True).start().awaitTermination()
    delete_folders(spark, log, progress)
    return out


@query(ORACLE_SQL["capture_filter"])
def log_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of a log of responses, accumulated batch by batch over a restart."""
    return session.read_batches(spark, _restarted(spark, sf_dir, session.accumulate)).drop("batch")


@query(ORACLE_SQL["infer_endpoints"])
def running_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints as a running aggregate, after the last batch."""
    return session.latest_endpoints(spark, _restarted(spark, sf_dir, session.running_endpoints))


@query(ORACLE_SQL["capture_filter"])
def handed_off_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of a session during which responses arrive, until it is handed off."""
    log, progress, out = (work_folder(spark, f"session-{x}") for x in ("segments", "progress", "out"))
    every = responses(spark, sf_dir)
    response_log.push(every.filter(F.col("seq") % 2 == 0), log)
    with session.CaptureSession(spark, [session.accumulate(response_log.read_stream(spark, log), ORIGIN, out, progress)]) as running:
        response_log.push(every.filter(F.col("seq") % 2 == 1), log)
        running.hand_off()
    delete_folders(spark, log, progress)
    return session.read_batches(spark, out).drop("batch")


@query("""SELECT seq, problem, CASE WHEN problem IS NULL THEN seq::VARCHAR END AS id, CASE WHEN problem IS NULL THEN user_id::DOUBLE END AS amount FROM (
  SELECT event_id AS seq, user_id, CASE WHEN event_id % 13 = 0 OR event_id % 17 = 0 THEN 'rejected' WHEN event_id % 19 = 0 THEN 'failed' WHEN event_id % 11 = 0 THEN 'not_json' WHEN event_id % 3 <> 0 THEN 'no_records' END AS problem FROM events)""")
def browser_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts in stored responses, a problem for each response without any."""
    key = F.col("seq")
    account = F.concat(F.lit('{"data":[{"numero":"'), key.cast("string"), F.lit('","Saldo":'), F.col("user_id").cast("string"), F.lit("}]}"))
    stored = table(spark, sf_dir, "events").withColumnRenamed("event_id", "seq").select(
        "seq", F.when(key % 17 == 0, "https://h.co/login").otherwise("https://h.co/api").alias("url"), F.when(key % 13 == 0, 401).when(key % 19 == 0, 500).otherwise(200).alias("status"),
        F.when(key % 11 == 0, "no json").when(key % 3 == 0, account).otherwise(F.concat(F.lit('{"props":'), F.col("props"), F.lit("}"))).alias("body"),
    )
    return records.scan_accounts(stored).select("seq", "problem", "id", "balance.amount")


@query("""SELECT c_nationkey, c_custkey, e.key AS key, e.kind AS kind, e.val AS val FROM (SELECT c_nationkey, c_custkey, unnest([
  {'key': 'orden', 'kind': 'number', 'val': c_custkey::VARCHAR}, {'key': 'numeroProducto', 'kind': 'string', 'val': '90' || c_custkey}, {'key': 'Nombre', 'kind': 'string', 'val': 'Cuenta de ahorros ' || c_name},
  {'key': 'saldoDisponible', 'kind': CASE WHEN c_custkey % 7 = 0 THEN 'null' ELSE 'string' END, 'val': NULL}]) AS e FROM customer)""")
def json_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the records of nested payloads, by the table function in SQL; a balance's text is left out."""
    records.register(spark)
    sql = """SELECT c_nationkey, CAST(r.record[0].val AS BIGINT) AS c_custkey, e.key, e.kind, CASE WHEN e.key <> 'saldoDisponible' THEN e.val END AS val
             FROM {payloads} AS p, LATERAL json_records(p.body) AS r, LATERAL explode(r.record) AS x(e)"""
    return spark.sql(sql, payloads=account_payloads(spark, sf_dir))


@query("""WITH r AS (SELECT o_custkey, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rn, o_orderdate, o_orderpriority, o_totalprice FROM orders),
p AS (SELECT o_custkey, rn // 4 AS page, count(*) FILTER (k % 5 <> 0) AS n FROM r GROUP BY ALL),
w AS (SELECT o_custkey, page, coalesce(sum(n) OVER (PARTITION BY o_custkey ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, min(n) OVER (PARTITION BY o_custkey ORDER BY page) AS least FROM p)
SELECT o_custkey::VARCHAR AS account, page + 1 AS page, CASE WHEN k % 3 <> 0 THEN k::VARCHAR ELSE 'tx-' || (before + rn % 4 + 1) END AS id, strftime(o_orderdate, '%Y-%m-%d') AS date,
       CASE WHEN k % 2 = 0 THEN o_orderpriority ELSE '—' END AS description, round(o_totalprice, 0) AS amount, false AS truncated
FROM (SELECT *, rn // 4 AS page FROM r) JOIN w USING (o_custkey, page) WHERE least > 0 AND k % 5 <> 0 AND strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1994-01-01' AND '1996-12-31'""")
def replayed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replayed pages of every account: normalised, walked, numbered on and cut to a range."""
    found = service.replayed_history(replayed_pages(spark, sf_dir), "1994-01-01", "1996-12-31")
    return found.select(F.col("accountId").alias("account"), F.col("page").cast("long").alias("page"), "id", "date", "description", "amount.amount", "truncated")


@query("""SELECT c_custkey, CASE WHEN k IS NULL THEN c_custkey::VARCHAR END AS id, CASE WHEN k IS NULL THEN c_name END AS name, CASE WHEN k IS NULL THEN 'loan' END AS type, CASE WHEN k IS NULL THEN '****1' END AS number,
       CASE WHEN k IS NULL THEN c_custkey::DOUBLE END AS amount, CASE WHEN k IS NULL THEN CASE WHEN c_custkey % 9 = 1 THEN 'COP' ELSE 'USD' END END AS currency,
       CASE WHEN c_custkey % 9 = 5 THEN 5.0::DOUBLE END AS available, CASE WHEN c_custkey % 9 = 5 THEN 'COP' END AS available_currency, k AS problem
FROM (SELECT *, CASE c_custkey % 9 WHEN 0 THEN 'type' WHEN 2 THEN 'balance.currency' WHEN 3 THEN 'balance.amount' WHEN 4 THEN 'name' WHEN 6 THEN 'available' WHEN 8 THEN 'number' END AS k FROM customer)""")
def schema_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared fields of accounts in JSON: defaults, unknown keys and what makes a row fail."""
    a = account_texts(spark, sf_dir).select("c_custkey", records.project_account(F.col("body")).alias("a"))
    return a.select(
        "c_custkey", "a.id", "a.name", "a.type", "a.number", "a.balance.amount", "a.balance.currency",
        F.col("a.available.amount").alias("available"), F.col("a.available.currency").alias("available_currency"), "a.problem",
    )


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'browser' ELSE 'connect' END AS method, CASE WHEN length(c_name) <= 4 THEN repeat('*', length(c_name)) ELSE left(c_name, 2) || repeat('*', length(c_name) - 4) || right(c_name, 2) END AS user_name,
       c_custkey % 4 = 0 AS has_state, '2026-01-01T00:00:00Z' AS created_at, CASE WHEN c_custkey % 3 = 1 THEN '2026-01-02T00:00:00Z' WHEN c_custkey % 3 = 2 THEN '2026-12-31T00:00:00Z' END AS expires_at, c_custkey % 3 = 1 AS expired FROM customer""")
def session_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be shown of sessions; a missing end is null."""
    key = F.col("c_custkey")
    sessions = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(key % 2 == 0, "browser").otherwise("connect").alias("method"), F.col("c_name").alias("user"), (key % 4 == 0).alias("hasStorageState"), F.lit("secret").alias("token"),
        F.lit("2026-01-01T00:00:00Z").alias("createdAt"), F.when(key % 3 == 1, "2026-01-02T00:00:00Z").when(key % 3 == 2, "2026-12-31T00:00:00Z").alias("expiresAt"),
    )
    shown = service.session_info(sessions, F.lit("2026-06-01T00:00:00Z").cast("timestamp"), keep=["c_custkey"])
    return shown.toDF("c_custkey", "method", "user_name", "has_state", "created_at", "expires_at", "expired")


@query("""SELECT p_partkey, '/api/accounts/' || replace(replace(replace(replace(replace(url_encode(t), '%21', '!'), '%2A', '*'), '%27', chr(39)), '%28', '('), '%29', ')') || '/balance' AS path,
       'accountId=' || replace(replace(replace(url_encode(t), '%20', '+'), '~', '%7E'), '%2A', '*') || '&page=0' AS query
FROM (SELECT p_partkey, p_name || ' ~é/(1)!*' || chr(39) || '&=+%' AS t FROM part)""")
def encode_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id as a segment of a path, and as a form parameter beside one that is null."""
    text = F.concat("p_name", F.lit(" ~é/(1)!*'&=+%"))
    pairs = {"accountId": text, "from": F.lit(None).cast("string"), "page": F.lit("0")}
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/api/accounts/"), U.component(text), F.lit("/balance")).alias("path"), U.query_text(pairs).alias("query"))


@query("SELECT event_id, event_id % 4 = 0 AS allowed FROM events")
def bearer_auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    header = F.when(key % 4 == 0, F.concat(F.lit("Bearer "), key.cast("string"))).when(key % 4 == 1, "bearer x").when(key % 4 == 2, "Basic Bearer ")
    return table(spark, sf_dir, "events").select("event_id", U.has_bearer(header).alias("allowed"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((date_part('milliseconds', ts)::BIGINT % 1000)::VARCHAR, 3, '0') || 'Z' AS at FROM events")
def iso_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", S.iso_instant(F.col("ts")).alias("at"))


@query(f"SELECT id, date FROM (SELECT *, row_number() OVER (ORDER BY date, seq) AS rn FROM ({_TRANSACTIONS}) WHERE (date, seq) > ('1995-03-01', 1000)) WHERE rn <= 100")
def tx_next_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.next_slice(transactions(spark, sf_dir), ["date", "seq"], ["1995-03-01", 1000], 100).select("id", "date")
