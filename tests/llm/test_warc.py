import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import warc
from ledgerloom.llm.scratch import new_folder

PAGES = [
    (1, "http://B.example.com/x?q=1#f", "<p>é</p>"),
    (2, "http://a.example.com/", "<p>é</p>"),
    (3, "http://a.example.com/", None),
    (4, None, ""),
    (5, "no url\r\nWARC-Type: fake", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n\r\n\r\n"),
    (6, "http://a.example.com/", "long " * 50_000),
    (6, "http://a.example.com/", "long " * 50_000),
    (None, "http://c.example.com/", "<p>é</p>"),
]


def written(spark, rows, min_bytes=0):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("captured_at", F.lit("2024-01-01T00:00:00Z")).withColumn("digest", F.lit(1)).withColumn("size", F.lit(2))
    path = new_folder(spark, "warc-test")
    warc.write_warc(pages, path, min_bytes=min_bytes)
    return path


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark):
    rows = warc.read_warc(spark, written(spark, PAGES)).collect()
    assert len(rows) == len(PAGES)
    got = sorted(((r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in rows), key=str)
    size = lambda t: len((t or "").encode())
    kinds = {1: ("revisit", "2"), 2: ("response", None), 3: ("revisit", "4"), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("response", None)}
    assert got == sorted(((None if i is None else str(i), *kinds[i], size(t), sha(t)) for i, _, t in PAGES), key=str)
    assert {bytes(r.payload).decode() for r in rows if r.payload is not None} == {t or "" for i, _, t in PAGES if kinds[i][0] == "response"}
    assert {r.url for r in rows if r.record_id == "5"} == {"no url%0D%0AWARC-Type: fake"}


def test_small_payloads_are_never_revisits(spark):
    rows = warc.read_warc(spark, written(spark, PAGES, min_bytes=1), payloads=False).collect()
    assert {(r.record_id, r.record_type) for r in rows if r.record_id in ("3", "4")} == {("3", "response"), ("4", "response")}


def test_empty_table(spark):
    path = written(spark, [])
    read = warc.read_warc(spark, path)
    assert read.collect() == []
    captures = read.select("run", "date", F.col("url").alias("url_key"), F.col("record_id").alias("id"))
    assert warc.capture_index(captures).collect() == []


def test_offsets_find_the_record(spark):
    row = warc.read_warc(spark, written(spark, PAGES)).filter("record_id = '5'").first()
    with open(row.file.removeprefix("file:"), "rb") as f:
        f.seek(row.offset)
        (_, _, headers, block), = warc.parse(f.read(row.length))
    assert headers["WARC-Record-ID"] == "<urn:page:5>" and block.endswith(PAGES[4][2].encode())


def test_files_are_cut_by_bytes(spark):
    """Large pages in a row don't make a large file, and small ones share theirs."""
    rows = [(i, f"http://a.example.com/{i}", f"{i} " + "x" * (20_000 if 40 <= i < 60 else 10)) for i in range(100)]
    path = new_folder(spark, "warc-test")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).withColumn("captured_at", F.lit(None).cast("string"))
    warc.write_warc(pages, path, file_bytes=30_000)
    read = warc.read_warc(spark, path, payloads=False)
    sizes = {r.file: (r.n, r.top) for r in read.groupBy("file").agg(F.count("*").alias("n"), F.max(F.col("offset") + F.col("length")).alias("top")).collect()}
    assert read.count() == 100 and max(top for _, top in sizes.values()) < 30_000 + 21_000 and max(n for n, _ in sizes.values()) > 20


def test_damage_is_an_error():
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcd\r\n\r\n"))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted(((rng.randrange(20),), (j, i)) for i in range(rng.randrange(0, 30))) for j in range(k)]
    merged = list(warc.loser_tree(runs))
    assert merged == sorted((x for r in runs for x in r), key=lambda x: (x[0], x[1][0]))


def test_index_is_globally_ordered(spark):
    """One URL has most of the captures, and ranges are far smaller than its share."""
    rng = random.Random(1)
    rows = [(rng.randrange(5), rng.choice(["com,a)/", "com,a)/", "com,a)/", f"com,b)/{i}", None]), rng.choice([None, "2024", "2025"]), i, "extra") for i in range(900)]
    out = warc.capture_index(spark.createDataFrame(rows, "run long, url_key string, date string, id long, place string"), range_rows=50).orderBy("history_rank").collect()
    assert [r.history_rank for r in out] == list(range(900))
    key = lambda r: tuple((x is not None, x or "") for x in (r.url_key, r.date)) + (r.id,)
    assert [key(r) for r in out] == sorted(key(r) for r in out)


def test_repeated_captures_are_split_between_ranges(spark):
    """Rows equal in the whole key are no group that one task must hold."""
    rows = [(k % 3, "com,a)/", "2024", 1) for k in range(600)]
    captures = spark.createDataFrame(rows, "run long, url_key string, date string, id long")
    out = warc.capture_index(captures, range_rows=50)
    assert sorted(r.history_rank for r in out.collect()) == list(range(600))
    assert warc.capture_index(captures.limit(0)).columns == ["run", "url_key", "date", "id", "history_rank"]


def test_url_key(spark):
    keys = [r.k for r in spark.createDataFrame([(r[1],) for r in PAGES[:4]], "url string").select(warc.url_key(F.col("url")).alias("k")).collect()]
    assert keys == ["com,example,b)/x?q=1", "com,example,a)/", "com,example,a)/", ""]
