"""WARC archives: writing, reading back, and a merged index of captures.

Records of equal payloads are stored once: the one with the largest id is the
response, the others are revisits that refer to it.  Each archive gives a run
of captures, which is sorted and stored where it was read; runs are split at
common boundaries and each range's runs go through a k-way loser-tree merge by
URL key and timestamp, so that the ranges in order are the globally ordered
capture histories.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .scratch import small, small_batches, stored

CRLF = "\r\n"
HTTP_HEAD = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
#: Bytes of an archive file, about; one record at least.
FILE_BYTES = 16 << 20
#: Captures of a range of the index, and of a run that are decoded at a time.
RANGE_ROWS, CURSOR_ROWS = 50_000, 1000
_URN = "urn:page:"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8 bytes, without padding: 160 bits are 4 times 8 letters."""
    digest = F.sha1(data)
    digits = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: Column) -> Column:
    """Sort key of a URL: the lower-cased host from the top domain down, then path and query in lower case; what has no host is its own key, a null is empty."""
    low = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(low, "^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    rest = F.regexp_replace(low, "^[a-z][a-z0-9+.-]*://[^/?#]*|#.*$", "")
    return F.when(host == "", low).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, date_col: str, min_bytes: int) -> DataFrame:
    """``record``: the text of each row's record, without the two line ends that close it."""
    payload = F.coalesce(payload_col, F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("id"), F.coalesce(url_col, F.lit("")).alias("url"), F.col(date_col).alias("date"),
        payload.alias("payload"), base32_sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("n_bytes"),
    )
    groups = rows.filter((F.col("n_bytes") >= min_bytes) & F.col("id").isNotNull()).groupBy("digest").agg(F.max("id").alias("kept_id"), F.count("*").alias("n")).filter("n > 1")
    groups = stored(groups.select(F.col("digest").alias("same"), "kept_id"), "warc-equal")
    joined = rows.join(small(groups), (F.col("digest") == F.col("same")) & (F.col("n_bytes") >= min_bytes), "left")
    revisit = F.coalesce(F.col("id") < F.col("kept_id"), F.lit(False))
    block = F.concat(F.lit(HTTP_HEAD), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    urn = lambda value: F.concat(F.lit(f"<{_URN}"), value.cast("string"), F.lit(">"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        optional("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        optional("WARC-Date", F.col("date")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("n_bytes").cast("string")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}"), line("WARC-Refers-To", urn(F.col("kept_id"))))).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http;msgtype=response{CRLF}"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
    )
    return joined.select(F.concat(head, block).alias("record"))


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    date_col: str = "captured_at",
    min_bytes: int = 0,
    file_bytes: int = FILE_BYTES,
) -> None:
    """Write each row of ``pages`` as a record into archive files at ``path``.

    Of rows with equal payloads of ``min_bytes`` bytes or more the one with
    the largest id is a response, and the others are revisits that refer to
    it; rows without an id are always responses.  A null payload is empty, a
    null URL empty, a null date left out.  Rows with one id and payload are
    alike, so both are responses if that id is the largest.  A file ends with
    the record that takes it to ``file_bytes``, however sizes are spread.  Any
    Hadoop path will do; an empty table makes an archive without records.
    """

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = number = 0
        for batch in batches:
            numbers = []
            for size in pc.binary_length(batch.column(0)).to_pylist():
                numbers.append(number)
                held += size + 2 * len(CRLF)
                if held >= file_bytes:
                    held, number = 0, number + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int32())], names=["record", "file_no"])

    small_batches(pages.sparkSession)
    made = records(pages, id_col, url_col, payload_col, date_col, min_bytes).mapInArrow(numbered, "record string, file_no int")
    made.write.option("lineSep", CRLF * 2).mode("overwrite").partitionBy("file_no").text(path)


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of each record of an archive file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8").split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines)
        begin = end + 4
        stop = begin + int(headers["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} isn't closed")
        yield at, stop + 4 - at, headers, data[begin:stop]
        at = stop + 4


RECORD_SCHEMA = T.StructType(
    [
        T.StructField("run", T.LongType()),
        T.StructField("file", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def _id(value: str | None) -> str | None:
    return value[len(_URN) + 1 : -1] if value else None


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archive files at ``path``, in RECORD_SCHEMA.

    Digest and size are of the full payload.  For responses they are computed
    from the bytes read and compared with the headers; a difference is an
    error.  Revisits have those of what they refer to, from their headers, and
    a null ``payload``, as all rows have without ``payloads``.  ``run``
    numbers the file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                number = int.from_bytes(hashlib.blake2b(file.encode(), digest_size=8).digest(), "big", signed=True)
                for offset, length, h, block in parse(content.as_py()):
                    payload = block[block.index(b"\r\n\r\n") + 4 :] if h["WARC-Type"] == "response" else None
                    digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
                    if payload is not None and (digest, size) != (base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)):
                        raise ValueError(f"{file}: the payload at byte {offset} isn't the one that was written")
                    rows.append((number, file, offset, length, h["WARC-Type"], _id(h.get("WARC-Record-ID")), _id(h.get("WARC-Refers-To")), h["WARC-Target-URI"], h.get("WARC-Date"), digest, size, payload if payloads else None))
                for start in range(0, len(rows), 2000):
                    columns = zip(*rows[start : start + 2000])
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=RECORD_SCHEMA.names)

    kinds = [{T.LongType: pa.int64(), T.StringType: pa.string(), T.BinaryType: pa.binary()}[type(f.dataType)] for f in RECORD_SCHEMA]
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORD_SCHEMA)


def loser_tree(runs: Iterable[Iterable[tuple]]) -> Iterator[tuple]:
    """Merge runs of ``(key, row)`` sorted by key; equal keys come in the order of the runs.

    Inner nodes hold the loser of their match and the root the winner, so that
    the next row takes one match a level, on the winner's way up alone.
    """
    sources = [iter(r) for r in runs]
    k = len(sources)
    if not k:
        return
    heads = [next(s, None) for s in sources]

    def beats(a: int, b: int) -> bool:
        if heads[a] is None or heads[b] is None:
            return heads[b] is None and (heads[a] is not None or a < b)
        return (heads[a][0], a) < (heads[b][0], b)

    losers = [0] * k
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    best = winners[1] if k > 1 else 0
    while heads[best] is not None:
        yield heads[best]
        heads[best] = next(sources[best], None)
        node = (best + k) // 2
        while node:
            if beats(losers[node], best):
                losers[node], best = best, losers[node]
            node //= 2


def capture_index(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Global order of captures.

    ``captures`` has ``run, url_key, date, id`` and any other columns; the
    result has all of them and ``history_rank``, from 0 without gaps, by URL
    key, date and id (nulls first, the rest by run).  Runs are stored sorted,
    each as it was read.  Ranges hold about ``range_rows`` rows each whatever a
    URL's share, since the whole key, the run and the place in it cut them; a
    task holds its range's Arrow data and decodes a few rows of each run.
    """
    key = ["url_key", "date", "id"]
    fields = [*key, *(c for c in captures.columns if c not in key)]
    runs = captures.select(*fields).sortWithinPartitions("run", *key).withColumn("_row", F.monotonically_increasing_id())
    runs = stored(runs, "warc-runs")
    ranges = max(1, -(-runs.count() // range_rows))
    schema = T.StructType([*(captures.schema[c] for c in fields), T.StructField("_range_no", T.IntegerType()), T.StructField("_place", T.LongType())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        number = table.column("run").to_numpy()
        cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]

        def cursor(low: int, high: int) -> Iterator[tuple]:
            for start in range(low, high, CURSOR_ROWS):
                part = table.slice(start, min(CURSOR_ROWS, high - start)).select(key)
                for i, row in enumerate(zip(*(c.to_pylist() for c in part.columns))):
                    yield tuple((x is not None, x) for x in row), start + i

        merged = (place for _, place in loser_tree(cursor(low, high) for low, high in zip(cuts, cuts[1:]) if high > low))
        own, begin = TaskContext.get().partitionId(), 0
        while places := list(islice(merged, 10_000)):
            part = table.take(pa.array(places)).select(fields).combine_chunks()
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in part.columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([own] * len(places), pa.int32()), pa.array(range(begin, begin + len(places)), pa.int64())], names=schema.names)
            begin += len(places)

    ordered = runs.repartitionByRange(ranges, *key, "run", "_row").sortWithinPartitions("run", *key, "_row")
    placed = stored(ordered.mapInArrow(merge, schema), "warc-index")
    before = F.coalesce(F.sum("n").over(W.orderBy("_range_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begins = placed.groupBy("_range_no").agg(F.count("*").alias("n")).withColumn("_before", before).select("_range_no", "_before")  # a row a range
    return placed.join(small(stored(begins, "warc-begins")), "_range_no").select(*captures.columns, (F.col("_before") + F.col("_place")).alias("history_rank"))
