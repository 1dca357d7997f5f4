"""Logs of responses, sessions and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.schemas import RESPONSE
from ledgerloom.sources import response_log, shared
from ledgerloom.streaming import capture, session
from tests.test_finance import RESPONSES

ORIGIN = "https://h.co"


def frame(spark, rows):
    return spark.createDataFrame(rows, RESPONSE)


def run(spark, writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def numbered(n, begin=0):
    return [(i, f"https://h.co/api/{'saldo' if i % 3 else 'movim'}/{i % 5}", "GET", 200, "application/json", json.dumps([{"saldo": i}])) for i in range(begin, begin + n)]


def test_a_log_is_read_in_batch_and_as_a_stream_over_restarts(spark, tmp_path):
    log, out, progress = (f"{tmp_path}/{x}" for x in ("log", "out", "progress"))
    rows = numbered(50)
    for part in (rows[:20], rows[20:21], rows[21:]):
        response_log.push(frame(spark, part).repartition(3), log)
        run(spark, session.accumulate(response_log.read_stream(spark, log), ORIGIN, out, progress))
    every = capture.captures(frame(spark, rows), ORIGIN)
    assert sorted(session.read_batches(spark, out).drop("batch").collect()) == sorted(every.collect())
    assert {r.batch for r in session.read_batches(spark, out).select("batch").distinct().collect()} == {0, 1, 2}
    response_log.register(spark)
    assert sorted(spark.read.format("response_log").option("path", log).load().collect()) == sorted(frame(spark, rows).collect())


def test_segments_count_once_they_are_whole(spark, tmp_path):
    log = f"{tmp_path}/log"
    assert response_log.last_segment(log) == 0
    assert [response_log.push(frame(spark, numbered(2, k)), log) for k in (0, 2)] == [1, 2]
    (tmp_path / "log" / "000000001" / "_SUCCESS").unlink()
    assert response_log.last_segment(log) == 0 and response_log.last_segment(log, 1) == 2
    parts = response_log._split(log, 0, 2, 1)
    assert len(parts) == sum(len(p.paths) for p in parts) and sorted(x[0] for p in parts for x in response_log._rows(log, p)) == [0, 1, 2, 3]
    assert len(response_log._split(log, 0, 2, 1 << 20)) == 1
    assert response_log.push(frame(spark, numbered(5, 10)), log) == 1  # a writer that failed begins its segment again


def test_nulls_and_empty_segments(spark, tmp_path):
    log = f"{tmp_path}/log"
    rows = [(None, None, None, None, None, None), (1, "u\n", "GET", None, None, "é ")]
    response_log.push(frame(spark, rows), log)
    response_log.push(frame(spark, []), log)
    response_log.register(spark)
    assert sorted(map(str, spark.read.format("response_log").option("path", log).load().collect())) == sorted(map(str, frame(spark, rows).collect()))


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    """The sink of a batch whose commit was lost: Spark runs it again under its number."""
    log, out, progress = (f"{tmp_path}/{x}" for x in ("log", "out", "progress"))
    for k in range(2):
        response_log.push(frame(spark, numbered(10, 10 * k)), log)
        run(spark, session.accumulate(response_log.read_stream(spark, log), ORIGIN, out, progress))
    before = sorted(session.read_batches(spark, out).collect())
    (tmp_path / "progress" / "commits" / "1").unlink()
    for crc in (tmp_path / "progress" / "commits").glob(".1.crc"):
        crc.unlink()
    run(spark, session.accumulate(response_log.read_stream(spark, log), ORIGIN, out, progress))
    assert sorted(session.read_batches(spark, out).collect()) == before and len(before) == 20


def test_endpoints_run_along(spark, tmp_path):
    log, out, progress = (f"{tmp_path}/{x}" for x in ("log", "out", "progress"))
    rows = [r for r in RESPONSES if r[0] > 2] + [RESPONSES[1]] + numbered(6, 20)
    for n, part in enumerate((rows[:3], rows[3:5], rows[5:8], rows[8:])):
        response_log.push(frame(spark, part), log)
        run(spark, session.running_endpoints(response_log.read_stream(spark, log), ORIGIN, out, progress))
        so_far = rows[: (3, 5, 8, len(rows))[n]]
        expected = capture.infer_endpoints(capture.captures(frame(spark, so_far), ORIGIN)).select("accounts_url", "transactions_url").first()
        assert session.latest_endpoints(spark, out).first() == expected
    assert session.read_batches(spark, out).count() == 4


def test_a_session_ends_at_the_hand_off_and_loses_nothing(spark, tmp_path):
    log = f"{tmp_path}/log"
    response_log.push(frame(spark, numbered(7)), log)
    stream = response_log.read_stream(spark, log)
    writers = [session.accumulate(stream, ORIGIN, f"{tmp_path}/a", f"{tmp_path}/pa"), session.running_endpoints(stream, ORIGIN, f"{tmp_path}/b", f"{tmp_path}/pb")]
    with session.CaptureSession(spark, writers) as running:
        for k in range(3):
            response_log.push(frame(spark, numbered(5, 100 * k + 10)), log)
        seen = running.hand_off()
    assert session.read_batches(spark, f"{tmp_path}/a").count() == 22 and seen["batches"] >= 2 and seen["rows"] == 44
    assert not any(q.isActive for q in running.queries)
    response_log.push(frame(spark, numbered(5, 900)), log)
    assert session.read_batches(spark, f"{tmp_path}/a").count() == 22


def test_a_failing_query_is_told_at_the_hand_off(spark, tmp_path):
    log = f"{tmp_path}/log"
    response_log.push(frame(spark, numbered(3)), log)
    broken = response_log.read_stream(spark, log).withColumn("body", F.raise_error(F.lit("no disk")).cast("string"))
    with pytest.raises(Exception, match="no disk"), session.CaptureSession(spark, [session.accumulate(broken, ORIGIN, f"{tmp_path}/a", f"{tmp_path}/p")]) as running:
        running.hand_off()


def test_folders_are_known_and_deleted(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}")
    a, b = (shared.work_folder(spark, x) for x in "ab")
    for path in (a, b):
        spark.range(1).write.parquet(path)
    shared.delete_folders(spark, a)
    assert a not in shared._folders and [p.name for p in tmp_path.iterdir()] == [b.rpartition("/")[2]]
    shared.delete_folders(spark, b)
    assert not list(tmp_path.iterdir())
