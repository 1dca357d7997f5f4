"""Stored tables: where they go, when they are deleted, and what is small."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import scratch
from ledgerloom.sources.shared import LOCAL_FALLBACK, shared_dir


def exists(df):
    return os.path.isdir(df.inputFiles()[0].removeprefix("file:").rpartition("/")[0]) if df.inputFiles() else False


def test_tables_of_a_block_are_deleted_but_those_kept(spark):
    with scratch.passing(spark) as keep:
        a = scratch.stored(spark.range(3), "test-a")
        with scratch.passing(spark) as keep_inner:
            b = keep_inner(scratch.stored(spark.range(4), "test-b"))
            c = scratch.stored(spark.range(5), "test-c")
            paths = [x.inputFiles()[0].removeprefix("file:").rpartition("/")[0] for x in (a, b, c)]
        assert [os.path.isdir(p) for p in paths] == [True, True, False] and b.count() == 4
        keep(a)
    assert [os.path.isdir(p) for p in paths] == [True, False, False]
    scratch.clear(spark)
    assert not any(map(os.path.isdir, paths))


def test_tables_of_a_failed_block_are_deleted(spark):
    with pytest.raises(ZeroDivisionError), scratch.passing(spark):
        path = scratch.stored(spark.range(3), "test-d").inputFiles()[0].removeprefix("file:").rpartition("/")[0]
        1 / 0
    assert not os.path.isdir(path)


def session(master, setting=None, conf=None, own=None):
    context = SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": conf} if conf else {}, getCheckpointDir=lambda: own)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: setting))


def test_the_shared_folder():
    assert shared_dir(session("local[4]")) == LOCAL_FALLBACK
    assert shared_dir(session("yarn", setting="hdfs://a/b/")) == "hdfs://a/b"
    assert shared_dir(session("yarn", conf="hdfs://c")) == "hdfs://c"
    assert shared_dir(session("yarn", own="hdfs://d")) == "hdfs://d"
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(session(master))


def test_small_counts_bytes(spark, monkeypatch):
    rows = spark.range(10).select("id", F.repeat(F.lit("x"), 100).alias("s"), F.array(F.lit(1), F.lit(2)).alias("a"), F.array(F.lit("abc")).alias("t"), F.array(F.struct(F.lit(1).alias("p"), F.lit(2).alias("q"))).alias("u"))
    size = scratch.table_bytes(rows)
    assert size == 10 * (16 * 6 + 100 + 32 + 16 + 3 + 40)
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", size - 1)
    assert scratch.small(rows) is rows
    assert scratch.table_bytes(rows.limit(0)) == 0
