"""Sharding by fixed virtual slots.

A record's key hashes into one of ``n_slots`` slots, for good.  Bytes are
summed per slot, and a small versioned map says which shard holds each slot.
Rebalancing edits the map: it moves whole slots and leaves every record's slot
as it was.  Only the map and the per-slot sums, ``n_slots`` rows whatever the
input, ever reach the driver or are broadcast.

A record's key is its id and its text.  Groups of equal texts are spread over
slots by their ids and not kept together: one may hold a third of all bytes,
and then no law of even shards could hold.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .scratch import small, stored

N_SLOTS = 8192
#: Parts in which a slot's rows are numbered, so that a slot with many is no single task.
CHUNKS = 256
#: Bytes that a record takes besides its text.
RECORD_BYTES = 8

MAP_SCHEMA = T.StructType(
    [
        T.StructField("version", T.IntegerType(), False),
        T.StructField("virtual_slot", T.IntegerType(), False),
        T.StructField("shard", T.IntegerType(), False),
        T.StructField("slot_bytes", T.LongType(), False),
        T.StructField("slot_rows", T.LongType(), False),
    ]
)


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each slot. ``shards[s]`` is that of slot ``s``; bytes and rows are those measured."""

    version: int
    n_shards: int
    shards: tuple[int, ...]
    slot_bytes: tuple[int, ...]
    slot_rows: tuple[int, ...]

    def loads(self) -> list[int]:
        held = [0] * self.n_shards
        for shard, size in zip(self.shards, self.slot_bytes):
            held[shard] += size
        return held

    def to_rows(self) -> list[tuple[int, int, int, int, int]]:
        return [(self.version, s, *x) for s, x in enumerate(zip(self.shards, self.slot_bytes, self.slot_rows))]

    def write(self, spark: SparkSession, path: str) -> None:
        """Add this version to the table of versions at ``path``."""
        spark.createDataFrame(self.to_rows(), MAP_SCHEMA).coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @staticmethod
    def read(spark: SparkSession, path: str, version: int | None = None) -> "SlotMap":
        """The given version at ``path``, or the latest."""
        table = spark.read.parquet(path)
        version = table.agg(F.max("version")).first()[0] if version is None else version
        rows = sorted(table.filter(F.col("version") == version).select("virtual_slot", "shard", "slot_bytes", "slot_rows").collect())
        return SlotMap(version, max(r[1] for r in rows) + 1, *(tuple(r[i] for r in rows) for i in (1, 2, 3)))


def plan_map(slot_bytes: list[int], slot_rows: list[int], n_shards: int) -> SlotMap:
    """Version 1: slots from the largest down, each to the shard with the fewest bytes so far."""
    heap = [(0, 0, shard) for shard in range(n_shards)]
    shards = [0] * len(slot_bytes)
    for slot in sorted(range(len(slot_bytes)), key=lambda s: (-slot_bytes[s], s)):
        held, slots, shard = heapq.heappop(heap)
        shards[slot] = shard
        heapq.heappush(heap, (held + slot_bytes[slot], slots + 1, shard))
    return SlotMap(1, n_shards, tuple(shards), tuple(slot_bytes), tuple(slot_rows))


def rebalance(old: SlotMap, slot_bytes: list[int], slot_rows: list[int], n_shards: int | None = None, tolerance: float = 0.01) -> SlotMap:
    """The next version for new sums or more shards, moving few slots.

    While the fullest shard is over the mean by ``tolerance``, it gives the
    emptiest shard the largest slot that narrows their difference.
    """
    n = n_shards or old.n_shards
    if n < old.n_shards:
        raise ValueError("a map can't lose shards")
    shards = list(old.shards)
    own: list[list[int]] = [[] for _ in range(n)]
    for slot, shard in enumerate(shards):
        own[shard].append(slot)
    held = [sum(slot_bytes[s] for s in x) for x in own]
    mean = sum(held) / n
    while True:
        full, empty = max(range(n), key=lambda i: (held[i], -i)), min(range(n), key=lambda i: (held[i], i))
        gap = held[full] - held[empty]
        fits = [s for s in own[full] if 0 < slot_bytes[s] < gap]
        if held[full] <= mean * (1 + tolerance) or not fits:
            break
        slot = max((s for s in fits if slot_bytes[s] * 2 <= gap), key=lambda s: slot_bytes[s], default=None)
        slot = min(fits, key=lambda s: slot_bytes[s]) if slot is None else slot
        own[full].remove(slot)
        own[empty].append(slot)
        shards[slot] = empty
        held[full] -= slot_bytes[slot]
        held[empty] += slot_bytes[slot]
    return SlotMap(old.version + 1, n, tuple(shards), tuple(slot_bytes), tuple(slot_rows))


def slot_of(id_col: str, text_col: str, n_slots: int) -> Column:
    """The slot of a row, from its id and text; rows that share both share it."""
    return F.pmod(F.xxhash64(id_col, text_col), F.lit(n_slots)).cast("int")


def with_slots(df: DataFrame, id_col: str, text_col: str, n_slots: int) -> DataFrame:
    """``rec_id, size, text_crc32, virtual_slot`` for each row."""
    text = F.col(text_col)
    return df.select(
        F.col(id_col).alias("rec_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + RECORD_BYTES).alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        slot_of(id_col, text_col, n_slots).alias("virtual_slot"),
    )


def slot_sums(rows: DataFrame, n_slots: int) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot; at most ``n_slots`` rows come to the driver."""
    size, count = [0] * n_slots, [0] * n_slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r.virtual_slot], count[r.virtual_slot] = r.b, r.n
    return size, count


def assign_shards(
    df: DataFrame,
    slot_map: SlotMap | None = None,
    map_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_shards: int = 24,
    n_slots: int = N_SLOTS,
) -> DataFrame:
    """Put each row into a shard; sizes of shards come out nearly equal in bytes.

    Returns ``id_col, size, text_crc32, shard, slot, virtual_slot,
    map_version``.  ``size`` is the text's UTF-8 bytes plus 8; ``slot`` is the
    row's place in its shard, from 0 without gaps, in the order of virtual
    slots.  A null text has no bytes and checksum 0.  Rows with one id and
    text share a virtual slot, and each gets a place of its own: a flood of
    such rows is the one thing that makes a shard heavier than the others.
    Rows without an id are dealt by their text.  An empty table gives an empty
    result.  Without ``slot_map`` one is made from the table's own sums
    and, with ``map_path``, stored there as a new version.
    """
    spark = df.sparkSession
    n_slots = len(slot_map.shards) if slot_map else n_slots
    rows = stored(with_slots(df, id_col, text_col, n_slots).withColumn("chunk", F.pmod(F.spark_partition_id(), F.lit(CHUNKS))), "shard-rows")
    slot_bytes, slot_rows = slot_sums(rows, n_slots)
    if slot_map is None:
        slot_map = plan_map(slot_bytes, slot_rows, n_shards)
        if map_path:
            slot_map.write(spark, map_path)
    begins, filled = [], [0] * slot_map.n_shards
    for shard, count in zip(slot_map.shards, slot_rows):
        begins.append(filled[shard])
        filled[shard] += count
    table = spark.createDataFrame(
        [(s, shard, b) for s, (shard, b) in enumerate(zip(slot_map.shards, begins))],
        "virtual_slot int, shard int, begins long",
    )
    chunks = rows.groupBy("virtual_slot", "chunk").agg(F.count("*").alias("own"))  # n_slots * CHUNKS rows at most
    before = F.sum("own").over(W.partitionBy("virtual_slot").orderBy("chunk")) - F.col("own")
    chunks = stored(chunks.select("virtual_slot", "chunk", before.alias("before")), "shard-chunks")
    place = F.row_number().over(W.partitionBy("virtual_slot", "chunk").orderBy("rec_id", "text_crc32"))
    return (
        rows.withColumn("place", place)
        .join(small(chunks), ["virtual_slot", "chunk"])
        .join(F.broadcast(table), "virtual_slot")  # n_slots rows, whatever the input
        .select(
            F.col("rec_id").alias(id_col), "size", "text_crc32", "shard",
            (F.col("begins") + F.col("before") + F.col("place") - 1).cast("long").alias("slot"),
            "virtual_slot", F.lit(slot_map.version).alias("map_version"),
        )
    )


def write_shards(df: DataFrame, slot_map: SlotMap, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all columns of ``df`` under ``path``, one folder a shard, by ``slot_map``."""
    n_slots = len(slot_map.shards)
    held = F.element_at(F.array(*map(F.lit, slot_map.shards)), slot_of(id_col, text_col, n_slots) + 1)
    df.withColumn("shard", held).write.partitionBy("shard").parquet(path)
