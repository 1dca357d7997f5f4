"""Suffix-array dedup: bytes inside long strings that occur twice.

Prefix doubling ranks positions by the string that begins there, first for a
short length, then for twice that by the pair of ranks at the two halves, and
drops positions once their rank is unique.  Ranks only have to tell equal from
different here, so a rank is a hash of its pair.

1. Positions are thinned to anchors: of each string of the full length, the
   place inside it whose next ``length // 4`` bytes have the smallest hash.
   Equal strings have equal anchors, so an anchor with a unique rank rules out
   every string that was to be found by it.
2. Spark doubles the ranks of anchors, in rounds: a sixteenth of the length,
   an eighth, a quarter.  Each round pairs the ranks at the growing offset,
   groups equal ones and drops the positions whose rank is unique.
3. What survives gets the bytes around it.  Anchors with equal surroundings are
   settled by their hash: all strings there occur twice, and one of them
   stands for the rest.
4. These are sorted by rank.  There the last two doublings, to half and to the
   full length, are done for every position that an anchor speaks for, next to
   those that it can equal.

A rank that very many different surroundings share is split at random, after
those of its strings are dropped whose common core no other one has; what is
single in its part is then matched across parts by its last rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import by_bytes, forget, passing, small, small_batches, stored

LENGTH = 400
#: Positions with one rank that a task compares at once.
PART = 1000
#: The share of the length that neighbouring strings of an anchor don't have in common with each other, where a rank is split.
NEIGHBOURS = 16
#: Bytes of a text that are ranked at a time.
BLOCK = 1 << 19
_POSITION_BITS = 20

_MASK = np.uint64((1 << _POSITION_BITS) - 1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)))) for b in (self.base, self.inverse))
        return self.up, self.down


_POWERS = [_Powers(b) for b in _BASES]


def names(data: np.ndarray, length: int, base: int) -> np.ndarray:
    """A 64-bit name of the ``length`` bytes from each position on."""
    n = len(data) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _POWERS[base].upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    value = (sums[length:] - sums[:n]) * down[:n]
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(32)
    return value


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def rounds(length: int) -> list[int]:
    """Lengths of the ranks that Spark doubles: each is half of the next, rounded up; the last is a quarter of ``length``."""
    last = max(1, length // 4)
    return [-(-last // 4), -(-last // 2), last]


def offsets(length: int) -> list[int]:
    """Where in an anchor's quarter the four shortest ranks begin, neighbours being the pairs of the next round."""
    short, middle, last = rounds(length)
    return [far + near for far in (0, last - middle) for near in (0, middle - short)]


def _thinned(at: np.ndarray, first: np.ndarray, last: np.ndarray, name: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where neighbouring samples have one name (periodic stretches), those that are enough: each is kept while it is in the string.

    Two stay at least: strings of one such stretch can be equal, so its rank
    must not look unique.
    """
    same = name[at[1:]] == name[at[:-1]]
    if not same.any():
        return at, first, last
    begins = np.flatnonzero(np.concatenate(([True], ~same)))
    ends = np.concatenate((begins[1:], [len(at)]))
    keep, first, last = np.ones(len(at), bool), first.copy(), last.copy()
    for low, high in zip(begins[ends - begins > 1], ends[ends - begins > 1]):
        keep[low:high] = False
        p, end = first[low], last[high - 1]
        if at[high - 1] < p + width:  # one would do
            keep[low] = True
            last[low], p = p, p + 1
        while p <= end:
            j = low + int(np.searchsorted(at[low:high], p + width - 1, "right")) - 1
            keep[j], first[j], last[j] = True, p, min(end, at[j])
            p = at[j] + 1
    return at[keep], first[keep], last[keep]


def samples(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text: their positions, names, the first and last string that each speaks for, and four short ranks.

    String ``p`` (the ``length`` bytes from ``p`` on) is spoken for by the
    smallest name among the quarters that lie in it.  Of equal names, any will
    do: what speaks for a string is a name, not a place.
    """
    short, _, quarter = rounds(length)
    width = length - quarter + 1
    data = np.frombuffer(text, np.uint8)
    found: list[list[np.ndarray]] = [[], [], [], [], []]
    for start in range(0, len(data) - length + 1, BLOCK):
        block = data[start : start + BLOCK + length - 1]
        name = names(block, quarter, 0)
        order = (name & ~_MASK) | np.arange(len(name), dtype=np.uint64)
        at = (_sliding_min(order, width) & _MASK).astype(np.int64)
        edge = np.flatnonzero(at[1:] != at[:-1]) + 1
        first, last = np.concatenate(([0], edge)), np.concatenate((edge, [len(at)])) - 1
        at, first, last = _thinned(at[first], first, last, name, width)
        ranks = (names(block, short, 1)[at[:, None] + np.array(offsets(length))] >> np.uint64(32)).astype(np.uint32)
        for held, part in zip(found, (at + start, name[at], first + start, last + start, ranks)):
            held.append(part)
    return tuple(np.concatenate(x) if x else np.empty((0, 4) if i == 4 else 0, np.int64) for i, x in enumerate(found))


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``rec_id, k1, k2, data``: a text's bytes and the two hashes that stand for it; null counts as empty."""
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return df.select(F.col(id_col).alias("rec_id"), F.xxhash64(data).alias("k1"), F.xxhash64(F.lit(1), data).alias("k2"), data.alias("data"))


def sampled(keyed: DataFrame, length: int) -> DataFrame:
    """``k1, k2, at`` and the short ranks ``r0`` to ``r3`` of the anchors of each text."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), *[pa.int32()] * 4)
    fields = ("k1", "k2", "at", "r0", "r1", "r2", "r3")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, 2, 8 << 20):
                k1, k2, at, ranks = [], [], [], []
                for a, b, data in zip(*(c.to_pylist() for c in batch.columns)):
                    position, _, _, _, own = samples(data, length)
                    k1.append(np.full(len(position), a, np.int64))
                    k2.append(np.full(len(position), b, np.int64))
                    at.append(position.astype(np.int32))
                    ranks.append(own.view(np.int32))
                four = np.concatenate(ranks)
                columns = [*map(np.concatenate, (k1, k2, at)), *(np.ascontiguousarray(four[:, i]) for i in range(4))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(fields))

    rows = keyed.filter(F.length("data") >= length).select("k1", "k2", "data")
    return rows.mapInArrow(run, "k1 long, k2 long, at int, r0 int, r1 int, r2 int, r3 int")


def surviving(marks: DataFrame) -> DataFrame:
    """``k1, k2, at``: the anchors whose rank is shared after every round.

    A round counts equal ranks, drops the positions that are alone with
    theirs, and pairs the ranks of neighbouring offsets.  The counts are
    stored, so that neither side of the join is an aggregate and Spark can
    split a rank that a large share of positions has.
    """
    ranks = ["r0", "r1", "r2", "r3"]
    while True:
        shared = stored(marks.groupBy("r0").agg(F.count("*").alias("n")).filter("n > 1").select("r0"), "suffix-shared")
        if len(ranks) == 1:
            return marks.join(shared, "r0", "left_semi").select("k1", "k2", "at")
        pairs = [F.xxhash64(*ranks[i : i + 2]).alias(f"r{i // 2}") for i in range(0, len(ranks), 2)]
        left = stored(marks.join(shared, "r0", "left_semi").select("k1", "k2", "at", *pairs), "suffix-ranked")
        forget(marks, shared)
        marks, ranks = left, [f"r{i}" for i in range(len(pairs))]


def surroundings(keyed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``name, k1, k2, first, anchor, vague, around`` for each wanted anchor: the bytes of the strings that it speaks for.

    ``anchor`` is its place there, and ``vague`` tells that its bytes stand at
    another place there too.
    """
    fields = {"name": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "first": pa.int64(), "anchor": pa.int32(), "vague": pa.bool_(), "around": pa.binary()}
    quarter = rounds(length)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[]] * len(fields)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, fields.values())], names=list(fields))

        rows: list[tuple] = []
        held = 0
        for a, b, data, at in (row for batch in batches for few in by_bytes(batch, 2, 8 << 20) for row in zip(*(c.to_pylist() for c in few.columns))):
            position, name, first, last, _ = samples(data, length)
            for i in np.searchsorted(position, at).tolist():
                low = int(first[i])
                around, place = data[low : int(last[i]) + length], int(position[i]) - low
                own = around[place : place + quarter]
                rows.append((int(name[i].view(np.int64)), a, b, low, place, around.find(own) < place or around.find(own, place + 1) >= 0, around))
                held += len(rows[-1][-1])
                if held > 4 << 20:
                    yield batch_of(rows)
                    rows, held = [], 0
        yield batch_of(rows)

    right = wanted.select(F.col("k1").alias("w1"), F.col("k2").alias("w2"), "rep", "at")
    on = [keyed["k1"] == right["w1"], keyed["k2"] == right["w2"], keyed["rec_id"].eqNullSafe(right["rep"])]
    return keyed.join(small(right), on).select("k1", "k2", "data", "at").mapInArrow(run, "name long, k1 long, k2 long, first long, anchor int, vague boolean, around binary")


def with_cores(split: DataFrame, length: int) -> DataFrame:
    """Those of ``split`` (surroundings of ranks in several parts) that may hold a repeat, with ``open``: a bit for each few neighbouring strings that may.

    Strings are counted by how far from the anchor they begin.  Equal ones
    begin equally far, unless the anchor's bytes stand there twice; so where
    no other surroundings have the core that a few neighbouring strings have in
    common, none of them occurs twice.
    """
    few = -(-length // NEIGHBOURS)
    apart = lambda strings_before: F.floor((F.col("anchor") - strings_before) / few).cast("int")
    strings = F.octet_length("around") - length
    cells = split.select("name", "k1", "k2", "first", "vague", "anchor", "around", F.explode(F.sequence(apart(strings), apart(F.lit(0)))).alias("cell"))
    core = F.xxhash64("name", "cell", F.substring("around", F.col("anchor") - few * F.col("cell") + 1, F.lit(length - few + 1)))
    cells = stored(cells.select("k1", "k2", "first", "vague", "cell", core.alias("core")), "suffix-cells")
    shared = stored(cells.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core", F.lit(True).alias("met")), "suffix-cores")
    live = cells.join(shared, "core", "left").filter("vague OR met").groupBy("k1", "k2", "first").agg(F.bit_or(F.expr("shiftleft(1L, cell)")).alias("open"))
    return split.join(stored(live, "suffix-open"), ["k1", "k2", "first"])


def _paired(rank: np.ndarray, offset: int) -> np.ndarray:
    """Ranks of longer strings from those at each position and at an offset."""
    one, two = rank[: len(rank) - offset], rank[offset:]
    return (one ^ (two >> np.uint64(7))) * np.uint64(_BASES[0]) + two * np.uint64(_BASES[1])


def doubled(around: DataFrame, length: int) -> DataFrame:
    """The last two doublings, for all positions next to those that share their anchor's rank.

    Gives ``k1, k2, first, last`` for each run of strings that occur twice.
    For ranks in several parts there are also rows with ``name, rank``: a
    single string of its part (``first`` is its place) or, with a null
    ``first``, one that has its twin in its part.
    """
    columns = ("k1", "k2", "first", "last", "name", "rank")
    half, few = -(-length // 2), -(-length // NEIGHBOURS)
    quarter = -(-half // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, size = None, [], 0
        out: list[list] = [[] for _ in columns]

        def close() -> None:
            data = np.frombuffer(b"".join(r[5] for r in group), np.uint8)
            lengths = np.array([len(r[5]) for r in group])
            begins = np.cumsum(lengths) - lengths
            counts = lengths - length + 1
            owner = np.repeat(np.arange(len(group)), counts)
            inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            here = begins[owner] + inside
            rank = names(data, quarter, 1)
            for short, long in ((quarter, half), (half, length)):
                rank = _paired(rank, long - short)
            rank = rank[here]
            if key[1] >= 0:
                cell = (np.array([r[6] for r in group])[owner] - inside) // few
                live = np.flatnonzero((np.array([r[7] for r in group], np.int64)[owner] >> cell) & 1)
                rank, owner, inside = rank[live], owner[live], inside[live]
            _, inverse, times = np.unique(rank, return_inverse=True, return_counts=True)
            twice = times[inverse] > 1
            place = np.flatnonzero(twice)
            if len(place):
                breaks = np.flatnonzero((np.diff(inside[place]) != 1) | (np.diff(owner[place]) > 0)) + 1
                for low, high in zip(place[np.concatenate(([0], breaks))], place[np.concatenate((breaks, [len(place)])) - 1]):
                    r = group[owner[low]]
                    for held, x in zip(out, (r[2], r[3], r[4] + int(inside[low]), r[4] + int(inside[high]), None, None)):
                        held.append(x)
            if key[1] >= 0:
                signed = rank.view(np.int64)
                for i in np.flatnonzero(~twice):
                    r = group[owner[i]]
                    for held, x in zip(out, (r[2], r[3], r[4] + int(inside[i]), None, key[0], int(signed[i]))):
                        held.append(x)
                for x in np.unique(signed[twice]).tolist():
                    for held, y in zip(out, (None, None, None, None, key[0], x)):
                        held.append(y)

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=list(columns))
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] != key and group:
                    close()
                    group = []
                key = row[:2]
                group.append(row)
            if len(out[0]) > 20_000:
                yield flush()
        if group:
            close()
        yield flush()

    ordered = around.select("name", "part", "k1", "k2", "first", "around", "anchor", "open").repartition("name", "part").sortWithinPartitions("name", "part")
    return ordered.mapInArrow(run, ", ".join(f"{c} long" for c in columns))


def repeated_spans(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", part: int = PART) -> DataFrame:
    """``k1, k2, spans`` of each text (by its hashes) with bytes inside a ``length``-byte string that begins anywhere else too.

    ``spans`` are maximal runs, sorted arrays of ``start, end`` without
    touching neighbours.
    """
    keyed = _keyed(df, id_col, text_col)
    marks = surviving(stored(sampled(keyed, length), "suffix-samples"))
    per_text = marks.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("at")).alias("at"))
    texts = keyed.filter(F.length("data") >= length).groupBy("k1", "k2").agg(F.min("rec_id").alias("rep"), F.count("*").alias("copies"), F.max(F.length("data")).cast("long").alias("n_bytes"))
    texts = stored(texts, "suffix-texts")
    wanted = stored(texts.join(per_text, ["k1", "k2"]).select("k1", "k2", "rep", "at"), "suffix-wanted")

    around = surroundings(keyed, wanted, length).withColumns({"a1": F.xxhash64("around"), "a2": F.xxhash64(F.lit(1), "around"), "last": F.col("first") + F.octet_length("around") - length})
    around = stored(around, "suffix-around")
    same = stored(around.groupBy("name", "a1", "a2").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "first")).alias("rep")), "suffix-same")
    equal = around.select("name", "a1", "a2", "k1", "k2", "first", "last").join(same.filter("n > 1").select("name", "a1", "a2"), ["name", "a1", "a2"])
    mixed = stored(same.groupBy("name").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("name", F.ceil(F.col("kinds") / part).alias("parts")), "suffix-mixed")
    apart = stored(same.join(small(mixed), "name").select("rep.*", "parts"), "suffix-apart")
    own_part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("k1", "first"), F.col("parts"))).otherwise(-1).cast("int")
    every_kind = around.join(small(apart), ["k1", "k2", "first"])
    whole = every_kind.filter("parts = 1").withColumn("open", F.lit(-1).cast("long"))
    split = with_cores(every_kind.filter("parts > 1"), length)
    compared = whole.unionByName(split).withColumn("part", own_part)

    found = stored(doubled(compared, length), "suffix-doubled")
    runs = found.filter("last is not null").select("k1", "k2", "first", "last")
    across = found.filter("rank is not null")
    met = across.groupBy("name", "rank").agg(F.count("*").alias("n"), F.count("first").alias("singles")).filter("n > 1").select("name", "rank")
    single = across.filter("first is not null").join(met, ["name", "rank"]).select("k1", "k2", "first", F.col("first").alias("last"))
    copies = texts.filter("copies > 1").select("k1", "k2", F.lit(0).cast("long").alias("first"), (F.col("n_bytes") - length).alias("last"))
    every = runs.union(single).union(equal.select("k1", "k2", "first", "last")).union(copies).groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct(F.col("first").alias("start"), (F.col("last") + length).alias("end")))).alias("raw"))
    return every.select("k1", "k2", _merge("raw").alias("spans"))


def _merge(raw: str):
    """Sorted spans, merged where they overlap or touch."""
    kind = "array<struct<start:bigint,end:bigint>>"

    def step(done, x):
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        apart = (F.size(done) == 0) | (F.try_element_at(done, F.lit(-1))["end"] < x["start"])
        return F.when(apart, F.concat(done, F.array(x))).otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined)))

    return F.aggregate(raw, F.array().cast(kind), step)


def remove_repeats(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", part: int = PART) -> DataFrame:
    """Each row's text as bytes without those inside repeated strings.

    Returns ``id_col, n_bytes, spans`` (of removed bytes: ``start, end``) and
    ``kept`` (the remaining bytes joined; they may cut a character).  Null and
    short texts lose nothing; null counts as empty.  Every copy of a string
    goes, the first too, and copies may overlap in one text.  Repeated rows
    are copies.  An empty table gives an empty result.
    """
    small_batches(df.sparkSession)
    keyed = _keyed(df, id_col, text_col)
    with passing(df.sparkSession) as keep:
        spans = keep(stored(repeated_spans(df, length, id_col, text_col, part), "suffix-spans"))
    right = spans.select(F.col("k1").alias("w1"), F.col("k2").alias("w2"), "spans")
    joined = keyed.join(small(right), [keyed["k1"] == right["w1"], keyed["k2"] == right["w2"]], "left")
    kind = "array<struct<start:bigint,end:bigint>>"
    rows = joined.select("rec_id", "data", F.coalesce("spans", F.array().cast(kind)).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for data, cut in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ends = [0, *(s["end"] for s in cut)]
                kept.append(b"".join(data[a:b] for a, b in zip(ends, [*(s["start"] for s in cut), len(data)])))
            n = [len(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(2), pa.array(kept, pa.binary())], names=["rec_id", "n_bytes", "spans", "kept"])

    schema = T.StructType([keyed.schema["rec_id"], T.StructField("n_bytes", T.LongType()), rows.schema["spans"], T.StructField("kept", T.BinaryType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("rec_id", id_col)
