"""Phrase collocations, counted in the slots of a minimal perfect hash.

Texts are tokenised once, into chunks of one language with a vocabulary of their own.
Words are named by hashes that are checked to differ.  Candidates grow by a word a
round: a phrase is one if both its parts of one word less are and all that share its hash
reach the least count together, so no frequent phrase is lost.  The first chunk that
has a candidate gives its words.  Then the candidates
get a minimal perfect hash with the words of each stored by slot; mappers add up numpy
arrays of counts by slot, a tree of sums adds these, and the counts of a phrase and of
both parts of each cut are read by slot.

What mappers hold is bounded at every size: a bitmap of BITS bits a round, which
can only let more candidates through, and GROUP_KEYS candidates at a time; more
candidates take more passes over the chunks.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .exact_dedup import LOWER, UPPER
from .scratch import forget, frugal, new_folder, passing, small, small_batches, stored

UNKNOWN = "und"
#: Bytes tokenised at once, and words after which a chunk may end (at the next end of a piece).
SLICE_BYTES, CHUNK_WORDS = 2 << 20, 1 << 20
#: Bits of a round's filter (a hash's highest ones give its place), candidates of one perfect hash, slots of a row of counts.
BITS, GROUP_KEYS, BLOCK_SLOTS = 26, 1 << 20, 1 << 16
#: The block that tells of phrases with the hash of another.
CLASHED = -1

_END = b"\xff"  # no byte of UTF-8
_FOLD = bytes.maketrans(UPPER.encode() + b".,;:!?\n\x0b\x0c\r", LOWER.encode() + _END * 10)
_BREAK = re.compile(rb"[ \t\xff]")
_CHUNK = "lang string, words array<string>, ids array<long>, counts array<long>, codes binary"
_WEIGHT, _STIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def longer(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The hash of each phrase with a word more."""
    out = hashes * _WEIGHT + words
    out ^= out >> np.uint64(29)
    out *= _STIR
    out ^= out >> np.uint64(32)
    return out


class _Chunk:
    """Tokenised text of one language: a vocabulary, and a code a word, -1 at the end of a piece."""

    def __init__(self, lang: str) -> None:
        self.lang, self.waiting, self.held = lang, [], 0
        self.clear()

    def clear(self) -> None:
        self.codes: list[np.ndarray] = []
        self.words: dict[bytes, int] = {}
        self.n = 0

    def take(self, text: str, slice_bytes: int) -> Iterator[bool]:
        """Add a text; yields where the chunk may end."""
        folded = text.encode().translate(_FOLD)
        self.waiting.append(folded)
        self.held += len(folded) + 1
        if self.held < slice_bytes:
            return
        whole, begin = _END.join(self.waiting) + _END, 0
        while len(whole) - begin >= slice_bytes:
            cut = whole.rfind(_END, begin, begin + slice_bytes) + 1
            if not cut:  # one piece goes on: cut at a blank, or where the next one is
                cut = max(whole.rfind(b, begin, begin + slice_bytes) for b in (b" ", b"\t")) + 1 or _BREAK.search(whole, begin + slice_bytes - 1).end()
            self._add(whole[begin:cut])
            if whole[cut - 1 : cut] == _END:
                yield True
            begin = cut
        self.waiting, self.held = [whole[begin:-1]] if begin < len(whole) else [], len(whole) - begin

    def end(self) -> None:
        if self.held:
            self._add(_END.join(self.waiting) + _END)
            self.waiting, self.held = [], 0

    def _add(self, part: bytes) -> None:
        found = pa.array(part.replace(_END, b" \xff ").split(), pa.binary()).dictionary_encode()
        codes = np.array([-1 if w == _END else self.words.setdefault(w, len(self.words)) for w in found.dictionary.to_pylist()], np.int32)
        self.codes.append(codes[found.indices.to_numpy()])
        self.n += len(found)

    def batch(self, seed: int) -> pa.RecordBatch:
        codes = np.concatenate(self.codes) if self.codes else np.zeros(0, np.int32)
        counts = np.bincount(codes[codes >= 0], minlength=len(self.words))
        prefix = self.lang.encode() + b"\0"
        ids = np.array([xxhash.xxh64_intdigest(prefix + w, seed) for w in self.words], np.uint64).view(np.int64)
        columns = [self.lang], [[w.decode() for w in self.words]], [ids], [counts], [codes.tobytes()]
        types = pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()
        self.clear()
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["lang", "words", "ids", "counts", "codes"])


def _tokenised(seed: int, slice_bytes: int, chunk_words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[str, _Chunk] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                chunk = chunks.setdefault(lang, _Chunk(lang))
                for _ in chunk.take(text.as_py() or "", slice_bytes):
                    if chunk.n >= chunk_words:
                        yield chunk.batch(seed)
        for chunk in chunks.values():
            chunk.end()
            if chunk.words:
                yield chunk.batch(seed)

    return run


def _hit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - BITS)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _phrases(ids: np.ndarray, codes: np.ndarray, filters: list[np.ndarray], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``size, starts, hashes`` of the candidates in a chunk from two words on; a size without a filter is the last."""
    own = ids[np.maximum(codes, 0)]
    at = np.flatnonzero((codes >= 0) & _hit(filters[0], ids)[np.maximum(codes, 0)])
    hashes = own[at]
    for size in range(2, longest + 1):
        good = np.zeros(len(codes) + 1, bool)
        good[at] = True
        both = good[at + 1]
        at = at[both]
        hashes = longer(hashes[both], own[at + size - 1])
        if size <= len(filters):
            known = _hit(filters[size - 1], hashes)
            at, hashes = at[known], hashes[known]
        yield size, at, hashes
        if size > len(filters):
            return


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``chunk, ids, codes`` of each row; a chunk has a word at least."""
    for batch in batches:
        for chunk, ids, codes in zip(batch.column("chunk"), batch.column("ids"), batch.column("codes")):
            yield chunk.as_py(), ids.values.to_numpy(zero_copy_only=False).view(np.uint64), np.frombuffer(codes.as_buffer(), np.int32)


def _totals(filters, size: int):
    """How often each hash of phrases of ``size`` words occurs in a chunk."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, codes in _numbered(batches):
            for found, _, hashes in _phrases(ids, codes, filters.value, size):
                if found == size:
                    distinct, n = np.unique(hashes, return_counts=True)
                    yield pa.record_batch([pa.array(distinct.view(np.int64)), pa.array(n), pa.array(np.full(len(n), chunk))], ["hash", "n", "chunk"])

    return frugal(run)


def _worded(filters, longest: int):
    """The words' hashes of each candidate that is asked of a chunk, which is one that has it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (_, ids, codes) in enumerate(_numbered([batch])):
                asked = np.unique(batch.column("asked")[row].values.to_numpy(zero_copy_only=False).view(np.uint64))
                for size, starts, hashes in _phrases(ids, codes, filters.value, longest):
                    wanted = np.isin(hashes, asked)
                    starts, hashes = starts[wanted], hashes[wanted]
                    keys = np.unique(ids[codes[starts[:, None] + np.arange(size)]].view(np.int64).reshape(-1, size), axis=0)
                    out = keys.view(np.uint64)[:, 0]
                    for i in range(1, size):
                        out = longer(out, keys.view(np.uint64)[:, i])
                    lists = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * size, keys.ravel())
                    yield pa.record_batch([pa.array(out.view(np.int64)), lists], ["hash", "key"])

    return frugal(run)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit numbers: each has a slot of its own, from 0 without gaps.

    Each level has two bits a number that is left; those that are alone at their place
    set its bit, the others go on.  A slot is the count of bits set before.
    """

    def __init__(self, hashes: np.ndarray) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.size = 0
        while len(hashes):
            size = -(-2 * len(hashes) // 64) * 64
            at = self._place(hashes, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            before = self.size + np.concatenate([[0], np.cumsum(np.bitwise_count(words))[:-1]])
            self.levels.append((size, words, before.astype(np.int64)))
            self.size += int(alone.sum())
            hashes = hashes[~alone[at]]

    @staticmethod
    def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (longer(hashes, np.uint64(level)) % np.uint64(size)).astype(np.int64)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """A number's slot; for one that wasn't given, any slot or -1."""
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for level, (size, words, before) in enumerate(self.levels):
            if not len(left):
                break
            at = self._place(hashes[left], level, size)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            found = (word >> bit) & np.uint64(1) == 1
            out[left[found]] = (before[at >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))))[found]
            left = left[~found]
        return out


class Slots:
    """A perfect hash of phrases that keeps the words of each by slot, so that what isn't one of them is told apart."""

    def __init__(self, hashes: np.ndarray, keys: list[np.ndarray], longest: int) -> None:
        self.hash = PerfectHash(hashes)
        self.sizes = np.zeros(len(hashes), np.int8)
        self.words = np.zeros((len(hashes), longest), np.uint64)
        self.hashes = np.zeros(len(hashes), np.uint64)
        self.clashes = 0  # other phrases met that have the hash of one stored
        slots = self.hash.slots(hashes)
        self.hashes[slots] = hashes
        sizes = np.array([len(k) for k in keys], np.int64)
        self.sizes[slots] = sizes
        for size in np.unique(sizes):
            which = np.flatnonzero(sizes == size)
            self.words[slots[which], :size] = np.array([keys[i] for i in which]).view(np.uint64)

    def find(self, hashes: np.ndarray, words: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """Slots of phrases of ``size`` words; ``words`` gives those of the rows asked for. -1 for what isn't stored."""
        out = self.hash.slots(hashes)
        rows = np.flatnonzero(out >= 0)
        same = (self.sizes[out[rows]] == size) & (self.words[out[rows], :size] == words(rows)).all(axis=1)
        self.clashes += int((~same & (self.hashes[out[rows]] == hashes[rows])).sum())
        out[rows[~same]] = -1
        return out


def _counted(filters, slots, longest: int):
    """Counts by slot of all that a task reads, in blocks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Slots = slots.value
        counts = np.zeros(table.hash.size, np.int64)
        table.clashes = 0

        def add(found: np.ndarray) -> None:
            counts[:] += np.bincount(found[found >= 0], minlength=len(counts))

        for _, ids, codes in _numbered(batches):
            single = table.find(ids, lambda rows: ids[rows][:, None], 1)
            add(single[codes[codes >= 0]])
            for size, starts, hashes in _phrases(ids, codes, filters.value, longest):
                add(table.find(hashes, lambda rows: ids[codes[starts[rows][:, None] + np.arange(size)]], size))
        if table.clashes:
            yield pa.record_batch([pa.array([CLASHED], pa.int32()), pa.array([np.int64(table.clashes).tobytes()])], ["block", "counts"])
        for block in range(0, len(counts), BLOCK_SLOTS):
            part = counts[block : block + BLOCK_SLOTS]
            if part.any():
                yield pa.record_batch([pa.array([block // BLOCK_SLOTS], pa.int32()), pa.array([part.tobytes()])], ["block", "counts"])

    return frugal(run)


def _summed(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in rows["counts"])
    return pa.table({"block": rows["block"].slice(0, 1), "counts": pa.array([total.tobytes()])})


def _cut_counts(slots, longest: int):
    """``hash, key`` and ``c``: the counts of the phrase and of the first and second part of each cut; 0 for what isn't in these slots."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = slots.value
        for batch in batches:
            sizes = batch.column("key").value_lengths().to_numpy()
            for size in np.unique(sizes):
                rows = batch.take(pa.array(np.flatnonzero(sizes == size)))
                words = rows.column("key").flatten().to_numpy().view(np.uint64).reshape(-1, size)
                out = np.zeros((len(words), 2 * longest - 1), np.int64)
                parts = [(0, 0, size)] + [p for k in range(1, size) for p in ((2 * k - 1, 0, k), (2 * k, k, size))]
                for place, begin, end in parts:
                    part = words[:, begin:end]
                    hashes = part[:, 0]
                    for i in range(1, end - begin):
                        hashes = longer(hashes, part[:, i])
                    found = table.find(hashes, lambda asked: part[asked], end - begin)
                    out[:, place] = np.where(found >= 0, counts[np.maximum(found, 0)], 0)
                lists = pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1], out.ravel())
                yield pa.record_batch([rows.column("hash"), rows.column("key"), lists], ["hash", "key", "c"])

    return run


def _filter(hashes: DataFrame) -> np.ndarray:
    """The bitmap of a column ``hash``, made from Spark's partial bitmaps."""
    at = F.shiftrightunsigned("hash", 64 - BITS) + 1
    parts = hashes.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for bucket, bits in parts.collect():  # at most BITS bits in all
        out[(bucket - 1) * len(bits) : bucket * len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def _unique(df: DataFrame, column: str) -> bool:
    return not df.groupBy(column).count().filter("count > 1").limit(1).count()


def _group_counts(spark: SparkSession, chunks: DataFrame, keys: DataFrame, filters, longest: int):
    """The slots of ``keys``, which fit one perfect hash, and how often each occurs, for all tasks; None if another phrase has the hash of one."""
    own = keys.toArrow()
    table = Slots(own["hash"].to_numpy().view(np.uint64), [np.array(k, np.int64) for k in own["key"].to_pylist()], longest)
    sent = spark.sparkContext.broadcast(table)
    parts = chunks.select("chunk", "ids", "codes").mapInArrow(_counted(filters, sent, longest), "block int, counts binary")
    branches = max(1, int(chunks.rdd.getNumPartitions() ** 0.5))
    first = parts.withColumn("branch", F.spark_partition_id() % branches).groupBy("block", "branch").applyInArrow(_summed, "block int, counts binary")
    total = np.zeros(table.hash.size, np.int64)
    found = first.groupBy("block").applyInArrow(_summed, "block int, counts binary").collect()  # GROUP_KEYS numbers in all
    sent.unpersist()
    if any(block == CLASHED for block, _ in found):
        return None
    for block, counts in found:
        total[block * BLOCK_SLOTS : block * BLOCK_SLOTS + len(counts) // 8] = np.frombuffer(counts, np.int64)
    return spark.sparkContext.broadcast((table, total))


def _stored_chunks(chunks: DataFrame) -> DataFrame:
    """As :func:`stored`, in row groups of few rows: a reader holds a whole one, and a row takes some MB."""
    path = new_folder(chunks.sparkSession, "chunks")
    chunks = chunks.withColumn("chunk", F.monotonically_increasing_id())
    chunks.write.options(**{"parquet.block.row.count.limit": "4", "parquet.page.size.row.check.min": "1"}).parquet(path)
    return chunks.sparkSession.read.schema(chunks.schema).parquet(path)


def phrase_counts(docs: DataFrame, least: int, longest: int, lang_col: str, text_col: str, slice_bytes: int = SLICE_BYTES, chunk_words: int = CHUNK_WORDS, group_keys: int = GROUP_KEYS, seeds: Iterable[int] = itertools.count()) -> tuple[DataFrame, DataFrame]:
    """``hash, key, c`` of all frequent phrases and words (see :func:`_cut_counts`), and ``lang, word, id, n`` of all words."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)), F.col(text_col))
    for seed in seeds:
        chunks = _stored_chunks(texts.mapInArrow(frugal(_tokenised(seed, slice_bytes, chunk_words)), _CHUNK))
        each = chunks.select("lang", F.explode(F.arrays_zip("words", "ids", "counts")).alias("w")).select("lang", "w.words", "w.ids", "w.counts")
        words = stored(each.groupBy("lang", F.col("words").alias("word"), F.col("ids").alias("id")).agg(F.sum("counts").alias("n")), "words")
        if not _unique(words, "id"):
            forget(chunks, words)
            continue
        often = words.filter(F.col("n") >= least).select(F.col("id").alias("hash"), F.array("id").alias("key"))
        bitmaps, candidates = [_filter(often)], []
        for size in range(2, longest + 1):
            sent = spark.sparkContext.broadcast(bitmaps)
            totals = chunks.select("chunk", "ids", "codes").mapInArrow(_totals(sent, size), "hash long, n long, chunk long").groupBy("hash").agg(F.sum("n").alias("n"), F.min("chunk").alias("chunk"))
            candidates.append(stored(totals.filter(F.col("n") >= least).select("hash", "chunk"), f"phrases-{size}"))
            sent.unpersist()
            bitmaps.append(_filter(candidates[-1]))
        filters = spark.sparkContext.broadcast(bitmaps)
        every = candidates[0]
        for more in candidates[1:]:
            every = every.union(more)
        asked = stored(every.groupBy("chunk").agg(F.collect_list("hash").alias("asked")), "phrases-asked")  # a chunk's own phrases
        found = chunks.select("chunk", "ids", "codes").join(small(asked), "chunk").mapInArrow(_worded(filters, longest), "hash long, key array<long>")
        keys = stored(found.distinct().union(often), "phrases")
        own = [None]
        if _unique(keys, "hash"):
            groups = -(-max(1, keys.count()) // group_keys)
            own = [_group_counts(spark, chunks, keys.filter(F.pmod("hash", F.lit(groups)) == g), filters, longest) for g in range(groups)]
        if None not in own:
            break
        forget(chunks, words, keys)
    parts = [keys.mapInArrow(_cut_counts(table, longest), "hash long, key array<long>, c array<long>") for table in own]
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    sums = [F.sum(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(2 * longest - 1)]
    return stored(found.groupBy("hash", "key").agg(*sums), "phrase-counts").filter(F.col("c0") >= least), words


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, cover: int = 100, lang_col: str = "lang", text_col: str = "text", **limits) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of 2 to ``longest`` words that occur ``least`` times or more.

    A-Z are folded; words are parted by blanks and tabs, and no phrase crosses one of ``.,;:!?``
    or a line's end.  ``a`` is how often the phrase occurs, ``l`` and ``r`` its first and second part at
    the cut that scores lowest (then the earliest), ``n`` all words of the language, and ``score`` is
    floor(1000 a n / (l r)), exact at any size.  A phrase goes if a longer one that holds its words occurs ``cover``
    hundredths as often or more.  Order: score, then ``a``, both falling, then the phrase's bytes.

    A null language is ``und``, a null text empty; repeated rows count each time; other columns
    aren't read.  An empty table gives an empty result.  ``limits`` are those of :func:`phrase_counts`.
    """
    with passing(docs.sparkSession) as keep:
        found, words = phrase_counts(docs, least, longest, lang_col, text_col, **limits)
        own = small(words.filter(F.col("n") >= least).select(F.col("id").alias("word_id"), "lang", "word"))
        apart = found.filter(F.size("key") > 1).select("hash", F.posexplode("key").alias("place", "word_id")).join(own, "word_id")
        spelled = apart.groupBy("hash").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w"))
        phrases = found.join(spelled.select("hash", "lang", F.array_join("w.word", " ").alias("phrase")), "hash").join(small(words.groupBy("lang").agg(F.sum("n").alias("n"))), "lang")
        cuts = F.array(*(F.when(F.size("key") > k, F.struct(_score(f"c{2 * k - 1}", f"c{2 * k}").alias("score"), F.lit(k).alias("k"), F.col(f"c{2 * k - 1}").alias("l"), F.col(f"c{2 * k}").alias("r"))) for k in range(1, longest)))
        inside = [F.when((F.size("key") > size) & (F.size("key") >= at + size), F.slice("key", at + 1, size)) for size in range(2, longest) for at in range(longest - size + 1)]
        if inside:
            above = found.select("c0", F.explode(F.array(*inside)).alias("part")).filter("part IS NOT NULL").groupBy("part").agg(F.max("c0").alias("above"))
            phrases = phrases.join(above, F.col("key") == F.col("part"), "left").filter(F.col("above").isNull() | (100 * F.col("above") < cover * F.col("c0")))
        scored = phrases.withColumn("cut", F.array_min(cuts)).select("lang", "phrase", F.col("c0").alias("a"), "cut.l", "cut.r", "n", "cut.score")
        place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
        best = scored.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top)
        return keep(stored(best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations"))


def _score(left: str, right: str) -> Column:
    """floor(1000 c0 n / (left right)) in whole decimals of 38 digits."""
    wide = "CAST({} AS DECIMAL(17, 0))".format
    return F.expr(f"(CAST(1000 AS DECIMAL(4, 0)) * {wide('c0')} * {wide('n')}) div ({wide(left)} * {wide(right)})")
