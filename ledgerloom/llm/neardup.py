"""MinHash near-dedup by a chosen-path set similarity join.

Documents are sets of word shingles.  A tree puts a set into a child for each
of a few minwise tokens chosen at the node; similar sets are likely to choose
the same path.  Nodes of at most ``leaf`` sets are compared exhaustively on
their sketches; larger ones branch again.  Independent trees repeat this until
a pair at the threshold is missed with a negligible chance.  What the sketches
find is confirmed on the full sets, and links become components.

Equal sets are one set throughout, so copies cost nothing.  A node's sets are
never listed as pairs: a first round links each to the first set that it
resembles, and a second looks at sets that still resemble one of another
component.  These meet with their full sets in the node, and only links that
join two components leave it.

Near copies of one text make a large node that branching can't part.  It is
dealt into small nodes twice, at random: what is one cluster becomes one
component in the first round, at two rows a set.  Only the sets outside the
node's largest component are then compared with all of it, so that no link is
lost; where there are none, nothing is left to compare.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .scratch import frugal, passing, small, small_batches, stored

SKETCH = 128
#: At depth 1 each tree chooses 1 or 2 tokens, 1.4 on average (the inverse of the threshold is 1.25), deeper nodes 2.
EXTRA_EVERY, DEEP_TOKENS = 3, 2
#: The chance that a pair at the threshold is parted in all trees at depth 1.
MISS = 1.5e-5
LEAF, DEPTH = 1000, 10
#: A large node whose sets agree in this share of places on average isn't branched: that wouldn't part them.
DENSE, DENSE_PLACES = 0.6, 64
#: Sketches may show so many standard deviations less than the threshold.
DEVIATIONS = 4.1
#: Bytes of full sets that meet in a node.
NODE_BYTES = 32 << 20

_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 32, SKETCH, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, SKETCH, dtype=np.uint32)
_STEP = (_RNG.integers(0, 1 << 63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles of a whole text, A-Z lower-cased.

    Words are what white space in ASCII separates.  Fewer words make one
    shingle, none make no shingle.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(n, size)
    value = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        value = value + (hashes[k : n - width + 1 + k] ^ _STEP[k]) * _STEP[63 - k]
    value ^= value >> np.uint64(29)
    value *= _STEP[32]
    return np.unique(value ^ (value >> np.uint64(32)))


def sketch(values: np.ndarray) -> np.ndarray:
    """SKETCH minwise values of a set that isn't empty."""
    low = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    short = (values >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(short), 2048):
        np.minimum(low, (short[start : start + 2048, None] * _A + _B).min(axis=0), out=low)
    return low


def set_id(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("rec_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))


def sign(keyed: DataFrame, size: int) -> DataFrame:
    """``rec_id, text_key, n, signs, cid, sketch, low`` for each row; ``cid`` stands for the set, null if it is empty.

    ``low`` has one byte of each minwise value of ``sketch``: enough to
    compare.  ``signs`` has one bit of each of the first DENSE_PLACES.
    """

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, signs, cid, full, low = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                values = shingles(text, size)
                own = sketch(values) if len(values) else None
                n.append(len(values))
                signs.append(0 if own is None else int(np.packbits((own[:DENSE_PLACES] & 1).astype(np.uint8)).view(np.int64)[0]))
                cid.append(None if own is None else set_id(values))
                full.append(None if own is None else own.tobytes())
                low.append(None if own is None else own.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (n, signs)), *(pa.array(x, pa.binary()) for x in (cid, full, low))], names=["rec_id", "text_key", "n", "signs", "cid", "sketch", "low"])

    schema = T.StructType([*keyed.schema.fields[:2], *(T.StructField(c, T.LongType()) for c in ("n", "signs")), *(T.StructField(c, T.BinaryType()) for c in ("cid", "sketch", "low"))])
    return keyed.mapInArrow(frugal(signed), schema)


def full_sets(keyed: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``cid, values`` (64-bit hashes, sorted) of the sets that ``wanted`` (``rec_id, text_key``) stand for."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, size) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(set_id, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cid", "values"])

    right = small(wanted.select(F.col("rec_id").alias("w_id"), F.col("text_key").alias("w_key")))
    on = [keyed["rec_id"].eqNullSafe(F.col("w_id")), keyed["text_key"] == F.col("w_key")]
    return keyed.join(right, on, "left_semi").select("text").mapInArrow(frugal(made), "cid binary, values binary").dropDuplicates(["cid"])


def _child(node: Column, position: Column) -> Column:
    """The node below ``node`` that a set gets to by its minwise token at ``position``."""
    return F.xxhash64(node, position, F.substring("sketch", position * 4 + 1, 4))


def _choose(node: Column, j: int) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(j)), F.lit(SKETCH)).cast("int")


def _dense(members: DataFrame, classes: DataFrame) -> DataFrame:
    """``node`` of those whose sets agree in DENSE of the places on average, each pair counted.

    A value takes a sign, so the square of a place's sum of signs estimates
    the number of its agreeing pairs: one row of sums a node and task.
    """
    sums = [F.sum(F.lit(1) - 2 * F.getbit("signs", F.lit(i))).cast("double").alias(f"s{i}") for i in range(DENSE_PLACES)]
    each = members.join(classes.select("cid", "signs"), "cid").groupBy("node", "n").agg(*sums)
    agree = sum((F.col(f"s{i}") * F.col(f"s{i}") for i in range(DENSE_PLACES)), F.lit(0.0))
    return each.filter(agree >= DENSE * DENSE_PLACES * F.col("n").cast("double") * F.col("n")).select("node")


def trees_for(percent: int) -> int:
    """The fewest trees whose paths all part a pair at the threshold with a chance of MISS at most."""
    paths = int(np.ceil(np.log(MISS) / np.log(1 - min(percent, 99) / 100)))
    return next(t for t in range(1, paths + 1) if t - (-t // EXTRA_EVERY) >= paths)


def least_agreeing(percent: int) -> int:
    """Places in which sketches have to agree."""
    share = percent / 100
    return int(np.ceil((share - DEVIATIONS * np.sqrt(share * (1 - share) / SKETCH)) * SKETCH))


def leaves(classes: DataFrame, trees: int, leaf: int = LEAF, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """``node, cid`` of all nodes with 2 to ``leaf`` sets, and ``node, cid, n`` of those that stay larger.

    Larger nodes branch, but for dense ones; what is still larger at the last
    depth stays, too.
    """
    roots = [(t, j) for t in range(trees) for j in range(2 if t % EXTRA_EVERY == 0 else 1)]
    first = F.explode(F.array(*(_child(F.lit(t), _choose(F.lit(t), j)) for t, j in roots)))
    nodes = classes.select("cid", first.alias("node"))
    done = left = None
    union = lambda a, b: b if a is None else a.union(b)
    for level in range(depth):
        nodes = stored(nodes, "path-nodes")
        sizes = stored(nodes.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"), "path-sizes")
        done = union(done, nodes.join(sizes.filter(F.col("n") <= leaf), "node").select("node", "cid"))
        large = sizes.filter(F.col("n") > leaf)
        members = nodes.join(large, "node").select("node", "cid", "n")
        if level + 1 == depth or not large.limit(1).count():
            return done, union(left, members)
        dense = stored(_dense(members, classes), "path-dense")
        left = union(left, members.join(dense, "node", "left_semi"))
        deeper = F.explode(F.array(*(_child(F.col("node"), _choose(F.col("node"), j)) for j in range(DEEP_TOKENS))))
        nodes = members.join(dense, "node", "left_anti").join(classes.select("cid", "sketch"), "cid").select("cid", deeper.alias("node")).distinct()
    return done, left


def dealt(large: DataFrame, leaf: int) -> DataFrame:
    """``node, cid``: each large node dealt twice into nodes of about half a leaf. A cluster's sets share nodes across the deals, so it comes out as one component."""
    blocks = F.ceil(F.col("n") * 2 / leaf)
    return large.select("cid", F.explode(F.array(*(F.xxhash64("node", F.lit(i), F.pmod(F.xxhash64("cid", F.lit(i)), blocks)) for i in range(2)))).alias("node")).select("node", "cid")


def against_largest(large: DataFrame, leaf: int) -> DataFrame:
    """``node, cid``: nodes in which the sets outside a large node's largest component meet all of its sets.

    ``large`` has the sets' ``label``.  Both sides are dealt into blocks of
    half a leaf.  A node of one component gives nothing.
    """
    counts = stored(large.groupBy("node", "label").agg(F.count("*").alias("own")), "path-labels")
    largest = counts.groupBy("node").agg(F.max(F.struct("own", "label")).alias("most"), F.sum("own").alias("n")).filter("n > most.own")
    largest = stored(largest.select("node", F.col("most.label").alias("main"), F.ceil((F.col("n") - F.col("most.own")) * 2 / leaf).alias("few"), F.ceil(F.col("n") * 2 / leaf).alias("all")), "path-largest")
    rows = large.select("node", "cid", "label").join(largest, "node")
    own = lambda blocks: F.pmod(F.xxhash64("cid"), F.col(blocks))
    each = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    others = rows.filter("label <> main").select("node", "cid", own("few").alias("a"), each("all").alias("b"))
    every = rows.select("node", "cid", each("few").alias("a"), own("all").alias("b"))
    return others.union(every).select(F.xxhash64("node", F.lit(2), "a", "b").alias("node"), "cid").distinct()


def by_set_bytes(members: DataFrame, classes: DataFrame) -> DataFrame:
    """``node, cid`` in nodes whose full sets take about NODE_BYTES at most; larger ones are cut in blocks, with a node for each two of them."""
    sized = stored(members.join(classes.select("cid", "n"), "cid"), "path-sized")
    heavy = sized.groupBy("node").agg(F.sum("n").alias("total")).select("node", F.ceil(F.col("total") * 8 * 2 / NODE_BYTES).alias("blocks")).filter("blocks > 2")
    cut = sized.select("node", "cid").join(small(stored(heavy, "path-heavy")), "node", "left").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    paired = cut.select("node", "cid", "own", other.alias("other"))
    return paired.select(F.when(F.col("own").isNull(), F.col("node")).otherwise(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))).alias("node"), "cid")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """The nodes of a partition that is sorted by node, each with its other columns."""
    last, held = None, []
    for batch in batches:
        for node, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if node != last and held:
                yield last, list(zip(*held))
                held = []
            last = node
            held.append(row)
    if held:
        yield last, list(zip(*held))


def _pairs(rows: list[tuple], names: tuple[str, str], kinds: tuple[pa.DataType, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([], [])
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))


def first_resembling(nodes: DataFrame, least: int) -> DataFrame:
    """Pairs ``a, b`` of sets in one node whose sketches agree in ``least`` places or more.

    A set that stands alone is paired with all that resemble it and stand
    alone too, and with the first of the others that does.  So each set that
    resembles any is in a pair, and a node gives no more than two for each.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, (ids, low) in _grouped(batches):
            rows = np.frombuffer(b"".join(low), np.uint8).reshape(len(ids), SKETCH)
            alone = np.ones(len(ids), bool)
            for i in range(len(ids)):
                if not alone[i]:
                    continue
                like = np.count_nonzero(rows == rows[i], axis=1) >= least
                like[i] = alone[i] = False
                out += [(ids[i], ids[j]) for j in np.flatnonzero(like & alone)]
                out += [(ids[j], ids[i]) for j in np.flatnonzero(like & ~alone)[:1]]
                alone &= ~like
            if len(out) >= 10_000:
                yield _pairs(out, ("a", "b"), (pa.binary(), pa.binary()))
                out = []
        yield _pairs(out, ("a", "b"), (pa.binary(), pa.binary()))

    ordered = nodes.select("node", "cid", "low").repartition("node").sortWithinPartitions("node", "cid")
    pairs = ordered.mapInArrow(frugal(found), "a binary, b binary")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def still_apart(nodes: DataFrame, least: int) -> DataFrame:
    """``node, cid`` of sets that resemble one of another ``label`` in their node."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, (ids, low, labels) in _grouped(batches):
            names = np.unique(np.array(labels, dtype=object), return_inverse=True)[1]
            if not names.any():
                continue
            rows = np.frombuffer(b"".join(low), np.uint8).reshape(len(ids), SKETCH)
            open_ = np.zeros(len(ids), bool)
            for i in range(len(ids) - 1):
                other = np.flatnonzero(names[i + 1 :] != names[i]) + i + 1
                like = other[np.count_nonzero(rows[other] == rows[i], axis=1) >= least]
                if len(like):
                    open_[i] = open_[like] = True
            if open_.any():
                yield _pairs([(node, ids[i]) for i in np.flatnonzero(open_)], ("node", "cid"), (pa.int64(), pa.binary()))

    ordered = nodes.select("node", "cid", "low", "label").repartition("node").sortWithinPartitions("node", "cid")
    return ordered.mapInArrow(frugal(found), "node long, cid binary")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of presence matrices; values of one set alone are left out."""
    values, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = np.cumsum(times > 1) - 1
    keep = times[inverse] > 1
    owner, column = owner[keep], shared[inverse[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int((times > 1).sum()), 4096):
        low, high = np.searchsorted(column, (start, start + 4096))
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[low:high], column[low:high] - start] = 1
        total += part @ part.T
    return total.astype(np.int64)


def links_in_nodes(nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of sets at the threshold, as many for each node as join its components (``label``) to fewer."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (ids, labels, values) in _grouped(batches):
            sets = [np.frombuffer(v, np.uint64) for v in values]
            size = np.array([len(s) for s in sets])
            common = intersections(sets)
            link = 100 * common >= percent * (size[:, None] + size - common)
            root = np.unique(np.array(labels, dtype=object), return_inverse=True)[1]
            out = []
            for i in range(len(ids)):
                for j in np.flatnonzero(link[i] & (root != root[i])):
                    if root[j] != root[i]:
                        out.append((ids[i], ids[j]))
                        root[root == root[j]] = root[i]
            if out:
                yield _pairs(out, ("a", "b"), (pa.binary(), pa.binary()))

    ordered = nodes.select("node", "cid", "label", "values").repartition("node").sortWithinPartitions("node", "cid")
    return ordered.mapInArrow(frugal(found), "a binary, b binary").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` with ``100 * intersection >= percent * union`` on the full sets."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                least, most = sorted((len(x), len(y)))
                ok = 100 * least >= percent * most
                if ok:
                    both = np.concatenate((x, y))
                    both.sort(kind="stable")  # two sorted runs
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    ok = 100 * common >= percent * (len(both) - common)
                keep.append(ok)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = sets.select(F.col("cid").alias("b"), F.col("values").alias("y")), sets.select(F.col("cid").alias("a"), F.col("values").alias("x"))
    return pairs.join(one, "b").join(two, "a").select("a", "b", "x", "y").mapInArrow(frugal(checked), "a binary, b binary")


def near_duplicates(
    df: DataFrame,
    size: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    trees: int | None = None,
    leaf: int = LEAF,
    choose: bool = False,
) -> DataFrame:
    """Near-duplicate components, a row for each row of ``df``.

    Returns ``id_col, text_key`` (the text's xxhash64), ``n_shingles`` (size of the set of ``size``-word shingles),
    ``component_id`` (the smallest id reachable over links of similarity
    ``percent`` or more) and ``kept`` (it is that id).  Null, empty and
    wordless texts have no shingles, are linked with nothing and are kept; a
    text of fewer words is one shingle.  Rows without an id link as others do,
    but don't name a component; one is kept only where the component has no
    id.  Repeated rows share a component, and those that bear its id are all
    kept.  An empty table gives an empty result.

    With ``choose`` there is also ``chosen``: the row has the component's first
    (id, text hash), null ids last.  One such pair is chosen in each component,
    whatever ids repeat or lack, and all rows without shingles are.
    """
    small_batches(df.sparkSession)
    with passing(df.sparkSession) as keep:
        named, ids = map(keep, _labelled(_keyed(df, id_col, text_col), size, percent, trees or trees_for(percent), leaf, choose))
    out = named.join(ids, "label", "left").withColumn("component_id", F.when(F.col("label").isNull(), F.col("rec_id")).otherwise(F.col("component_id")))
    kept = F.coalesce(F.col("rec_id") == F.col("component_id"), F.col("component_id").isNull())
    chosen = [(F.col("label").isNull() | (F.col("rec_id").eqNullSafe(F.col("rep.rec_id")) & (F.col("text_key") == F.col("rep.text_key")))).alias("chosen")] if choose else []
    return out.select(F.col("rec_id").alias(id_col), "text_key", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), *chosen)


def _labelled(keyed: DataFrame, size: int, percent: int, trees: int, leaf: int, choose: bool) -> tuple[DataFrame, DataFrame]:
    """``rec_id, text_key, n, label`` of each row, and ``label, component_id`` (and ``rep``) of each component."""
    signed = stored(sign(keyed, size), "dup-signed")
    classes = signed.filter("n > 0").groupBy("cid").agg(F.min(F.struct("rec_id", "text_key")).alias("rep"), *(F.any_value(c).alias(c) for c in ("n", "sketch", "low", "signs")))
    classes = stored(classes, "dup-classes")
    lows = classes.select("cid", "low")
    fine, large = (stored(x, "dup-leaves") for x in leaves(classes, trees, leaf))
    nodes = stored(fine.union(dealt(large, leaf)).join(lows, "cid"), "dup-nodes")
    least = least_agreeing(percent)

    first = stored(first_resembling(nodes, least), "dup-first")
    wanted = first.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(classes, "cid").select("rep.*")
    sets = stored(full_sets(keyed, stored(wanted, "dup-wanted"), size), "dup-sets")
    links = stored(confirmed(first, sets, percent), "dup-links")
    labels = components(links).withColumnRenamed("node", "cid")

    label = F.coalesce("label", "cid").alias("label")
    tagged = lambda rows: rows.join(labels, "cid", "left").select(*rows.columns, label)
    second = fine.union(against_largest(stored(tagged(large), "dup-large"), leaf))
    apart = stored(still_apart(tagged(second.join(lows, "cid")), least), "dup-apart")
    lacking = stored(apart.select("cid").distinct().join(sets.select("cid"), "cid", "left_anti").join(classes, "cid").select("rep.*"), "dup-lacking")
    if lacking.limit(1).count():  # what resembled nothing in the first round
        sets = sets.union(stored(full_sets(keyed, lacking, size), "dup-sets"))
    meeting = tagged(by_set_bytes(apart, classes)).join(sets, "cid")
    more = stored(links_in_nodes(meeting, percent), "dup-more")
    if more.limit(1).count():
        labels = components(links.union(more)).withColumnRenamed("node", "cid")

    named = stored(signed.join(labels, "cid", "left").select("rec_id", "text_key", "n", label), "dup-named")
    # Stored, so that the join's other side is no aggregate and a hot component can be split.
    least_of = [F.min("rec_id").alias("component_id"), *([F.min(F.struct(F.col("rec_id").isNull().alias("none"), "rec_id", "text_key")).alias("rep")] if choose else [])]
    return named, stored(named.filter(F.col("label").isNotNull()).groupBy("label").agg(*least_of), "dup-ids")
