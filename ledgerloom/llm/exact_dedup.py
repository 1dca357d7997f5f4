"""Exact duplicates by deterministic block naming.

Texts are cut into blocks of fixed size.  Equal blocks get one integer name by
sorting them, then adjacent pairs of names are named in the same way, until
each text has a single name: two texts of as many rounds are equal if and only
if their names are.  Hashes only deal rows to sorts; no name depends on two
different texts having different hashes.

All in DataFrame functions.  A block travels once, to the sort that names it; what
occurs often is named from its distinct values before and travels without its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import passing, small, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a block.
BLOCK_BYTES = 4096
#: Keys with a hash that occurs more often are named from their distinct values.
OFTEN = 256
#: About so many keys are sorted as one bucket; a name is a bucket's number times PLACES, and a place in it.
BUCKET_ROWS, PLACES = 200, 1 << 32


def fold_case(text: Column) -> Column:
    """A-Z in lower case, nothing else changed; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _placed(rows: DataFrame, key: str, bucket: Column) -> DataFrame:
    """``rows`` with ``name``: the bucket, and the key's place among the distinct keys sorted in it."""
    inside = W.partitionBy("_bucket").orderBy(key)
    return rows.withColumn("_bucket", bucket).withColumn("name", F.col("_bucket") * PLACES + F.dense_rank().over(inside)).drop("_bucket")


def named(rows: DataFrame, key: str, spread: str) -> DataFrame:
    """``rows`` with a whole number ``name`` in place of ``key``: equal keys have equal names, and no others have.

    ``spread`` is a column that deals rows evenly.  Names are never 0.
    """
    hashed = rows.withColumn("_hash", F.xxhash64(key))
    counts = stored(hashed.groupBy("_hash").count(), "block-counts")
    total, most = counts.agg(F.sum("count"), F.max("count")).first()
    buckets = F.lit(max(1, (total or 0) // BUCKET_ROWS)).cast("long")
    own = F.pmod("_hash", buckets)
    if (most or 0) <= OFTEN:
        return _placed(hashed, key, own).drop("_hash", key)
    often = small(stored(counts.filter(F.col("count") > OFTEN).select("_hash"), "blocks-often"))
    distinct = hashed.join(often, "_hash", "left_semi").groupBy("_hash", F.col(key).alias("_often_key")).agg(F.lit(1))
    first = stored(_placed(distinct, "_often_key", own).select(F.col("_hash").alias("_often_hash"), "_often_key", (-F.col("name")).alias("_often_name")), "blocks-named")
    joined = hashed.join(small(first), (F.col("_hash") == F.col("_often_hash")) & (F.col(key) == F.col("_often_key")), "left")
    known = F.col("_often_name").isNotNull()
    rest = joined.withColumn(key, F.when(~known, F.col(key))).drop("_often_key", "_often_hash")
    placed = _placed(rest, key, F.when(known, F.pmod(F.xxhash64(spread), buckets)).otherwise(own))
    return placed.withColumn("name", F.coalesce("_often_name", "name")).drop("_often_name", "_hash", key)


def blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """``row, id, sha, n, pos, block`` for each block of each row; an empty text is one empty block.

    ``row`` numbers the rows, repeated ones too.
    """
    one = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), fold_case(F.col(text_col)).cast("binary").alias("text"))
    size = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / block_bytes)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.col("text").substr(i * block_bytes + 1, F.lit(block_bytes)))
    spread = one.select("row", "id", F.sha2("text", 256).alias("sha"), size.alias("n"), F.posexplode(cut).alias("pos", "block"))
    return spread.withColumn("sha", F.when(F.col("pos") == 0, F.col("sha")))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row, id, sha, level, name``: texts equal but for the case of A-Z share ``level`` and ``name``, others don't.

    Rows are numbered as they are scanned, so a table whose order changes when
    it is computed again should be stored first.
    """
    bottom = stored(named(blocks(docs, id_col, text_col, block_bytes), "block", "row"), "names-0")
    lone = bottom.filter("n = 1").select("row", "id", "sha", F.lit(0).alias("level"), "name")
    longest = bottom.agg(F.max("n")).first()[0] or 0
    heads = bottom.filter("n > 1 AND pos = 0").select("row", "id", "sha")
    whole, current, level = [lone], bottom.filter("n > 1").select("row", "n", "pos", "name"), 0
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = current.groupBy("row", "n", F.expr("pos div 2").cast("int").alias("at")).agg(F.struct(side(0).alias("left"), F.coalesce(side(1), F.lit(0)).alias("right")).alias("pair"))
        pairs = pairs.select("row", F.expr("(n + 1) div 2").cast("int").alias("n"), F.col("at").alias("pos"), "pair")
        above = stored(named(pairs, "pair", "row"), f"names-{level}")
        whole.append(above.filter("n = 1").select("row", F.lit(level).alias("level"), "name").join(heads, "row").select("row", "id", "sha", "level", "name"))
        current = above.filter("n > 1")
    found = whole[0]
    for part in whole[1:]:
        found = found.union(part)
    return found


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: ``id_col, keep_id, group_size, kept, text_sha256``; only A-Z are compared without case.

    Of a group of equal texts the row with the largest id stays; a null id is
    smaller than any other, and of rows that share the largest id one stays.
    ``keep_id`` is that id.  Null texts are empty ones, and these equal each
    other.  Other columns aren't read.  An empty table gives an empty result.
    """
    with passing(docs.sparkSession) as keep:
        found = keep(stored(identities(docs, id_col, text_col, block_bytes), "identities"))
        groups = found.groupBy(F.col("level").alias("_level"), F.col("name").alias("_name")).agg(F.max(F.struct("id", "row")).alias("best"), F.count("*").alias("size"))
        groups = keep(stored(groups.filter("size > 1"), "copies"))
    joined = found.join(small(groups), (F.col("level") == F.col("_level")) & (F.col("name") == F.col("_name")), "left")
    best = F.coalesce("best", F.struct("id", "row"))
    return joined.select(
        F.col("id").alias(id_col), best["id"].alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (best["row"] == F.col("row")).alias("kept"), F.col("sha").alias("text_sha256"),
    )
