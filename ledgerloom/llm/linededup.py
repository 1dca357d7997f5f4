"""Line dedup by a deletion-neighbourhood join.

A line with a word goes if an earlier one equals it, whatever its length, or
if it has ``NEAR_CHARS`` characters and an earlier one is one character edit
away.  Blank lines stay.  Equal lines meet by their hash.  For the others,
each line emits its deletion variants as hashed keys; lines with one variant
in common are compared.

A pair within one edit agrees outside a short stretch, so the variants are
emitted for that stretch only, under a key of all that surrounds it:

1. Lines cut in ``HALVES`` parts share all but one part.  This finds the few
   lines that may have a partner, by hashes alone.
2. Those lines, cut in ``PARTS`` parts, emit for each part the hash of the
   rest.  Lines that share one get to step 3 with that part.
3. A part of more than ``PIECE`` characters is cut in ``PARTS`` again, under the
   key that it has, until those that lines still share are short.  So work is
   linear in a line's length.
4. The part's deletion variants are emitted.  Equal variants give the
   earliest line that shares each, never a list of a group's lines, and the
   edit distance is verified on the whole lines.

All of it is DataFrame operations.  What is grouped is stored before it is
joined, so that neither side of a join is an aggregate and Spark can split the
rows of a line, or of a variant, that a large share of them has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import passing, small, stored

#: One edit makes another word of a shorter line; those are compared for equality only.
NEAR_CHARS = 20
HALVES, PARTS = 2, 8
#: Characters of a part whose deletion variants are emitted; longer ones are cut again.
PIECE = 64


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("rec_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))


def _lines(keyed: DataFrame) -> DataFrame:
    """``rec_id, text_key, line_no, line``: every line of every text."""
    return keyed.select("rec_id", "text_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _hashes(line: Column) -> list[Column]:
    """Two independent hashes, 128 bits, that stand for a line."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def _around(line: Column, size: Column, target: Column, part: Column, parts: int, more: list[Column]) -> tuple[Column, ...]:
    """Key of what surrounds one part, the part, its target length, and the characters before and after it.

    ``target`` is ``size`` or one less: what stands before the part is counted
    from the left and what follows it from the right, so that a line and the
    same line with one character more in that part have the same key.
    """
    begin, end = (part * target / parts).cast("int"), ((part + 1) * target / parts).cast("int")
    after = target - end
    key = F.xxhash64(*more, target, part, F.left(line, begin), F.right(line, after))
    return key, F.substring(line, begin + 1, size - after - begin), end - begin, begin, after


def _half_keys(line: Column) -> list[Column]:
    size = F.length(line)
    return [_around(line, size, size - short, F.lit(k), HALVES, [F.lit(0)])[0].alias(f"k{short}{k}") for short in (0, 1) for k in range(HALVES)]


def _windows(lines: DataFrame) -> DataFrame:
    """For each line and part: ``near`` (the key of the rest), ``part`` (its text), ``longer`` (it has one character more than the target), and how much stands ``before`` and ``after`` it."""
    size = F.length("line")

    def one(x: Column) -> Column:
        short, k = (x >= PARTS).cast("int"), x % PARTS
        near, part, target, before, after = _around(F.col("line"), size, size - short, k, PARTS, [F.lit(1)])
        return F.struct(near.alias("near"), part.alias("part"), (F.length(part) > target).alias("longer"), before.alias("before"), after.alias("after"))

    return lines.select("h1", "occ", F.explode(F.transform(F.sequence(F.lit(0), F.lit(2 * PARTS - 1)), one)).alias("w")).select("h1", "occ", "w.*")


def _finer(windows: DataFrame) -> DataFrame:
    """The windows of each window's part: what surrounds a smaller part, under the key of what surrounds the whole one."""
    size = F.length("part")

    def one(k: Column) -> Column:
        near, part, target, before, after = _around(F.col("part"), size, size - F.col("longer").cast("int"), k, PARTS, [F.col("near")])
        return F.struct(near.alias("near"), part.alias("part"), (F.length(part) > target).alias("longer"), (F.col("before") + before).alias("before"), (F.col("after") + after).alias("after"))

    return windows.select("h1", "occ", F.explode(F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), one)).alias("w")).select("h1", "occ", "w.*")


def _shared(windows: DataFrame) -> DataFrame:
    """Of stored ``windows`` those whose surroundings two lines have, one of them the shorter or equal one."""
    shared = windows.groupBy("near").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.min("longer").alias("all_longer")).filter((F.col("a") != F.col("b")) & ~F.col("all_longer"))
    return windows.join(stored(shared.select("near"), "lines-near"), "near")


def _variants(windows: DataFrame) -> DataFrame:
    """``variant, swap`` for each window: the hashed deletion neighbourhood.

    Two parts of equal length are a substitution apart if they agree after the
    character at the same place is deleted from both (``swap``).  A longer one
    is an insertion away from a shorter one if deleting a character makes them
    equal.
    """
    part, size = F.col("part"), F.length("part")
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    without: Callable[[Column], Column] = lambda i: F.concat(F.left(part, i), F.right(part, size - i - 1))
    row = lambda key, swap: F.struct(key.alias("variant"), F.lit(swap).alias("swap"))
    swaps = F.transform(places, lambda i: row(F.xxhash64("near", F.lit(2), i, without(i)), True))
    cuts = F.transform(places, lambda i: row(F.xxhash64("near", F.lit(3), without(i)), False))
    whole = F.array(row(F.xxhash64("near", F.lit(3), part), False))
    emitted = F.when(F.col("longer"), F.array_distinct(cuts)).otherwise(F.concat(swaps, whole))
    own = ["occ", "part", "longer", "before", "after"]
    return windows.select(*own, F.explode(emitted).alias("v")).select(*own, "v.*")


def near_dropped(lines: DataFrame) -> DataFrame:
    """``occ`` of those of the distinct ``lines`` (``h1, occ, line``) that have an earlier one at one edit."""
    windows = stored(_windows(lines), "lines-windows")
    longest = windows.agg(F.max(F.length("part"))).first()[0] or 0
    chosen = _shared(windows)
    short = chosen.filter(F.length("part") <= PIECE)
    while longest > PIECE:
        longest = longest // PARTS + 2
        chosen = _shared(stored(_finer(chosen.filter(F.length("part") > PIECE)), "lines-finer"))
        short = short.union(chosen.filter(F.length("part") <= PIECE).select(short.columns))
    variants = stored(_variants(short), "lines-variants")
    first = lambda longer: F.min(F.when(F.col("longer") == longer, F.struct("occ", "part")))
    groups = stored(variants.groupBy("variant").agg(first(False).alias("short_one"), first(True).alias("long_one")), "lines-groups")
    partner = F.when(F.col("swap") | F.col("longer"), F.col("short_one")).otherwise(F.col("long_one"))
    found = (
        variants.join(groups, "variant")
        .withColumn("partner", partner)
        .filter(F.col("partner.occ") < F.col("occ"))
        .filter(F.levenshtein(F.col("part"), F.col("partner.part"), 1).between(0, 1))
        .select("occ", F.col("partner.occ").alias("earlier"), "before", "after")
        .distinct()
    )
    whole = found.join(lines.select("occ", "line"), "occ").join(lines.select(F.col("occ").alias("earlier"), F.col("line").alias("other")), "earlier")
    inner = lambda c: F.substring(c, F.col("before") + 1, F.length(c) - F.col("before") - F.col("after"))  # noqa: E731  at most PIECE characters and one
    same = (F.left("line", F.col("before")) == F.left("other", F.col("before"))) & (F.right("line", F.col("after")) == F.right("other", F.col("after")))
    return whole.filter(same & F.levenshtein(inner("line"), inner("other"), 1).between(0, 1)).select("occ").distinct()


def dropped_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_chars: int = NEAR_CHARS) -> DataFrame:
    """``rec_id, text_key, line_no`` of each line that an earlier line equals or nearly equals.

    Earlier means a smaller (id, hash of the text, line number), null ids
    first.  Exact repeats go at any length; lines of ``near_chars`` characters
    or more also go for an earlier one of as many that is one edit away.
    Lines of white space are never dropped.  Rows equal in id and text are one
    row here.
    """
    keyed = _keyed(df, id_col, text_col)
    occ = F.struct("rec_id", "text_key", "line_no")
    long_enough = F.length("line") >= near_chars
    worded = _lines(keyed).filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    halves = F.when(long_enough, F.array(*_half_keys(F.col("line")))).alias("halves")
    seen = stored(worded.select("rec_id", "text_key", "line_no", *_hashes(F.col("line")), halves), "lines-seen")

    first = seen.groupBy("h1", "h2").agg(F.min(occ).alias("first"), F.count("*").alias("n")).filter("n > 1").select("h1", "h2", "first")
    repeats = seen.select("h1", "h2", occ.alias("occ")).join(stored(first, "lines-first"), ["h1", "h2"]).filter(F.col("occ") > F.col("first")).select("occ")

    keys = seen.select("h1", F.explode("halves").alias("k"))
    shared = keys.groupBy("k").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a != b").select("k")
    maybe = stored(keys.join(stored(shared, "lines-shared"), "k").select("h1").distinct(), "lines-maybe")
    texts = worded.filter(long_enough).withColumn("h1", F.xxhash64("line")).join(small(maybe), "h1")
    distinct = texts.groupBy("h1", F.xxhash64(F.lit(1), "line").alias("h2")).agg(F.min(occ).alias("occ"), F.any_value("line").alias("line"))
    near = near_dropped(stored(distinct.select("h1", "occ", "line"), "lines-distinct"))
    return repeats.union(near).select("occ.*").distinct()


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_chars: int = NEAR_CHARS) -> DataFrame:
    """Each row of ``df``, all columns, with ``kept_text, n_lines, n_dropped``.

    ``kept_text`` joins the lines that stay by newlines; it is null for a null
    text (0 lines) and empty if no line stays.  An empty text is one blank line,
    which stays.  A line with an earlier one within one edit goes even if that
    earlier one goes too.  Repeated rows share one fate.  An empty table gives
    an empty result.  Columns of ``df`` with these three names are replaced.
    """
    with passing(df.sparkSession) as keep:
        lost = dropped_lines(df, id_col, text_col, near_chars).groupBy(F.col("rec_id").alias("_lost_id"), F.col("text_key").alias("_lost_key"))
        lost = keep(stored(lost.agg(F.collect_set("line_no").alias("_lost")), "lines-dropped"))
    rows = df.withColumn("_text_key", F.xxhash64(text_col))
    on = [rows[id_col].eqNullSafe(lost["_lost_id"]), rows["_text_key"] == lost["_lost_key"]]
    joined = rows.join(small(lost), on, "left")
    lines = F.split(text_col, "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_lost"), lambda i: F.get(lines, i))
    return joined.withColumns(
        {
            "kept_text": F.when(F.col("_lost").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")),
            "n_lines": F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"),
            "n_dropped": F.when(F.col("_lost").isNull(), F.lit(0)).otherwise(F.size("_lost")).cast("long"),
        }
    ).drop("_text_key", "_lost_id", "_lost_key", "_lost")
