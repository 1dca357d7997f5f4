"""Benchmark decontamination with a distributed positional inverted index.

The index holds the postings ``(term, document, position)`` of training
tokens.  A test item is looked up by the rarest terms of each of its windows:
their postings, shifted by the term's place in the item, are intersected, and
what all of a window's rarest terms agree on is compared word by word.  All of
it is DataFrame operations; text never leaves the JVM.

Texts are cut into words once, in a stored table.  A window carries its own
words, never its item's, so work grows with the words of items and documents
and not with the square of a long one.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import passing, small, stored

WINDOW = 13
#: Terms of a window whose lists are intersected.
RAREST = 3

_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; null for null. ASCII texts take the cheaper way to lower case."""
    ascii_only = F.octet_length(text) == F.length(text)
    lower = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(lower, _NO_WORD), "")


def word_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``rec_id, text_key, words`` of each row: rows with one id and different texts stay apart. A null text has null words."""
    return docs.select(F.col(id_col).alias("rec_id"), F.xxhash64(text_col).alias("text_key"), words(F.col(text_col)).alias("words"))


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_key, item_id, n_words, at, term``: the words of each item that has any."""
    own = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("words")).filter(F.size("words") > 0).distinct()
    return own.select(F.xxhash64("item_id", "words").alias("item_key"), "item_id", F.size("words").alias("n_words"), F.posexplode("words").alias("at", "term"))


def term_counts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, n``: how often each of ``terms`` stands in all documents (of :func:`word_table`)."""
    every = texts.select(F.explode("words").alias("term"))
    few = small(terms)
    if few is terms:  # too many to broadcast: count first, so that a frequent word is one row a task
        return every.groupBy("term").agg(F.count("*").alias("n")).join(terms, "term", "left_semi")
    return every.join(few, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def rarest_terms(terms: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """``item_key, item_id, start, length, needs, phrase`` of each window: its words, and the places in the item of the rarest of them.

    A window is ``window`` consecutive words, or all of an item that has
    fewer.  Those with a word that no document has can't occur and are left
    out.
    """
    ahead = W.partitionBy("item_key").orderBy("at").rowsBetween(0, window - 1)
    known = terms.join(small(counts), "term", "left")
    windows = known.withColumn("own", F.collect_list(F.struct("n", "at", "term")).over(ahead)).filter(F.col("at") <= F.greatest(F.col("n_words") - window, F.lit(0)))
    rarest = F.slice(F.array_sort("own"), 1, RAREST)
    return windows.filter(F.forall("own", lambda w: w["n"].isNotNull())).select(
        "item_key", "item_id", F.col("at").alias("start"), F.size("own").alias("length"), F.transform(rarest, lambda w: w["at"]).alias("needs"), F.col("own.term").alias("phrase")
    )


def build_index(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of ``terms`` in ``texts`` (of :func:`word_table`): ``term, rec_id, text_key, at``."""
    postings = texts.select("rec_id", "text_key", F.posexplode("words").alias("at", "term"))
    return postings.join(small(terms), "term", "left_semi").select("term", "rec_id", "text_key", "at")


def candidates(index: DataFrame, windows: DataFrame, slop: int) -> DataFrame:
    """``rec_id, text_key, item_key, shift, start``: windows all of whose rarest terms agree on one shift.

    Lists are intersected item by item first: a term's posting gives its shift
    against the item once, whatever the number of windows that need it.  Only
    shifts on which as many terms agree as a window needs are then looked at
    window by window.
    """
    needed = windows.select("item_key", "start", F.size("needs").alias("n_needs"), F.posexplode("needs").alias("_", "item_at"), "phrase")
    anchors = needed.groupBy("item_key", "item_at", F.get("phrase", F.col("item_at") - F.col("start")).alias("term"))
    anchors = stored(anchors.agg(F.min("n_needs").alias("least"), F.collect_list(F.struct("start", "n_needs")).alias("starts")), "decontam-anchors")  # a window's words at most

    shift = F.col("at") - F.col("item_at")
    aligned = index.join(small(anchors.select("term", "item_key", "item_at", "least")), "term")
    aligned = aligned.withColumn("shift", F.explode(F.sequence(shift - slop, shift + slop)) if slop else shift)
    agreed = aligned.groupBy("rec_id", "text_key", "item_key", "shift").agg(F.collect_set("item_at").alias("met"), F.min("least").alias("least")).filter(F.size("met") >= F.col("least"))
    met = stored(agreed.select("rec_id", "text_key", "item_key", "shift", F.explode("met").alias("item_at")), "decontam-met")
    at_starts = met.join(small(anchors.select("item_key", "item_at", "starts")), ["item_key", "item_at"]).select("rec_id", "text_key", "item_key", "shift", F.explode("starts").alias("s"))
    return at_starts.groupBy("rec_id", "text_key", "item_key", "shift", "s.start", "s.n_needs").agg(F.count("*").alias("n")).filter("n = n_needs").drop("n", "n_needs")


def matches(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    slop: int = 0,
    id_col: str = "doc_id",
    item_id_col: str = "item_id",
    text_col: str = "text",
) -> DataFrame:
    """Where windows of ``items`` stand in ``docs``.

    Returns ``rec_id, text_key, item_id, exact, places``: the document's word
    positions inside matching windows of one item at one alignment.  With
    ``slop`` 0 these are exact phrases; otherwise each word of a window may
    stand up to ``slop`` words off its place (``exact`` tells whether none
    does).  Null and empty texts have no words and match nothing; an item of
    fewer than ``window`` words is one window.
    """
    return _matches(stored(word_table(docs, id_col, text_col), "decontam-words"), items, window, slop, item_id_col, text_col)


def _matches(texts: DataFrame, items: DataFrame, window: int, slop: int, item_id_col: str, text_col: str) -> DataFrame:
    """:func:`matches` in ``texts`` of :func:`word_table`."""
    terms = stored(item_terms(items, item_id_col, text_col), "decontam-terms")
    counts = stored(term_counts(texts, terms.select("term").distinct()), "decontam-counts")
    windows = stored(rarest_terms(terms, counts, window), "decontam-windows")
    rare = windows.select(F.explode(F.transform("needs", lambda at: F.get("phrase", at - F.col("start")))).alias("term")).distinct()
    index = stored(build_index(texts, rare), "decontam-index")
    found = candidates(index, windows, slop).join(small(windows.select("item_key", "item_id", "start", "length", "phrase")), ["item_key", "start"])
    begin = F.col("shift") + F.col("start")
    found = stored(found.withColumn("begin", begin).filter((begin >= 0) if not slop else (begin >= -slop)), "decontam-candidates")

    # A document's words come once, and leave in pieces of the windows' lengths.
    spans = found.groupBy(F.col("rec_id").alias("hit_id"), F.col("text_key").alias("hit_key")).agg(F.collect_set(F.struct("begin", "length")).alias("spans"))
    spans = stored(spans, "decontam-spans")
    with_words = texts.join(small(spans), [texts["rec_id"].eqNullSafe(spans["hit_id"]), texts["text_key"] == spans["hit_key"]])

    def piece(s: Column) -> Column:
        low = F.greatest(s["begin"] - slop, F.lit(0))
        own = F.slice("words", low + 1, F.greatest(s["begin"] + s["length"] + slop - low, F.lit(0)))
        return F.struct(s["begin"].alias("begin"), s["length"].alias("length"), own.alias("piece"))

    pieces = with_words.select("hit_id", "hit_key", F.size("words").alias("n_words"), F.explode(F.transform("spans", piece)).alias("p")).select("hit_id", "hit_key", "n_words", "p.*")
    pieces = pieces.withColumnsRenamed({"begin": "p_begin", "length": "p_length"})
    on = [found["rec_id"].eqNullSafe(pieces["hit_id"]), found["text_key"] == pieces["hit_key"], found["begin"] == pieces["p_begin"], found["length"] == pieces["p_length"]]
    both = found.join(pieces, on)

    low = F.greatest(F.col("begin") - slop, F.lit(0))
    same = F.slice("piece", F.col("begin") - low + 1, F.col("length")) == F.col("phrase") if not slop else (F.col("begin") >= 0) & (F.slice("piece", F.greatest(F.col("begin") - low, F.lit(0)) + 1, F.col("length")) == F.col("phrase"))

    def there(i: Column) -> Column:
        at = F.greatest(F.col("begin") + i - slop, F.lit(0))
        width = F.greatest(F.col("begin") + i + slop + 1 - at, F.lit(0))
        return F.array_contains(F.slice("piece", at - low + 1, width), F.get("phrase", i))

    near = F.forall(F.sequence(F.lit(0), F.col("length") - 1), there)
    held = both.filter(near if slop else same).withColumn("same", same).groupBy("rec_id", "text_key", "item_key", "item_id", "shift", "n_words")
    inside = F.array_distinct(F.flatten(F.transform("begins", lambda b: F.sequence(b["begin"], b["begin"] + b["length"] - 1))))
    return held.agg(F.every("same").alias("exact"), F.collect_set(F.struct("begin", "length")).alias("begins")).select(
        "rec_id", "text_key", "item_id", "exact", F.filter(inside, lambda p: (p >= 0) & (p < F.col("n_words"))).alias("places")
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    share: int = 20,
    id_col: str = "doc_id",
    item_id_col: str = "item_id",
    text_col: str = "text",
) -> DataFrame:
    """How much of each document stands in ``items``, for every row of ``docs``.

    Returns ``id_col, text_key`` (the text's xxhash64), ``n_words, n_hit`` (words inside occurring windows),
    ``n_items`` (items with such windows), ``items_sha256`` (of their ids,
    sorted as text and joined by commas; of the empty text if there are none)
    and ``contaminated`` (hit, and ``share * n_hit >= n_words``).  Null and
    empty texts have no words.  Repeated rows each get their row; rows that
    share an id but not a text are told apart.  A null item id counts in
    ``n_hit`` only.  Without documents the result is empty, without items
    nothing is hit.
    """
    with passing(docs.sparkSession) as keep:
        texts = keep(stored(word_table(docs, id_col, text_col), "decontam-words"))
        found = (
            _matches(texts, items, window, 0, item_id_col, text_col)
            .groupBy(F.col("rec_id").alias("hit_id"), F.col("text_key").alias("hit_key"))
            .agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_hit"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
        )
        found = keep(stored(found, "decontam-found"))
    rows = texts.select("rec_id", "text_key", F.coalesce(F.size("words"), F.lit(0)).cast("long").alias("n_words"))
    n_words = F.greatest(F.col("n_words"), F.lit(0))
    joined = rows.join(small(found), [rows["rec_id"].eqNullSafe(found["hit_id"]), rows["text_key"] == found["hit_key"]], "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0)), F.coalesce("ids", F.array().cast("array<string>"))
    return joined.select(
        F.col("rec_id").alias(id_col),
        "text_key",
        n_words.alias("n_words"),
        n_hit.cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= n_words)).alias("contaminated"),
    )
