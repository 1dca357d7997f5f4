"""The queries of the corpus operators, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontam, exact_dedup, hard_negatives, langid, linededup, neardup, quality, sentencepiece_fst, sharding, suffix_dedup, token_counts, warc
from .scratch import new_folder

PIECE_MODEL = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=4).drop("text_key")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepiece_fst.encode(table(spark, sf_dir, "documents"), piece_model_path(), check="round_trip")
    return encoded.select("doc_id", F.coalesce(F.size("token_ids"), F.lit(0)).cast("long").alias("n_tokens"), "token_ids", "round_trip")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = "date_format(timestampadd(SECOND, page_id, TIMESTAMP_NTZ'2024-01-01 00:00:00'), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    path = new_folder(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages").withColumn("captured_at", F.expr(day)), path)
    read = warc.read_warc(spark, path, payloads=False)
    captures = read.select("run", warc.url_key(F.col("url")).alias("url_key"), "date", F.col("record_id").cast("long").alias("id"), "record_type", F.col("refers_to").cast("long").alias("refers_to"), "payload_digest", "payload_bytes")
    return warc.capture_index(captures).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "history_rank")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.octet_length("kept").cast("long").alias("kept_bytes"), (F.size("spans") > 0).alias("has_repeats"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), map_path=new_folder(spark, "slot-map"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), piece_model_path())


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn_from(docs)
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    shifted = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(shifted, F.col("vec_id") % 100 == 0)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_warc": op3_warc,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_sharding": op6_sharding,
    "op7_token_counts": op7_token_counts,
    "op8_decontamination": op8_decontamination,
    "op9_line_dedup": op9_line_dedup,
    "op10_language_id": op10_language_id,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_collocations": op13_collocations,
}

#: Every window of every item against every stretch of as many document words.
OP8_SQL = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS l, array_to_string(w[s + 1 : s + least(len(w), 13)], ' ') AS k
  FROM item, range(0, 100000) r(s) WHERE len(w) > 0 AND s <= greatest(len(w) - 13, 0)
), doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), place AS (
  SELECT doc_id, w, unnest(range(0, len(w))) AS p FROM doc
), hit AS (
  SELECT a.doc_id, a.p, win.item_id, win.l
  FROM (SELECT doc_id, p, l, array_to_string(w[p + 1 : p + l], ' ') AS k FROM place, (SELECT DISTINCT l FROM win) WHERE p + l <= len(w)) a
  JOIN win USING (l, k)
), spread AS (
  SELECT doc_id, item_id, unnest(range(p, p + l)) AS q FROM hit
), per AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM spread GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN per USING (doc_id)
"""

#: Exact repeats of lines with a word; one edit in lines of 20 characters or more, where a pair has equal first or last halves and agrees around one place.
OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS no FROM documents
), f AS (
  SELECT line, min((doc_id, no)) AS occ, length(line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line
), c AS (
  SELECT line, occ, n, n - s AS t FROM f, (VALUES (0), (1)) v(s) WHERE n >= 20
), pair AS (
  SELECT a.line, b.line AS other, a.n, b.n AS m, a.t FROM c a JOIN c b ON a.t = b.t AND left(a.line, a.t // 2) = left(b.line, b.t // 2) AND a.line <> b.line AND least(a.n, b.n) = a.t AND b.occ < a.occ
  UNION
  SELECT a.line, b.line, a.n, b.n, a.t FROM c a JOIN c b ON a.t = b.t AND right(a.line, a.t // 2) = right(b.line, b.t // 2) AND a.line <> b.line AND least(a.n, b.n) = a.t AND b.occ < a.occ
), near AS (
  SELECT DISTINCT line FROM pair, range(0, 200000) r(i)
  WHERE i <= t AND left(line, i) = left(other, i) AND right(line, greatest(n - i - if(n >= m, 1, 0), 0)) = right(other, greatest(m - i - if(m >= n, 1, 0), 0))
), lost AS (
  SELECT l.doc_id, l.no FROM l JOIN f USING (line) WHERE (l.doc_id, l.no) > f.occ OR line IN (SELECT line FROM near)
)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_lines, count(lost.no)::BIGINT AS n_dropped,
       CASE WHEN any_value(n) IS NOT NULL THEN sha256(coalesce(string_agg(line, chr(10) ORDER BY l.no) FILTER (lost.no IS NULL), '')) END AS kept_sha256
FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents) d
LEFT JOIN l USING (doc_id) LEFT JOIN lost USING (doc_id, no) GROUP BY doc_id
"""

#: SHA-1 in base32 is spelled out: four times eight letters of five bits.
OP3_SQL = r"""
WITH p AS (
  SELECT page_id, lower(coalesce(url, '')) AS u, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, u, payload_bytes,
         array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (i // 8) * 10 + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31) + 1)::BIGINT, 1) FOR i IN range(0, 32)], '') AS payload_digest,
         regexp_extract(u, '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1) AS host,
         regexp_replace(u, '^[a-z][a-z0-9+.-]*://[^/?#]*|#.*$', '', 'g') AS rest
  FROM p
), k AS (
  SELECT *, CASE WHEN host = '' THEN u ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || rest END AS url_key,
         max(page_id) OVER (PARTITION BY payload_digest) AS kept_id
  FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < kept_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < kept_id THEN kept_id END AS refers_to, url_key,
       (row_number() OVER (ORDER BY url_key, page_id) - 1)::BIGINT AS history_rank
FROM k
"""

#: Shared shingles of every two documents, and what is reachable over links.
OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), link AS (
  SELECT c.a, c.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS common FROM s p JOIN s q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY ALL) c
  JOIN n m ON m.doc_id = c.a JOIN n o ON o.doc_id = c.b WHERE 100 * common >= 80 * (m.n + o.n - common)
), reach AS (
  SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON r.other = l.a
), low AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM low LEFT JOIN n USING (doc_id)
"""

#: Every string of 400 bytes by its hash, and the runs that repeated ones cover.
OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, ''))::BIGINT AS n FROM documents
), h AS (
  SELECT doc_id, p, md5(b[p : p + 399]) AS k FROM (SELECT doc_id, b, unnest(range(1, n - 398)) AS p FROM d WHERE n >= 400)
), f AS (
  SELECT doc_id, p FROM h WHERE k IN (SELECT k FROM h GROUP BY k HAVING count(*) > 1)
), r AS (
  SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (SELECT doc_id, p, (coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p), 401) > 400)::INT AS new FROM f)
), span AS (
  SELECT doc_id, min(p) AS s, max(p) + 400 AS e FROM r GROUP BY doc_id, g
), piece AS (
  SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 1) AS begin FROM span
), cut AS (
  SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(hex(b[begin : s - 1]), '' ORDER BY s) || hex(any_value(b)[max(e) : max(n)]) AS kept FROM piece JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(unhex(kept), b)) AS kept_sha256,
       n - coalesce(n_removed, 0)::BIGINT AS kept_bytes, n_spans IS NOT NULL AS has_repeats
FROM d LEFT JOIN cut USING (doc_id)
"""

#: Quantiles of sorted lists for each language and source, in place of sketches.
OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS times FROM (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2))
), again AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM win WHERE times > 1) GROUP BY doc_id
), c AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN again USING (doc_id)
), r AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CASE WHEN word_chars > 0 THEN least(1000, 1000 * n_symbols // word_chars) ELSE 0 END::INT AS symbol_ratio, CASE WHEN n_lines > 0 THEN least(1000, 1000 * n_dup_lines // n_lines) ELSE 0 END::INT AS dup_line_ratio,
         CASE WHEN n_words > 0 THEN least(1000, 1000 * n_repeat_words // n_words) ELSE 0 END::INT AS repeat_ratio, CASE WHEN n_words > 0 THEN least(10000, 100 * word_chars // n_words) ELSE 0 END::INT AS word_length FROM c
), g AS (
  SELECT lang, source, list_sort(list(symbol_ratio)) AS s, list_sort(list(dup_line_ratio)) AS u, list_sort(list(repeat_ratio)) AS p, list_sort(list(word_length)) AS v,
         list_sort(list(word_chars)) AS lc, list_sort(list(n_lines)) AS ll, list_sort(list(n_words)) AS lw, count(*) AS n FROM r WHERE NOT base_failed GROUP BY lang, source
), q AS (
  SELECT lang, source, s[ceil(0.8 * n)::INT] AS s0, s[ceil(0.8 * n)::INT] - s[ceil(0.5 * n)::INT] AS s1, u[ceil(0.95 * n)::INT] AS u0, u[ceil(0.95 * n)::INT] - u[ceil(0.9 * n)::INT] AS u1,
         p[ceil(0.95 * n)::INT] AS p0, p[ceil(0.95 * n)::INT] - p[ceil(0.9 * n)::INT] AS p1, v[ceil(0.5 * n)::INT] AS v0, v[ceil(0.5 * n)::INT] - v[ceil(0.1 * n)::INT] AS v1,
         pow(2, floor(log2(greatest(1, lc[ceil(0.1 * n)::INT])) * 8) / 8) AS c0, pow(2, floor(log2(greatest(1, ll[ceil(0.1 * n)::INT])) * 8) / 8) AS l0, pow(2, floor(log2(greatest(1, lw[ceil(0.1 * n)::INT])) * 8) / 8) AS w0 FROM g
), m AS (
  SELECT median(s1) AS s2, median(u1) AS u2, median(p1) AS p2, median(v1) AS v2 FROM q
), x AS (
  SELECT lang, source, (s0 + floor(3 * greatest(s1, s2)) + floor(5000 / c0))::INT AS max_symbol_ratio, (u0 + floor(2 * greatest(u1, u2)) + floor(1000 / l0))::INT AS max_dup_line_ratio,
         (p0 + floor(2 * greatest(p1, p2)) + floor(10000 / w0))::INT AS max_repeat_ratio, (v0 + floor(6 * greatest(v1, v2)))::INT AS max_word_length FROM q, m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, symbol_ratio, dup_line_ratio, repeat_ratio, word_length, max_symbol_ratio, max_dup_line_ratio, max_repeat_ratio, max_word_length, base_failed,
       NOT base_failed AND coalesce(symbol_ratio <= max_symbol_ratio AND dup_line_ratio <= max_dup_line_ratio AND repeat_ratio <= max_repeat_ratio AND word_length <= max_word_length, false) AS kept
FROM r LEFT JOIN x ON r.lang IS NOT DISTINCT FROM x.lang AND r.source IS NOT DISTINCT FROM x.source
"""

#: Each anchor against each row.
OP11_SQL = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND b.vec_id IS DISTINCT FROM a.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM d WINDOW same AS (PARTITION BY t)
"""

#: Every stretch of one to five words, counted.
OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)
), u AS (
  SELECT lang, id, unnest(w) AS w, unnest(range(0, len(w))) AS i FROM p
), v AS (
  SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4, lead(w, 4) OVER o AS w5 FROM u WINDOW o AS (PARTITION BY id ORDER BY i)
), f AS (
  SELECT lang, [w1] AS g, count(*) AS n FROM v GROUP BY lang, w1 UNION ALL SELECT lang, [w1, w2], count(*) FROM v WHERE w2 IS NOT NULL GROUP BY lang, w1, w2
  UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM v WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM v WHERE w4 IS NOT NULL GROUP BY lang, w1, w2, w3, w4
  UNION ALL SELECT lang, [w1, w2, w3, w4, w5], count(*) FROM v WHERE w5 IS NOT NULL GROUP BY lang, w1, w2, w3, w4, w5
), total AS (
  SELECT lang, sum(n) AS n FROM f WHERE len(g) = 1 GROUP BY lang
), c AS (
  SELECT lang, g, n AS a FROM f WHERE len(g) > 1 AND n >= 100
), inner_part AS (
  SELECT lang, g[i : i + k - 1] AS g, max(a) AS above FROM (SELECT lang, g, a, unnest(range(1, len(g) + 1)) AS i FROM c), range(2, 5) r(k) WHERE k < len(g) AND i + k - 1 <= len(g) GROUP BY ALL
), cut AS (
  SELECT c.lang, c.g, c.a, k, l.n AS l, r.n AS r, (1000::HUGEINT * c.a * total.n) // (l.n::HUGEINT * r.n) AS score
  FROM c JOIN range(1, 5) q(k) ON k < len(c.g) JOIN f l ON l.lang = c.lang AND l.g = c.g[:k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1 :] JOIN total ON total.lang = c.lang
), low AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), x AS (
  SELECT low.lang, array_to_string(low.g, ' ') AS phrase, low.a, low.l, low.r, total.n::BIGINT AS n, low.score::BIGINT AS score
  FROM low JOIN total ON total.lang = low.lang LEFT JOIN inner_part i ON i.lang = low.lang AND i.g = low.g WHERE i.above IS NULL OR 100 * i.above < 100 * low.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM x QUALIFY rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": OP1_SQL,
    "op4_suffix_dedup": OP4_SQL,
    "op5_quality_rules": OP5_SQL,
    "op3_warc": OP3_SQL,
    "op9_line_dedup": OP9_SQL,
    "op8_decontamination": OP8_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_exact_dedup": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
