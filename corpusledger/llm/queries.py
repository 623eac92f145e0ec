"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, ann, bpe, decontamination, exact_dedup, langid, license_scan, mixing, ngram_join, secret_scan, sharding, warc, whitening
from .common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, table(spark, sf_dir, "pages"))


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
m AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(body) AS d, max(page_id) OVER (PARTITION BY body) AS holder FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> holder THEN holder END AS refers_to
FROM m
"""


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.label_copies(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs)


OP8_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i, md5('shard-' || lpad(CAST(i AS VARCHAR), 5, '0')) AS d FROM range({sharding.SHARDS}) r(i)
), prefs AS (
  SELECT i, CAST('0x' || substr(d, 1, 8) AS BIGINT) % {sharding.SLOTS} AS o,
         CAST('0x' || substr(d, 9, 8) AS BIGINT) % {sharding.SLOTS - 1} + 1 AS k FROM shards
), orders AS (
  SELECT i, list((o + j * k) % {sharding.SLOTS} ORDER BY j) AS choices FROM prefs, range({sharding.SLOTS}) q(j) GROUP BY i
), turns AS (
  SELECT CAST(0 AS BIGINT) AS t, CAST(-1 AS BIGINT) AS slot, list_transform(range({sharding.SLOTS}), lambda x: false) AS taken
  UNION ALL
  SELECT n.t + 1, n.slot, list_concat(list_concat(n.taken[:n.slot], [true]), n.taken[n.slot + 2:])
  FROM (SELECT u.t, u.taken, list_filter(o.choices, lambda c: NOT u.taken[c + 1])[1] AS slot
        FROM turns u JOIN orders o ON o.i = u.t % {sharding.SHARDS} WHERE u.t < {sharding.SLOTS}) n
), filled AS (SELECT slot, (t - 1) % {sharding.SHARDS} AS shard FROM turns WHERE t > 0),
keyed AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % {sharding.SLOTS} AS slot FROM documents)
SELECT doc_id, CAST(slot AS INTEGER) AS slot, CAST(shard AS INTEGER) AS shard FROM keyed JOIN filled USING (slot)
"""

def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def vocabulary() -> tuple[str, str]:
    """Path of the rank file and the pattern that splits texts."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), *vocabulary())


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark
), w AS (
  SELECT DISTINCT item_id, ws[s:s + 9] AS win FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT len(win) AS n FROM w),
places AS (
  SELECT doc_id, s, n, ws[s:s + n - 1] AS win FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, sizes)
), m AS (SELECT DISTINCT doc_id, s, n, item_id FROM places JOIN w USING (win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM m)) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), most=4)


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op4: how many secrets of each base kind a text has."""
    return op4_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


SECRET_COUNTS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id,
  len(list_filter(regexp_extract_all(t, '(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 'i'), lambda x: length(x) >= 6)) AS n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access,
  len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex
FROM d
"""


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op10: words, places and labels of the exact phrases."""
    return op10_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


LICENSE_PHRASES_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents
), p(words, label) AS (VALUES """ + ", ".join(f"({p.split()}, '{label}')" for p, label in license_scan.PHRASES.items()) + r"""),
m AS (SELECT doc_id, label, unnest(list_filter(range(0, len(ws)), lambda i: ws[i + 1:i + len(words)] = words)) AS pos FROM d, p),
b AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM m GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM d LEFT JOIN b USING (doc_id)
"""


QUERIES = {
    "op1_warc": op1_warc,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_secret_scan": op4_secret_scan,
    "op5_mixing": op5_mixing,
    "op6_language_id": op6_language_id,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_license_scan": op10_license_scan,
    "op11_alignment": op11_alignment,
    "op12_decontamination": op12_decontamination,
    "op13_whitening": op13_whitening,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_sharding": op8_sharding,
    "secret_counts": secret_counts,
    "license_phrases": license_phrases,
}
ORACLE_SQL = {"op1_warc": OP1_SQL, "op7_exact_dedup": OP7_SQL, "op8_sharding": OP8_SQL, "op12_decontamination": OP12_SQL, "secret_counts": SECRET_COUNTS_SQL, "license_phrases": LICENSE_PHRASES_SQL}
