"""Queries of chunking, packing and interval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import udfs
from ..operators import chunking, intervals
from .base import SEQUENCES_SQL, chapters, query, sequences, table


@query(
    """WITH RECURSIVE p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, piece FROM (
      SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, trim(unnest(l), ' ' || chr(9) || chr(10) || chr(13)) AS piece FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE length(piece) > 0),
    f AS (SELECT doc_id, k, piece, 0 AS chunk_no, piece AS chunk, length(piece) AS size FROM p WHERE k = 1
      UNION ALL SELECT p.doc_id, p.k, p.piece, CASE WHEN f.size + length(p.piece) + 2 > 1500 THEN f.chunk_no + 1 ELSE f.chunk_no END,
        CASE WHEN f.size + length(p.piece) + 2 > 1500 THEN p.piece ELSE f.chunk || chr(10) || chr(10) || p.piece END,
        CASE WHEN f.size + length(p.piece) + 2 > 1500 THEN length(p.piece) + 2 ELSE f.size + length(p.piece) + 2 END
      FROM f JOIN p ON p.doc_id = f.doc_id AND p.k = f.k + 1),
    c AS (SELECT doc_id AS chapter_id, chunk_no, arg_max(chunk, k) AS chunk FROM f GROUP BY ALL
      UNION ALL SELECT doc_id, 0, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM p))
    SELECT chapter_id, CAST(chunk_no AS INTEGER) AS chunk_no, sha256(chunk) AS chunk_sha256 FROM c"""
)
def paragraph_chunks(spark, sf_dir):
    """The separator is one line feed here, as the table has no blank lines."""
    docs = chapters(spark, sf_dir).select("chapter_id", "text")
    return chunking.paragraph_chunks(docs, "text", 1500, separator=r"\n\s*").select("chapter_id", "chunk_no", F.sha2("chunk", 256).alias("chunk_sha256"))


@query(
    """WITH d AS (SELECT doc_id, text, CASE WHEN length(text) > 1000 THEN CAST(ceil((length(text) - 1000) / 750.0) AS BIGINT) ELSE 0 END AS last FROM documents WHERE length(text) > 0),
    e AS (SELECT doc_id, text, unnest(range(0, last + 1)) AS k FROM d)
    SELECT doc_id AS chapter_id, CAST(k AS INTEGER) AS passage_no, CAST(k * 750 AS INTEGER) AS start_char, sha256(substring(text, k * 750 + 1, 1000)) AS passage_sha256 FROM e"""
)
def fixed_passages(spark, sf_dir):
    docs = chapters(spark, sf_dir).select("chapter_id", "text")
    return chunking.fixed_passages(docs, "text", 1000).select("chapter_id", "passage_no", "start_char", F.sha2("passage", 256).alias("passage_sha256"))


@query("SELECT doc_id AS chapter_id, true AS lossless, true AS bounded FROM documents WHERE length(text) > 0")
def lossless_chunks(spark, sf_dir):
    """The invariant of the cut: the pieces are the text, and none is over the limit."""
    spark.udtf.register("lossless_chunks", udfs.LosslessChunks)
    chapters(spark, sf_dir).select("chapter_id", "text").createOrReplaceTempView("_chapters")
    pieces = spark.sql("SELECT c.chapter_id, c.text, p.* FROM _chapters c, LATERAL lossless_chunks(c.text, 800) p")
    fits = (F.substring(F.col("text"), F.col("start_char") + 1, F.length("piece")) == F.col("piece")) & (F.length("piece") > 0)
    sums = pieces.select("chapter_id", F.length("text").alias("n"), F.length("piece").alias("m"), fits.alias("fits")).groupBy("chapter_id").agg(F.max("n").alias("n"), F.sum("m").alias("m"), F.max("m").alias("most"), F.bool_and("fits").alias("fits"))
    return sums.select("chapter_id", ((F.col("n") == F.col("m")) & F.col("fits")).alias("lossless"), (F.col("most") <= 800).alias("bounded"))


@query(
    r"""WITH RECURSIVE c AS (SELECT doc_id, 0 AS piece_no, 0 AS start_char, text AS rest FROM documents WHERE length(text) > 0),
 p AS (SELECT doc_id, piece_no, start_char, rest, CASE WHEN length(rest) <= 800 THEN length(rest) ELSE coalesce(nullif(length(regexp_extract(left(rest, 800), '(?s)^.*\n\s*\n')), 0),
   nullif(length(regexp_extract(left(rest, 800), '(?s)^.*[.!?…]["»”'']?(?:\s+|$)')), 0), nullif(length(regexp_extract(left(rest, 800), '(?s)^.*\s')), 0), 800) END AS n FROM c
  UNION ALL SELECT doc_id, piece_no + 1, start_char + n, t, CASE WHEN length(t) <= 800 THEN length(t) ELSE coalesce(nullif(length(regexp_extract(left(t, 800), '(?s)^.*\n\s*\n')), 0),
   nullif(length(regexp_extract(left(t, 800), '(?s)^.*[.!?…]["»”'']?(?:\s+|$)')), 0), nullif(length(regexp_extract(left(t, 800), '(?s)^.*\s')), 0), 800) END
   FROM p, LATERAL (SELECT substring(rest, n + 1) AS t) WHERE n < length(rest))
 SELECT doc_id AS chapter_id, piece_no, CAST(start_char AS INTEGER) AS start_char, sha256(left(rest, n)) AS piece_sha256 FROM p"""
)
def lossless_pieces(spark, sf_dir):
    """The pieces themselves: cut at the last blank line, else the last sentence, else the last white space."""
    spark.udtf.register("lossless_chunks", udfs.LosslessChunks)
    chapters(spark, sf_dir).select("chapter_id", "text").createOrReplaceTempView("_chapters")
    pieces = spark.sql("SELECT c.chapter_id, p.* FROM _chapters c, LATERAL lossless_chunks(c.text, 800) p")
    return pieces.select("chapter_id", "piece_no", "start_char", F.sha2("piece", 256).alias("piece_sha256"))


@query("SELECT doc_id AS chapter_id, CAST(count(*) AS BIGINT) AS n_segments, max(length(s)) AS longest FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\s*\\S+\\s*')) AS s FROM documents) GROUP BY doc_id")
def segments(spark, sf_dir):
    parts = chunking.segments(chapters(spark, sf_dir).select("chapter_id", "text"), "text")
    return parts.groupBy("chapter_id").agg(F.count(F.lit(1)).alias("n_segments"), F.max(F.length("segment")).cast("long").alias("longest"))


PACK_SQL = """WITH RECURSIVE {seqs}, s AS (SELECT chapter_id, sequence, {cost} AS c FROM seqs),
    ok AS (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY sequence) AS k FROM s WHERE c <= {most}),
    f AS (SELECT chapter_id, sequence, c, k, 0 AS batch_no, c AS size, 1 AS items FROM ok WHERE k = 1
      UNION ALL SELECT ok.chapter_id, ok.sequence, ok.c, ok.k,
        CASE WHEN f.size + ok.c + {gap} > {most} OR f.items >= {items} THEN f.batch_no + 1 ELSE f.batch_no END,
        CASE WHEN f.size + ok.c + {gap} > {most} OR f.items >= {items} THEN ok.c ELSE f.size + ok.c + {gap} END,
        CASE WHEN f.size + ok.c + {gap} > {most} OR f.items >= {items} THEN 1 ELSE f.items + 1 END
      FROM f JOIN ok ON ok.chapter_id = f.chapter_id AND ok.k = f.k + 1)
    SELECT chapter_id, CAST(sequence AS INTEGER) AS sequence, CAST(batch_no AS INTEGER) AS batch_no, 'packed' AS status FROM f
    UNION ALL SELECT chapter_id, CAST(sequence AS INTEGER), NULL, 'over_budget' FROM s WHERE c > {most}"""


@query(PACK_SQL.format(seqs=SEQUENCES_SQL, cost="length(source)", most=900, gap=2, items=1_000_000))
def pack_chars(spark, sf_dir):
    rows = sequences(spark, sf_dir).select("chapter_id", "sequence", F.length("source").alias("c"))
    return chunking.pack(rows, ["chapter_id"], "sequence", F.col("c"), 900, gap=2).drop("c")


@query(PACK_SQL.format(seqs=SEQUENCES_SQL, cost="octet_length(encode(source))", most=1200, gap=0, items=4))
def pack_bytes(spark, sf_dir):
    rows = sequences(spark, sf_dir).select("chapter_id", "sequence", F.octet_length("source").alias("c"))
    return chunking.pack(rows, ["chapter_id"], "sequence", F.col("c"), 1200, most_items=4).drop("c")


@query(f"WITH {SEQUENCES_SQL} SELECT chapter_id, CAST(sequence AS INTEGER) AS sequence, CAST((row_number() OVER (PARTITION BY chapter_id ORDER BY sequence) - 1) // 6 AS INTEGER) AS batch_no FROM seqs")
def fixed_batches(spark, sf_dir):
    return chunking.fixed_batches(sequences(spark, sf_dir).select("chapter_id", "sequence"), ["chapter_id"], ["sequence"], 6)


#: Spans of events on a user's axis of seconds: some overlap, some touch.
SPANS_SQL = "spans AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS s, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 + (event_id % 7) * 4000 AS e FROM events)"


def spans(spark, sf_dir):
    s = F.unix_timestamp("ts") - 1704067200
    return table(spark, sf_dir, "events").select("user_id", "event_id", s.alias("s"), (s + (F.col("event_id") % 7) * 4000).alias("e"))


MERGED_SQL = f"""WITH {SPANS_SQL}, m AS (SELECT user_id, s, e, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM spans WHERE s < e),
    g AS (SELECT user_id, s, e, sum(CASE WHEN r IS NULL OR r < s THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e) AS island FROM m),
    merged AS (SELECT user_id, min(s) AS s, max(e) AS e FROM g GROUP BY user_id, island)"""


@query(MERGED_SQL + " SELECT * FROM merged")
def merge_intervals(spark, sf_dir):
    return intervals.merge(spans(spark, sf_dir), ["user_id"], "s", "e")


@query(MERGED_SQL + " SELECT user_id, CAST(sum(e - s) AS BIGINT) AS covered FROM merged GROUP BY user_id")
def coverage(spark, sf_dir):
    return intervals.coverage(spans(spark, sf_dir), ["user_id"], "s", "e")


@query(f"WITH {SPANS_SQL} SELECT a.user_id, a.event_id AS inner_id, b.event_id AS outer_id FROM spans a JOIN spans b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND b.s <= a.s AND a.e <= b.e")
def span_containment(spark, sf_dir):
    every = spans(spark, sf_dir)
    inner = every.select("user_id", F.col("event_id").alias("inner_id"), F.col("s").alias("a"), F.col("e").alias("b"))
    outer = every.withColumnRenamed("event_id", "outer_id")
    return intervals.contained(inner, outer, ["user_id"], ("a", "b"), ("s", "e"), width=20_000).filter("inner_id <> outer_id").select("user_id", "inner_id", "outer_id")


@query(
    f"""WITH {SPANS_SQL}, m AS (SELECT user_id, s, e, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM spans WHERE s < e),
    g AS (SELECT user_id, s, e, sum(CASE WHEN r IS NULL OR r <= s THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e) AS passage_id FROM m),
    c AS (SELECT user_id, passage_id, min(s) AS cs, max(e) AS ce FROM g GROUP BY user_id, passage_id)
    SELECT spans.user_id, event_id AS item, CAST(passage_id AS INTEGER) AS passage_id, s - cs AS "offset" FROM spans JOIN c ON c.user_id = spans.user_id AND cs <= s AND e <= ce WHERE s < e"""
)
def shared_contexts(spark, sf_dir):
    rows = spans(spark, sf_dir).filter("s < e").select("user_id", F.col("event_id").alias("item"), F.col("s").alias("start_char"), F.col("e").alias("end_char"))
    return chunking.shared_contexts(rows, ["user_id"])[1]


@query("SELECT row_number() OVER (ORDER BY f) AS value_id, sha256(text) AS value_sha256, uses FROM (SELECT text, count(*) AS uses, min(doc_id) AS f FROM documents WHERE length(text) >= 256 GROUP BY text HAVING count(*) > 1)")
def intern_text(spark, sf_dir):
    return chunking.intern(chapters(spark, sf_dir), "text", ["chapter_id"]).select("value_id", F.sha2("text", 256).alias("value_sha256"), "uses")


@query("SELECT source, doc_id AS chapter_id, octet_length(encode(text)) AS n_bytes, place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY octet_length(encode(text)) DESC, doc_id) AS place FROM documents) WHERE place <= 5")
def top_costs(spark, sf_dir):
    return chunking.top_costs(chapters(spark, sf_dir), ["source"], "chapter_id", "text")


@query("SELECT doc_id AS chapter_id, unnest(CASE WHEN length(text) < 500 THEN [0] ELSE [0, 1] END) AS part, unnest(CASE WHEN length(text) < 500 THEN [length(text)] ELSE [length(text) // 2 + least(250, length(text) // 8), length(text) - length(text) // 2] END) AS n_chars FROM documents")
def halve_overflow(spark, sf_dir):
    return chunking.halve(chapters(spark, sf_dir).select("chapter_id", "text"), "text").select("chapter_id", "part", F.length("piece").cast("long").alias("n_chars"))
