"""Benchmark decontamination by a distributed positional inverted index. DataFrame functions only.

The index stores where the words of a vocabulary stand in the training documents: rows of word, document and position,
in files that are written where the texts lie. A phrase of a test set is looked up by its rarest words, by corpus-wide
counts: the postings of its rarest word, moved back by the word's place in the phrase, are where the phrase may start; those of
its next rarest word, moved back likewise, must meet them there; what is left is compared with the documents, word by word. Frequent words
are never looked up for themselves, so what is shuffled is a small part of all words. For proximity, the postings of all
words of a phrase meet near those of its rarest one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import flagged, settled

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word before A-Z are in lower case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Lists that are intersected before the documents are read; phrases up to this number travel to all tasks, more are shuffled.
LISTS, FEW = 2, 200_000
#: Words of a document that one task counts hits in.
BLOCK = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text):
    """Words of a text, A-Z in lower case; none for null."""
    known = F.coalesce(text, F.lit(""))
    # the same as translate where all characters are ASCII, and much faster
    low = F.when(F.octet_length(known) == F.length(known), F.lower(known)).otherwise(F.translate(known, UPPER, LOWER))
    return F.array_remove(F.split(low, SEPARATORS), "")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _h (hash of the text, so that rows that repeat an id with another text stay apart) and _text."""
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h"), F.col(text_col).alias("_text"))


def same_doc(left: DataFrame, right: DataFrame):
    return left["_id"].eqNullSafe(right["_id"]) & (left["_h"] == right["_h"])


def small(df: DataFrame, rows: int) -> DataFrame:
    """Sent to all tasks where it has few rows; else Spark decides."""
    return F.broadcast(df) if rows <= FEW else df


def phrases(items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct windows of ``size`` words of the items (_phrase, _words), and which items hold them (_phrase, _item).

    An item of fewer words is one window; one without words has none.
    """
    rows = items.select(F.col(id_col).alias("_item"), words(F.col(text_col)).alias("_all")).filter("size(_all) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("_all") - size, F.lit(0)))
    cut = rows.select("_item", "_all", F.explode(starts).alias("_s")).select("_item", F.slice("_all", F.col("_s") + 1, size).alias("_words"))
    held = settled(cut.select("_item", "_words", F.array_join("_words", " ").alias("_phrase")).distinct(), "windows")
    return held.groupBy("_phrase").agg(F.first("_words").alias("_words")), held.select("_phrase", "_item").distinct()


def tokens(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """_id, _h, _pos, _word of the documents' words that are in wanted's only column, and of few others."""
    rows = docs.select("_id", "_h", F.posexplode(words(F.col("_text"))).alias("_pos", "_word"))
    return flagged(rows, "_word", wanted).filter("_may").drop("_may")


def word_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """How often the wanted words stand in all documents: _word, _count (0 where they don't); added up in each task first."""
    found = tokens(docs, wanted).groupBy("_word").agg(F.count(F.lit(1)).alias("_count"))
    return wanted.join(found, "_word", "left").select("_word", F.coalesce("_count", F.lit(0)).alias("_count"))


def build_index(docs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The index: _word, _id, _h, _pos of the wanted words (all without ``wanted``), written to the shared folder without a shuffle."""
    rows = docs.select("_id", "_h", F.posexplode(words(F.col("_text"))).alias("_pos", "_word")) if wanted is None else tokens(docs, wanted)
    return settled(rows.select("_word", "_id", "_h", "_pos"), "postings")


def seeds(found: DataFrame, counts: DataFrame, lists: int = LISTS) -> DataFrame:
    """The rarest words of each phrase: _phrase, _rank (from 1), _word, _at (its place); ties to the first place, a word once."""
    each = found.select("_phrase", F.posexplode("_words").alias("_at", "_word")).groupBy("_phrase", "_word").agg(F.min("_at").alias("_at"))
    order = Window.partitionBy("_phrase").orderBy("_count", "_at")
    return each.join(counts, "_word").withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= lists).select("_phrase", "_rank", "_word", "_at")


def phrase_places(docs: DataFrame, found: DataFrame, lists: int = LISTS) -> DataFrame:
    """Every place of every phrase (_phrase, _words): _id, _h, _phrase, _start, _n (its words); ``docs`` as ``keyed``.

    Phrases without words have no places.
    """
    found = settled(found.filter("size(_words) > 0"), "phrases")
    known = found.count()
    vocabulary = found.select(F.explode("_words").alias("_word")).distinct()
    rare = settled(seeds(found, settled(word_counts(docs, vocabulary), "counts"), lists), "seeds")
    index = build_index(docs, rare.select("_word").distinct())
    keys = ["_id", "_h", "_phrase", "_start"]
    at = None
    for rank in range(1, lists + 1):
        chosen = small(rare.filter(F.col("_rank") == rank).drop("_rank"), known)
        if at is None:
            at = index.join(chosen, "_word").select("_id", "_h", "_phrase", (F.col("_pos") - F.col("_at")).alias("_start")).filter("_start >= 0")
            continue
        # phrases with one word alone have no further list
        asked = at.join(chosen, "_phrase", "left").withColumn("_need", F.col("_start") + F.col("_at"))
        lists_at = index.join(small(rare.filter(F.col("_rank") == rank).select("_word").distinct(), known), "_word", "left_semi")
        met = (asked["_word"] == lists_at["_word"]) & (asked["_need"] == lists_at["_pos"]) & same_doc(asked, lists_at)
        at = asked.filter("_word IS NOT NULL").join(lists_at, met, "left_semi").select(*keys).unionByName(asked.filter("_word IS NULL").select(*keys))
    left = settled(at, "candidates")
    texts = flagged(docs, "_h", left.select("_h").distinct()).filter("_may").select("_id", "_h", "_text").dropDuplicates(["_id", "_h"])
    asked = left.join(small(found, known), "_phrase").groupBy("_id", "_h").agg(F.collect_list(F.struct("_phrase", "_words", "_start")).alias("_asked"))
    # a document's places are no more than its words for each length of phrase
    both = texts.join(asked, same_doc(texts, asked)).select(texts["_id"], texts["_h"], words(F.col("_text")).alias("_all"), "_asked")
    good = F.filter("_asked", lambda x: F.slice("_all", x["_start"] + 1, F.size(x["_words"])) == x["_words"])
    return both.select("_id", "_h", F.explode(good).alias("_m")).select("_id", "_h", "_m._phrase", "_m._start", F.size("_m._words").alias("_n"))


def near_places(docs: DataFrame, found: DataFrame, span: int) -> DataFrame:
    """Where all words of a phrase stand within ``span`` consecutive words, in any order: _id, _h, _phrase, _start, _end.

    A word that a phrase repeats is asked for once. Of spans with one end the shortest, of those with one start the shortest.
    """
    each = found.select("_phrase", F.explode(F.array_distinct("_words")).alias("_word"))
    each = settled(each.withColumn("_k", F.row_number().over(Window.partitionBy("_phrase").orderBy("_word"))), "terms")
    known, most = each.count(), each.agg(F.max("_k")).first()[0] or 0
    vocabulary = each.select("_word").distinct()
    rare = seeds(found, settled(word_counts(docs, vocabulary), "counts"), 1)
    index = build_index(docs, vocabulary)
    block = lambda c: F.floor(F.col(c) / span)
    firsts = index.join(small(rare, known), "_word").select("_id", "_h", "_phrase", F.explode(F.array(*[block("_pos") + d for d in (-1, 0, 1)])).alias("_b")).distinct()
    rows = index.join(small(each, known), "_word").withColumn("_b", block("_pos"))
    near = rows.join(firsts, rows["_id"].eqNullSafe(firsts["_id"]) & (rows["_h"] == firsts["_h"]) & (rows["_phrase"] == firsts["_phrase"]) & (rows["_b"] == firsts["_b"]), "left_semi")
    so_far = Window.partitionBy("_id", "_h", "_phrase").orderBy("_pos")
    last = [F.max(F.when(F.col("_k") == k, F.col("_pos"))).over(so_far).alias(f"_p{k}") for k in range(1, most + 1)]
    count = each.groupBy("_phrase").agg(F.max("_k").alias("_of"))
    seen = near.distinct().select("_id", "_h", "_phrase", "_pos", F.array_compact(F.array(*last)).alias("_p") if last else F.array().cast("array<int>").alias("_p"))
    ends = seen.join(small(count, known), "_phrase").filter("size(_p) = _of").select("_id", "_h", "_phrase", F.array_min("_p").alias("_start"), (F.col("_pos") + 1).alias("_end"))
    return ends.filter(F.col("_end") - F.col("_start") <= span).groupBy("_id", "_h", "_phrase", "_start").agg(F.min("_end").alias("_end"))


def covered(places: DataFrame) -> DataFrame:
    """Words inside any place: _id, _h, n_hit. Long documents are counted in blocks."""
    first, last = F.floor(F.col("_start") / BLOCK), F.floor((F.col("_end") - 1) / BLOCK)
    longest = places.groupBy("_id", "_h", "_start").agg(F.max(F.col("_start") + F.col("_n")).alias("_end"))
    cut = longest.select("_id", "_h", "_start", "_end", F.explode(F.sequence(first, last)).alias("_b"))
    cut = cut.select("_id", "_h", "_b", F.greatest("_start", F.col("_b") * BLOCK).alias("_a"), F.least("_end", (F.col("_b") + 1) * BLOCK).alias("_z"))
    order = Window.partitionBy("_id", "_h", "_b").orderBy("_a", "_z").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("_z") - F.greatest(F.col("_a"), F.coalesce(F.max("_z").over(order), F.lit(0))))
    return cut.select("_id", "_h", new.alias("_new")).groupBy("_id", "_h").agg(F.sum("_new").cast("long").alias("n_hit"))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits. Items without words, or whose id is null, hit nothing that is listed: the words count as hit,
    the null id is not in the list. Repeated rows of documents give repeated rows; repeated items count once. Ids of items are
    sorted as strings. An empty table of documents gives an empty result, an empty one of items no hits; other columns are ignored.
    """
    given = keyed(docs, id_col, text_col)
    windows, held = phrases(items, size, item_col, item_text)
    places = settled(phrase_places(given, windows), "places")
    hits = covered(places)
    # windows with the same items are one set of items, so that a repeated item multiplies nothing
    sets = held.groupBy("_phrase").agg(F.array_sort(F.collect_set(F.col("_item").cast("string"))).alias("_items"))
    met = places.select("_id", "_h", "_phrase").distinct().join(sets, "_phrase").select("_id", "_h", "_items").distinct()
    listed = met.groupBy("_id", "_h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"))
    rows = given.select("_id", "_h", F.regexp_count(F.coalesce("_text", F.lit("")), F.lit(WORD)).cast("long").alias("n_words"))
    found = hits.join(listed, same_doc(hits, listed)).select(hits["_id"], hits["_h"], "n_hit", "_items")
    out = rows.join(found, same_doc(rows, found), "left")
    none = F.coalesce("_items", F.array().cast("array<string>"))
    return out.select(
        rows["_id"].alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.size(none).cast("long").alias("n_items"),
        F.sha2(F.array_join(none, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
