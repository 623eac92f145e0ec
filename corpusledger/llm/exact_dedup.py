"""Exact deduplication by a 128-bit content hash, with the bytes compared inside each hash group.

Only DataFrame functions. Every text is normalised and hashed once, in a row of ids and hashes that is written to the
shared folder; groups, sizes and ids that stay come from those light rows. Texts move only where a hash repeats: there
they meet by their bytes, equal ones collapsed in the map-side half of the aggregation. A group that holds more than
one row in LARGE is labelled by a broadcast, of at most LARGE groups, so that no hash is one task's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flagged, settled

#: Runs of ASCII white space that are not one space already.
SPACES = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
LARGE = 4096


def normalised(column):
    """Every run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(column, F.lit("")), SPACES, " ")


def hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _norm, _hash (128 bits) and text_sha256 of every row."""
    rows = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_norm"))
    return rows.select("_id", "_norm", F.unhex(F.md5("_norm")).alias("_hash"), F.sha2("_norm", 256).alias("text_sha256"))


def groups(docs: DataFrame, light: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct text: _hash, text_sha256, keep_id, group_size; ``light`` has _id, _hash, text_sha256 of all rows.

    Rows meet by the hash; where it repeats, their bytes are compared, so a hash collision makes two groups. Two different
    texts that agreed in MD5 and SHA-256 at once could not be told apart by their hashes; that raises an error.
    """
    met = light.groupBy("_hash", "text_sha256").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    again = light.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_hash")
    ids = flagged(light, "_hash", again).filter("_may").select("_id")
    rows = flagged(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", ids).filter("_may")
    texts = hashed(rows, "_id", "_text").groupBy("_hash", "text_sha256", "_norm").agg(F.count(F.lit(1)).alias("_n")).groupBy("_hash", "text_sha256").agg(F.count(F.lit(1)).alias("_texts"))
    size = F.when(F.col("_texts") > 1, F.raise_error(F.lit("two texts share both digests")).cast("long")).otherwise(F.col("group_size"))
    return met.join(texts, ["_hash", "text_sha256"], "left").select("_hash", "text_sha256", "keep_id", size.alias("group_size"))


def _found(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    light = settled(hashed(docs, id_col, text_col).drop("_norm"), "hashes")
    return light, settled(groups(docs, light, id_col, text_col), "groups")


def label_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal. Ties cannot arise but for repeated ids: rows that repeat the smallest id of their
    group are all kept, as nothing tells them apart. A null id is never the smallest unless all ids of the group are
    null; then its rows are kept. An empty table gives an empty result; other columns are ignored.
    """
    light, found = _found(docs, id_col, text_col)
    large = F.broadcast(found.filter(F.col("group_size") * LARGE > light.count()))  # LARGE rows at most
    keys = ["_hash", "text_sha256"]
    out = light.join(large, keys).unionByName(light.join(large, keys, "left_anti").join(found, keys))
    return out.select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that ``label_copies`` marks as kept, with their own columns.

    A row goes by its id and its text together: an id that stays with one text may go with another. Rows whose id is in
    no group of two or more pass where they lie; only the others are hashed again and shuffled.
    """
    light, found = _found(docs, id_col, text_col)
    ids = flagged(light, "_hash", found.filter("group_size > 1").select("_hash")).filter("_may").select("_id")
    rows = flagged(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.struct(*docs.columns).alias("_given")), "_id", ids)
    kept = found.select("_hash", "text_sha256", F.col("keep_id").alias("_keep"))
    norm = normalised(F.col("_text"))
    twice = rows.filter("_may").select("_id", "_given", F.unhex(F.md5(norm)).alias("_h"), F.sha2(norm, 256).alias("_s"))
    stays = twice.join(kept, (F.col("_h") == F.col("_hash")) & (F.col("_s") == F.col("text_sha256")) & F.col("_id").eqNullSafe(F.col("_keep")), "left_semi")
    return rows.filter("NOT _may").select("_given.*").unionByName(stays.select("_given.*"))
