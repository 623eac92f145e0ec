"""From raw documents to token ids: language ID, exact and near deduplication, mixing, encoding.

Every stage takes what the one before it kept, written as Parquet and read again, and its decisions take effect. In every
stage an empty table gives an empty one with the same columns, texts are taken whole however long, null texts and nulls in
other columns do not fail, and columns beside those of ``documents`` pass through under any name (the last stage has columns of its own).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusledger.llm import bpe, exact_dedup, langid, mixing, ngram_join
from corpusledger.llm.common import new_folder, table
from corpusledger.llm.queries import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; trained on the labelled rows that are not held out.

    Null and empty texts and texts without letters go; without a labelled row all go. Repeated rows stay or go together.
    """
    return langid.keep_known(docs, langid.train(langid.sample(docs)))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id.

    Null texts count as empty, so one document without words stays. A null id loses to any other. Rows that tie, with the same id
    and an equal text, all stay.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link at 0.8 over five-word shingles, directly or by others, the one with the smallest id.

    Documents without words link with nothing and stay, as do rows whose id is null. Rows that repeat an id stay or go together.
    """
    return ngram_join.keep_one(docs, k=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, twice at most.

    Documents without words are never taken; a null source is a source. Rows that repeat an id are each taken as often as the
    most taken of them; ties between equal lengths fall by a seeded hash of the id.
    """
    return mixing.repeat_taken(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and digests of the ids and of what they decode to. A null text has no ids; repeated rows repeat."""
    return bpe.round_trip(docs, *vocabulary(), with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode_texts),
]
#: A trained classifier decides what is kept, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
