"""Sources: chapter files, versioned JSON documents, digests and run records."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions import text as X
from ..operators.lineage import checkpointed, numbered

EXTENSIONS = r"(?i)\.(txt|md|markdown|pdf)$"
LEAST_CHARS = 100


@pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """UTF-8 with or without a byte-order mark; null if it is not UTF-8."""

    def one(data):
        try:
            return None if data is None else bytes(data).decode("utf-8-sig")
        except UnicodeDecodeError:
            return None

    return content.map(one)


def scan_chapters(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, name, content of the chapter files in the folders, each path once; folders are not descended into."""
    rows = spark.read.format("binaryFile").load(paths).filter(F.col("path").rlike(EXTENSIONS)).dropDuplicates(["path"])
    return rows.select("path", F.regexp_extract("path", r"([^/\\]+)$", 1).alias("name"), "content")


def read_chapters(files: DataFrame, pdf_text: Callable[[bytes], str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(chapters, rejects): normalized text, its basis, digest and place in natural order; blank or unreadable files are rejected.

    ``pdf_text`` turns the bytes of a PDF into text; without it PDF files are rejected.
    """
    pdf = F.col("name").rlike(r"(?i)\.pdf$")
    if pdf_text is None:
        from_pdf = F.lit(None).cast("string")
    else:
        from_pdf = pandas_udf(lambda s: s.map(lambda b: None if b is None else pdf_text(bytes(b))), T.StringType())(F.when(pdf, F.col("content")))
    raw = files.withColumn("_raw", F.when(pdf, from_pdf).otherwise(decoded("content"))).withColumn("location_basis", F.when(pdf, "normalized_pdf_extracted_text").otherwise("normalized_utf8_text"))
    rows = raw.withColumn("text", X.normalize_text(F.col("_raw")))
    blank = F.col("text").isNull() | (X.squeeze(F.col("text")) == "")
    rejects = rows.filter(blank).select("path", F.when(F.col("text").isNull(), "unreadable").otherwise("blank").alias("reason"))
    # names and paths alone are put in order
    places = numbered(rows.filter(~blank).select(X.natural_key(F.col("name")).alias("_key"), "path"), [], ["_key", "path"])
    kept = rows.filter(~blank).join(places, "path").select(F.col("number").alias("ord"), F.regexp_replace("name", r"\.[^.]+$", "").alias("chapter_id"), F.col("path").alias("source_file"), "location_basis", "text", F.sha2("text", 256).alias("text_sha256"))
    return kept, rejects


def length_gate(chapters: DataFrame, least: int = LEAST_CHARS) -> tuple[DataFrame, DataFrame]:
    short = F.length("text") < least
    return chapters.filter(~short), chapters.filter(short).select("chapter_id", F.length("text").alias("n_chars"))


def scan_documents(spark: SparkSession, path: str, schema: T.StructType, version: str, suffix: str = ".json", exclude: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of JSON files with a schema_version, with their file name; other versions and broken files are rejected."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(full).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").option("pathGlobFilter", f"*{suffix}").json(path)
    rows = rows.withColumn("source_file", F.col("_metadata.file_name"))
    if exclude:
        rows = rows.filter(~F.endswith("source_file", F.lit(exclude)))
    good = F.col("_corrupt_record").isNull() & F.col("schema_version").eqNullSafe(version)
    rejects = rows.filter(~good).select("source_file", F.when(F.col("_corrupt_record").isNotNull(), "broken").otherwise("version").alias("reason"))
    return rows.filter(good).drop("_corrupt_record"), rejects


def changed(now: DataFrame, before: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows that are new or whose digest differs."""
    return now.join(before.select(key, digest), [key, digest], "left_anti")


def unique_ids(rows: DataFrame, key: str, slug: str) -> DataFrame:
    """Rows with unique_id: the slug if it is the only one of its kind, else slug_001 and so on by key; where that is taken too, a
    further number is appended until all differ. Keys are unique."""
    same = Window.partitionBy(slug)
    k = F.row_number().over(same.orderBy(key)).cast("string")
    counted = F.concat_ws("_", slug, F.lpad(k, F.greatest(F.lit(3), F.length(k)), F.lit("0")))
    out = rows.withColumn("unique_id", F.when(F.count(F.lit(1)).over(same) == 1, F.col(slug)).otherwise(counted))
    while True:
        again = Window.partitionBy("unique_id").orderBy(F.col("unique_id") != F.col(slug), key)
        out = checkpointed(out.withColumn("_n", F.row_number().over(again)))
        if out.filter("_n > 1").isEmpty():
            return out.drop("_n")
        out = out.withColumn("unique_id", F.when(F.col("_n") > 1, F.concat_ws("_", "unique_id", F.col("_n").cast("string"))).otherwise(F.col("unique_id"))).drop("_n")


def run_record(files: DataFrame, run_id: str, role: str, settings: dict[str, str] | None = None) -> DataFrame:
    """One row per file of a run: run_id, role ('input' or 'output'), path, digest, and the run's settings (map) for comparison."""
    pairs = [F.lit(x) for k, v in sorted((settings or {}).items()) for x in (k, str(v))]
    kept = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return files.select(F.lit(run_id).alias("run_id"), F.lit(role).alias("role"), "path", F.sha2(F.col("content"), 256).alias("digest"), kept.alias("settings"))
