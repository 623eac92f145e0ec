"""Saved documents of each stage: their files, shapes and the checks they pass when they are read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import quality
from ..operators.lineage import numbered
from .chapters import scan_documents

# How the files of a stage end, and which of them is another stage's.
FILES = {
    "chapters": (".cinematic.json", None),
    "catalogs": ("_references.json", "consolidated_references.json"),
    "registry": ("consolidated_references.json", None),
    "evidence": ("_evidence.json", None),
    "profiles": ("_profiles.json", None),
    "spatial": ("_spatial.json", None),
}
TRAIT = "struct<attribute:string,description:string,scope:string,evidence:string>"
SHAPES = {
    "chapters": "chapter_id string, sequences array<struct<sequence:int,source:string,adaptation:struct<initialState:string,event:string,endingState:string>>>",
    "catalogs": f"chapter_id string, entities array<struct<kind:string,local_id:string,canonical_name:string,aliases:array<string>,observations:array<struct<sequence:int,presence:string,visual_traits:array<{TRAIT}>>>>>",
    "registry": "entities array<struct<global_id:string,entity_type:string,canonical_name:string,aliases:array<string>,importance:string,reference_priority:string>>, picture_assets array<struct<asset_id:string,linked_global_id:string,variant:string,view_type:string,scene_bindings:map<string,array<int>>>>",
    "evidence": "chapter_id string, source_text string, source_text_sha256 string, observations array<struct<evidence_id:string,character:string,attribute:string,value:string,classification:string,confidence:double,persistence:string,quotation:string>>",
    "profiles": "profiles array<struct<local_id:string,canonical_name:string,link_to_local_id:string,evidence_ids:array<string>>>",
    "spatial": "source_digest string, chapters array<struct<chapter_id:string,sequences:array<struct<sequence:int,location_id:string>>>>",
}


def load(spark: SparkSession, path: str, stage: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of a stage: its columns, source_file and ord, the place of the file's name in natural order.

    Broken files and other versions are rejected (source_file, reason).
    """
    from pyspark.sql.types import _parse_datatype_string

    suffix, exclude = FILES[stage]
    schema = _parse_datatype_string(f"schema_version string, {SHAPES[stage]}")
    rows, rejects = scan_documents(spark, path, schema, version, suffix, exclude)
    places = numbered(rows.select(X.natural_key(F.col("source_file")).alias("_key"), "source_file"), [], ["_key", "source_file"])
    return rows.join(places.select("source_file", F.col("number").alias("ord")), "source_file"), rejects


def sequences_of(chapters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sequences, violations) of chapter documents: chapter_id, sequence, source, adaptation; a chapter has sequences, their numbers
    rise, and every one has its source and its first and last state."""
    rows = chapters.select("chapter_id", F.posexplode("sequences").alias("_place", "_s")).select("chapter_id", "_place", "_s.*")
    empty = chapters.filter(F.coalesce(F.size("sequences"), F.lit(0)) <= 0).select("chapter_id", F.lit(None).cast("int").alias("sequence"), F.lit("no_sequences").alias("rule"))
    return rows.drop("_place"), empty.unionByName(quality.sequence_violations(rows, "chapter_id", "_place"))


def evidence_of(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, violations) of evidence documents: an edited text no longer has its digest, and then its observations do not count.

    A text that is not normalized is a violation too.
    """
    edited = quality.digest_mismatch(documents, "chapter_id", "source_text", "source_text_sha256")
    raw = quality.violations(documents.filter(X.normalize_text(F.col("source_text")) != F.col("source_text")), "not_normalized", F.col("chapter_id"))
    bad = edited.unionByName(raw)
    sound = documents.join(bad.select(F.col("key").alias("chapter_id")).distinct(), "chapter_id", "left_anti")
    return sound.select("chapter_id", F.inline("observations")), bad


def profiles_of(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profiles, violations) of profile documents: links that dangle, chain or lead to themselves are violations."""
    rows = documents.select(F.inline("profiles"))
    return rows, quality.link_chains(rows.select(F.col("local_id").alias("id"), F.col("link_to_local_id").alias("link")), "id", "link")
