"""Rules over plans, scene metadata, review issues and imported designs; windows for identity jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import quality
from .lineage import Batching, batched, checkpointed

#: Bounds of an identity window. Fixed values.
WINDOW_JOBS, WINDOW_CHARS, WINDOW_CANDIDATES = 8, 12_000, 32


def import_designs(designs: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched, rejects): designs of canonical_name and kind to entities by name key; a match must be unique on both sides.

    Both sides are counted per key before they meet, so a name that very many share makes no pairs.
    """
    d = designs.withColumn("_key", T.name_key(F.col("canonical_name")))
    r = registry.select("entity", F.col("kind"), T.name_key(F.col("canonical_name")).alias("_key"))
    asked = d.groupBy("kind", "_key").agg(F.count(F.lit(1)).alias("_d"))
    known = r.groupBy("kind", "_key").agg(F.count(F.lit(1)).alias("_r"), F.min("entity").alias("entity"))
    state = asked.join(known, ["kind", "_key"]).select("kind", "_key", "entity", ((F.col("_d") == 1) & (F.col("_r") == 1)).alias("_one"))
    rows = d.join(state, ["kind", "_key"], "left")
    matched = rows.filter("_one").drop("_key", "_one")
    rest = rows.filter("_one IS NULL OR NOT _one")
    kept = [c for c in designs.columns if c in ("design_id", "canonical_name", "kind")]
    return matched, rest.select(*kept, F.when(F.col("_one").isNull(), "unknown").otherwise("ambiguous").alias("reason"))


def spatial_violations(plan: DataFrame, sequences: DataFrame, placed: DataFrame, registry: DataFrame) -> DataFrame:
    """Rules of a spatial plan: every sequence once and in order, entities known under their kind, no explicit evidence from later.

    ``plan``: chapter, sequence, ord; ``sequences``: chapter, sequence; ``placed``: chapter, sequence, entity, kind, evidence,
    source_sequence; ``registry``: entity, kind.
    """
    key = F.concat_ws("/", "chapter", "sequence")
    cover = quality.id_coverage(sequences.select(key.alias("id")), plan.select(key.alias("id")), "id")
    back = F.lag("sequence").over(Window.partitionBy("chapter").orderBy("ord")) >= F.col("sequence")
    order = quality.violations(plan.withColumn("_b", back).filter("_b"), "order", key)
    unknown = quality.violations(placed.join(registry, ["entity", "kind"], "left_anti"), "unknown_entity", key, F.col("entity"))
    return cover.unionByName(order).unionByName(unknown).unionByName(quality.future_evidence(placed))


def metadata_violations(requests: DataFrame, approved: DataFrame, views: DataFrame, speakers: DataFrame, dialogue: DataFrame) -> DataFrame:
    """Rules of scene metadata: approved subjects only, one request each, available views only, speakers need dialogue.

    ``requests``: scene, subject, view; ``approved``: scene, subject; ``views``: subject, view; ``speakers``: scene, subject;
    ``dialogue``: scene.
    """
    key = F.concat_ws("/", "scene", "subject")
    lost = quality.violations(requests.join(approved, ["scene", "subject"], "left_anti"), "not_approved", key)
    twice = quality.duplicate_keys(requests, ["scene", "subject"], "repeated_request")
    absent = quality.violations(requests.join(views, ["subject", "view"], "left_anti"), "view_not_available", key, F.col("view"))
    silent = quality.violations(speakers.join(dialogue.select("scene").distinct(), "scene", "left_anti"), "speaker_without_dialogue", key)
    return lost.unionByName(twice).unionByName(absent).unionByName(silent)


def review_violations(issues: DataFrame, payload: str, pointers: list[str]) -> tuple[DataFrame, DataFrame]:
    """(issues kept once each with the cited value, violations). ``issues``: issue_id, path, description and the payload variant.

    An issue may cite only offered paths that the payload has; of issues with equal digest the first stays.
    """
    value = F.coalesce(*[F.when(F.col("path") == p, T.pointer_value(F.col(payload), p)) for p in pointers])
    marked = issues.withColumn("cited_value", value).withColumn("_offered", F.col("path").isin(pointers))
    bad = quality.violations(marked.filter("NOT _offered"), "path_not_offered", F.col("issue_id"), F.col("path"))
    bad = bad.unionByName(quality.violations(marked.filter("_offered AND cited_value IS NULL"), "path_not_found", F.col("issue_id"), F.col("path")))
    good = marked.filter("_offered AND cited_value IS NOT NULL").withColumn("digest", T.digest_id("", 24, F.col("path"), F.col("description"), F.col("cited_value")))
    first = good.groupBy("digest").agg(F.min("issue_id").alias("issue_id"))
    return good.join(first, ["digest", "issue_id"], "left_semi").drop("_offered"), bad


def identity_windows(jobs: DataFrame, group: list[str], parts: int | None = None) -> DataFrame:
    """Identity jobs packed in order: window_no and context (the job before the window's first) are added.

    ``jobs``: group, ord, n_chars, n_candidates. A window ends before the job that would pass any of its three bounds; a job that
    passes one by itself is a window of its own. A large group lies in many ranges (``lineage.batched``).
    """
    rows = batched(jobs, group, ["ord"], ["n_chars", "n_candidates"], Batching([WINDOW_CHARS, WINDOW_CANDIDATES], WINDOW_JOBS), parts=parts)
    rows = checkpointed(rows.withColumnRenamed("batch_no", "window_no"))
    # the last job of a window is the context of the next
    last = rows.groupBy(*group, (F.col("window_no") + 1).alias("window_no")).agg(F.max("ord").cast("long").alias("context"))
    return rows.join(last, [*group, "window_no"], "left").select(*jobs.columns, "window_no", "context")
