"""Asset planning: views, budgets, bindings, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Views of each kind in order. Fixed values.
VIEWS = {"character": ["face", "full_front", "three_quarter", "back"], "location": ["wide"], "object": ["front", "three_quarter", "side", "detail"]}
IMPORTANCE, PRIORITY = ["major", "recurring", "minor"], ["required", "recommended", "optional"]


def base_views(kind: Column, importance: Column, priority: Column, hints: Column, limit: int) -> Column:
    """Views that an entity gets, in order: its base views, then hinted ones of its kind, cut to the limit (locations are not cut)."""
    of = lambda k: F.array(*map(F.lit, VIEWS[k]))
    major = (importance == "major") | (priority == "required")
    middle = (importance == "recurring") | (priority == "recommended")
    character = F.when(major, of("character")).when(middle, F.slice(of("character"), 1, 3)).otherwise(F.slice(of("character"), 1, 1))
    whole = F.coalesce(F.try_element_at(F.array_intersect(F.array(F.lit("front"), F.lit("three_quarter"), F.lit("side")), hints), F.lit(1)), F.lit("front"))
    thing = F.when(major, F.array(whole, F.lit("detail"))).otherwise(F.array(whole))
    more = lambda base, k: F.array_union(base, F.array_intersect(of(k), hints))
    cut = max(1, limit)
    return F.when(kind == "character", F.slice(more(character, "character"), 1, cut)).when(kind == "location", of("location")).otherwise(F.slice(more(thing, "object"), 1, cut))


def budgeted_slots(candidates: DataFrame, scene: list[str], budget: int, per_subject: int) -> DataFrame:
    """Assets that a scene's budget takes: scene, subject, level, slot (label number).

    ``candidates``: scene, subject, is_location, prominence (rank), ord, level (0 for a subject's first asset). First slots go to
    locations, then by prominence and order; later levels follow in candidate order over subjects with a first slot.
    """
    rows = candidates.filter(F.col("level") < per_subject)
    # windows over a scene only, so rows are dealt once, or not at all if they come dealt by scene
    here, named = Window.partitionBy(*scene), F.col("subject").isNotNull()
    for c in scene:
        named = named & F.col(c).isNotNull()
    first = F.row_number().over(here.orderBy(F.col("level") != 0, F.desc("is_location"), "prominence", "ord", "subject"))
    rows = rows.withColumn("_first", (F.col("level") == 0) & (first <= budget))
    rows = rows.withColumn("_used", F.count_if("_first").over(here)).withColumn("_held", (F.col("level") > 0) & named & F.max("_first").over(Window.partitionBy(*scene, "subject")))
    later = F.row_number().over(here.orderBy(~F.col("_held"), "level", "prominence", "ord", "subject"))
    taken = rows.withColumn("_later", later).filter(F.col("_first") | (F.col("_held") & (F.col("_later") + F.col("_used") <= budget)))
    number = F.row_number().over(here.orderBy("prominence", "ord", "subject", "level"))
    return taken.withColumn("slot", number).select(*scene, "subject", "level", "slot")


def audio_specs(entities: DataFrame, least: str) -> DataFrame:
    """Speaking characters at or above a priority."""
    rank = T.ranked_value(F.col("priority"), PRIORITY)
    return entities.filter((F.col("kind") == "character") & F.col("speaks") & (rank <= PRIORITY.index(least) + 1))


def coverage_gaps(visible: DataFrame, assets: DataFrame, slots: DataFrame, scene: list[str]) -> DataFrame:
    """Visible subjects without a slot and why: scene, subject, reason. ``assets``: subject."""
    missing = visible.join(slots.select(*scene, "subject").distinct(), [*scene, "subject"], "left_anti")
    known = assets.select("subject").distinct().withColumn("_has", F.lit(True))
    return missing.join(known, "subject", "left").select(*scene, "subject", F.when(F.col("_has").isNull(), "no image").otherwise("budget exhausted").alias("reason"))


def numbered(df: DataFrame, scene: list[str], order: list[str], label: str) -> DataFrame:
    """Rows with labels such as <Picture 1> in order."""
    k = F.row_number().over(Window.partitionBy(*scene).orderBy(*order))
    return df.withColumn("label", F.format_string(f"<{label} %d>", k))


def picture_specs(variants: DataFrame, views: DataFrame) -> DataFrame:
    """One row for each picture to make: asset_id, entity, variant, view, n_scenes.

    ``variants``: entity, variant, n_scenes, empty (no trait at all) and entity_type; ``views``: entity, views (array). Variants that no
    scene shows are left out, as are empty ones of all but characters.
    """
    shown = variants.filter((F.col("n_scenes") > 0) & (~F.col("empty") | (F.col("entity_type") == "character")))
    rows = shown.join(views.select("entity", F.explode("views").alias("view")), "entity")
    asset = F.concat_ws("_", F.lit("PIC"), F.col("entity").cast("string"), F.upper("variant"), F.upper("view"))
    return rows.select(asset.alias("asset_id"), "entity", "variant", "view", "n_scenes")


def ordered_views(requested: Column, allowed: list[str]) -> Column:
    """The requested views that are allowed, each once, in the allowed order."""
    return F.array_intersect(F.array(*map(F.lit, allowed)), requested)


def exact_views(requests: DataFrame, available: DataFrame, scene: list[str]) -> DataFrame:
    """The asset for each requested view of a subject in a scene: scene, subject, level, view, asset_id.

    Only an asset of exactly that view that is bound to the scene counts, the first by its order; requests without one are left
    out and the levels of the others close up. ``requests``: scene, subject, ord, view; ``available``: scene, subject, view, ord, asset_id.
    """
    here = [*scene, "subject"]
    first = available.groupBy(*here, "view").agg(F.min_by("asset_id", F.struct("ord", "asset_id")).alias("asset_id"))
    met = requests.join(first, [*here, "view"])
    return met.withColumn("level", F.row_number().over(Window.partitionBy(*here).orderBy("ord", "view")) - 1).select(*here, "level", "view", "asset_id")


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of the table's row of their key (null without one); a table with more than one row for a key fails.

    No hint is given: Spark broadcasts a table below its threshold and shuffles a larger one.
    """
    once = table.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    sound = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("more than one row for "), F.col(key).cast("string")))).otherwise(F.lit(True))
    return rows.join(once.filter(sound.cast("boolean")).drop("_n"), key, "left")
