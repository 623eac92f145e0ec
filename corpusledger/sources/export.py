"""Sinks: text blocks, staged tables, scene sheets, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_blocks(df: DataFrame, keys: list[str], order: list[str], line: Column, joint: str = "\n\n") -> DataFrame:
    """One text per key: the rows' lines in order."""
    rows = df.select(*keys, F.struct(*order, line.alias("_line")).alias("_s"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["_line"]), joint).alias("block"))


def with_headers(df: DataFrame, keys: list[str], entity: str, order: list[str], line: Column, header: Column) -> DataFrame:
    """Lines with a header before the first of each entity."""
    changed = ~F.lag(entity).over(Window.partitionBy(*keys).orderBy(*order)).eqNullSafe(F.col(entity))
    marked = df.withColumn("_line", F.when(changed, F.concat(header, F.lit("\n"), line)).otherwise(line))
    return text_blocks(marked, keys, order, F.col("_line"), "\n")


def manifest(scenes: DataFrame, key: str, hidden: list[str]) -> DataFrame:
    """Per chapter its scenes in order without internal fields, and their number."""
    public = [c for c in scenes.columns if c != key and c not in hidden]
    return scenes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*public))).alias("scenes"), F.count(F.lit(1)).alias("n_scenes"))


def without_field(value: Column, kind: T.DataType, name: str) -> Column:
    """A nested value without the field of that name, at any depth of structs and arrays."""
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: without_field(x, kind.elementType, name))
    if not isinstance(kind, T.StructType):
        return value
    kept = [without_field(value[f.name], f.dataType, name).alias(f.name) for f in kind.fields if f.name != name]
    return F.when(value.isNotNull(), F.struct(*kept))


def downstream_chapters(chapters: DataFrame, reviewed: str = "narrative_review", sequences: str = "sequences", name: str = "review") -> DataFrame:
    """Chapters as later stages get them: data and editable choices stay, what a review recorded goes.

    Sequences lose their review; of the chapter's own review only its issues stay, their proposals without reviews of theirs. A null
    review stays null; one without issues has an empty list. Other columns stay.
    """
    kinds = {f.name: f.dataType for f in chapters.schema.fields}
    issues = F.coalesce(without_field(F.col(reviewed)["issues"], kinds[reviewed]["issues"].dataType, name), F.array())
    return chapters.withColumns({
        sequences: without_field(F.col(sequences), kinds[sequences], name),
        reviewed: F.when(F.col(reviewed).isNotNull(), F.struct(issues.alias("issues"))),
    })


def write_stage(df: DataFrame, path: str, partition: list[str] | None = None, form: str = "parquet") -> None:
    """Replace a stage's table; the commit protocol keeps half-written files out."""
    writer = df.write.mode("overwrite").format(form)
    (writer.partitionBy(*partition) if partition else writer).save(path)


def scene_sheet(scenes: DataFrame) -> DataFrame:
    """The sheet of each scene: keys, title, sheet.

    ``scenes``: chapter_id, sequence, title, previous_sequence, subjects (array of struct label, name, entity_type, pictures: array of struct
    label, view, variant, file), audio (array of struct label, name, file), unreferenced (array of struct name, entity_type), errors and
    prompt. Parts that a scene has nothing for are left out.
    """
    none = F.array().cast("array<string>")
    files = lambda s: F.transform(s["pictures"], lambda p: F.concat(F.lit("  "), p["label"], F.lit(" = "), s["name"], F.lit(" | "), F.concat_ws(" | ", p["view"], p["variant"], p["file"])))
    heads = lambda s: F.array(F.concat(s["label"], F.lit(" = "), s["name"], F.lit(" ("), s["entity_type"], F.lit(")")))
    subjects = F.flatten(F.transform("subjects", lambda s: F.concat(heads(s), files(s))))
    voices = F.transform("audio", lambda a: F.concat(a["label"], F.lit(" = "), a["name"], F.lit(" | "), a["file"]))
    bare = F.transform("unreferenced", lambda u: F.concat(F.lit("No image attached: "), u["name"], F.lit(" ("), u["entity_type"], F.lit(")")))
    part = lambda test, *lines: F.when(F.coalesce(test, F.lit(False)), F.concat(*lines)).otherwise(none)
    line = lambda c: F.array(c if not isinstance(c, str) else F.lit(c))
    text = F.concat(
        line(F.concat(F.lit("SCENE: "), F.col("title"))), line(""),
        part(F.col("previous_sequence").isNotNull(), line("OPENING IMAGE:"), line(F.concat(F.lit("The last frame of sequence "), F.col("previous_sequence").cast("string"), F.lit(" opens this scene."))), line("")),
        part(F.size(F.concat(subjects, voices)) > 0, line("REFERENCES IN ORDER:"), subjects, voices),
        bare,
        part(F.size("errors") > 0, line(""), line("VALIDATION WARNINGS:"), F.col("errors")),
        line(""), line("PROMPT:"), line(F.rtrim("prompt")),
    )
    return scenes.select("chapter_id", "sequence", "title", F.concat(F.array_join(text, "\n"), F.lit("\n")).alias("sheet"))


def chapter_prompts(scenes: DataFrame, chapter: str = "chapter_id") -> DataFrame:
    """All prompts of a chapter in one text, in order and under their titles: chapter, block."""
    return text_blocks(scenes, [chapter], ["sequence"], F.concat(F.lit("== "), F.col("title"), F.lit(" ==\n"), F.rtrim("prompt")))


def write_texts(df: DataFrame, path: str, folder: str, text_col: str) -> None:
    """One text file set per folder."""
    df.select(folder, F.col(text_col).alias("value")).repartition(folder).write.mode("overwrite").partitionBy(folder).text(path)
