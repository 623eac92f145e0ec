"""Text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .udfs import ONE_TO_ONE, fold, nfc, normalized_json

#: The one mark of typography that becomes two characters. Fixed value.
PARAGRAPH_SEPARATOR = ("\u2029", "\n\n")
ARTICLE = r"^(?:(?:le|la|les|the) |l')"


def normalize_text(c: Column) -> Column:
    """Line ends as LF, plain quotes and spaces, canonical composition; case, accents and words stay."""
    lines = F.regexp_replace(c, "\r\n?", "\n")
    return nfc(F.replace(F.translate(lines, *ONE_TO_ONE), F.lit(PARAGRAPH_SEPARATOR[0]), F.lit(PARAGRAPH_SEPARATOR[1])))


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def comparison_text(c: Column) -> Column:
    return squeeze(normalize_text(c))


def contained(needle: Column, hay: Column) -> Column:
    """Whether a comparison text holds another; an empty one is in none."""
    return (F.length(needle) > 0) & F.contains(hay, needle)


def natural_key(c: Column, width: int = 12) -> Column:
    """One sortable string: digits padded, the rest folded."""
    parts = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, width, "0")).otherwise(F.lower(p))), "\u0001")


def slug(c: Column, most: int | None = 64) -> Column:
    cleaned = F.btrim(F.regexp_replace(c, r"(?U)[^\w.-]+", "_"), F.lit("._"))
    short = F.left(cleaned, F.lit(most)) if most else cleaned
    return F.coalesce(F.nullif(short, F.lit("")), F.lit("chapter"))


def folded(c: Column) -> Column:
    return fold(c)


def name_key(c: Column) -> Column:
    """Folded, punctuation as spaces, squeezed."""
    return squeeze(F.regexp_replace(fold(c), r"(?U)[^\w]+|_", " "))


def attribute_key(c: Column) -> Column:
    return F.btrim(F.regexp_replace(fold(c), r"(?U)[^\w]+", "_"), F.lit("_"))


def entity_key(c: Column) -> Column:
    """Folded and squeezed, without one leading article."""
    return F.regexp_replace(F.replace(squeeze(fold(c)), F.lit("’"), F.lit("'")), ARTICLE, "")


def digest_id(prefix: str, width: int, *columns: Column) -> Column:
    """A stable id: prefix and hex digits of the SHA-256 over a separated rendering; null differs from empty."""
    marked = [F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in columns]
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("\u001f", *marked), 256), F.lit(width)))


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    return F.regexp_count(F.left(text, offset), F.lit("\n")) + 1


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\b[\w'-]+\b"))


def leaks_metadata(c: Column) -> Column:
    return c.rlike(r"(?mi)^\s*source_excerpt\s*:")


def timestamp_seconds(c: Column) -> Column:
    """MM:SS.mmm as seconds."""
    minutes, seconds = F.regexp_extract(c, r"^(\d+):", 1), F.regexp_extract(c, r":(\d+(?:\.\d+)?)$", 1)
    return F.expr("try_cast(0 as double)") + minutes.try_cast("double") * 60 + seconds.try_cast("double")


def path_key(c: Column) -> Column:
    return fold(F.replace(c, F.lit("/"), F.lit("\\")))


def ranked_value(column: Column, order: list[str]) -> Column:
    """Position of a value in an ordered list; values outside it come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), column), F.lit(0)), F.lit(len(order) + 1))


def dedupe_folded(names: Column, most: int = 50) -> Column:
    """First spelling of each squeezed name, case aside, at most so many."""
    clean = F.filter(F.transform(names, squeeze), lambda n: F.length(n) > 0)
    kept = F.aggregate(clean, F.array().cast("array<string>"), lambda acc, n: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(n)), acc).otherwise(F.array_append(acc, n)))
    return F.slice(kept, 1, most)


def compact_strings(values: Column, length: int, most: int, verbatim: bool = False) -> Column:
    """Distinct strings of at most so many characters, at most so many of them; their white space is squeezed or, verbatim, kept."""
    cut = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.left(v if verbatim else squeeze(v), F.lit(length)))
    return F.slice(F.array_distinct(F.filter(cut, lambda v: F.length(F.trim(v)) > 0)), 1, most)


def reply_json(c: Column) -> Column:
    """A reply's JSON as a variant: without thinking blocks and fences, else what the outermost braces hold."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), r"(?m)^```\w*\s*$", ""))
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1)))


#: Sections of a scene prompt, in order. Fixed values.
SECTIONS = ["subject_definitions", "summary", "retention_analysis", "detailed_description", "overall_soundscape", "non_diegetic_music"]


def section_body(c: Column, name: str) -> Column:
    """What stands under a section's heading, up to the next section's; empty if the heading is not there."""
    at = SECTIONS.index(name)
    stop = rf"(?=^\s*{SECTIONS[at + 1]}\s*:\s*$)|\z" if at + 1 < len(SECTIONS) else r"\z"
    return F.regexp_replace(F.regexp_extract(c, rf"(?mi)^\s*{name}\s*:[ \t]*$([\s\S]*?)(?:{stop})", 1), r"^\s+|\s+$", "")


def section_map(c: Column) -> Column:
    """Section name to its body, of the sections that have one."""
    parts = [x for s in SECTIONS for x in (F.lit(s), section_body(c, s))]
    return F.map_filter(F.create_map(*parts), lambda k, v: F.length(v) > 0)


def headings(c: Column) -> Column:
    """Names of the sections whose headings stand in a text, in the order in which they do."""
    return F.regexp_extract_all(c, F.lit(rf"(?m)^[ \t]*({'|'.join(SECTIONS)})[ \t]*:[ \t]*$"), F.lit(1))


def fully_sectioned(c: Column) -> Column:
    """Whether every section is there once, in order, and nothing but white space stands before the first."""
    return (headings(c) == F.array(*map(F.lit, SECTIONS))) & c.rlike(rf"\A\s*{SECTIONS[0]}[ \t]*:")


def sections_text(sections: Column) -> Column:
    """The canonical text of a section map: headings on lines of their own."""
    parts = [F.when(F.map_contains_key(sections, F.lit(s)), F.concat(F.lit(f"{s}:\n"), sections[s])) for s in SECTIONS]
    return F.concat_ws("\n\n", *parts)


def canonical_sections(c: Column) -> Column:
    """The text with a body that follows its heading on one line moved to the next, and a space after each dialogue's language."""
    out = F.regexp_replace(F.btrim(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""), F.lit(" \n\r\t")), r"(<d>\s*\[[^\]]+\])(?=[^\s<])", "$1 ")
    for s in SECTIONS:
        out = F.regexp_replace(out, rf"(?mi)^[ \t]*{s}[ \t]*:[ \t]*(?=\S)", f"{s}:\n")
    return out


def replaced_sections(c: Column, new: Column) -> Column:
    """The text with the bodies of a map's sections; a text that is not fully sectioned becomes the map's, if it has all sections, else null."""
    merged = F.map_zip_with(section_map(c), new, lambda k, old, given: F.coalesce(given, old))
    every = F.size(F.array_intersect(F.map_keys(new), F.array(*map(F.lit, SECTIONS)))) == len(SECTIONS)
    return F.when(fully_sectioned(c), sections_text(merged)).when(every, sections_text(new))


def pointer_value(document: Column, pointer: str) -> Column:
    """A JSON pointer's value in a variant, as a string; null if the path is absent."""
    path = "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in pointer.strip("/").split("/") if p)
    return F.try_variant_get(document, path, "string")


def normalize_nested(value: Column, kind: str) -> Column:
    """A nested value with every string in it normalized, whatever its depth; keys and other values stay. ``kind`` is its type."""
    return F.from_json(normalized_json(F.to_json(value)), kind)


def clean_entity(e: Column, character: Column) -> list[Column]:
    """The fields of an extracted entity that are kept, within their bounds: canonical_name, aliases, evidence, reference_view_hints,
    and of a character voice_description and speaks. ``e``: a struct with these fields; a null list is an empty one."""
    return [
        squeeze(F.coalesce(e["canonical_name"], F.lit(""))).alias("canonical_name"),
        compact_strings(e["aliases"], 80, 6).alias("aliases"),
        compact_strings(e["evidence"], 120, 3, verbatim=True).alias("evidence"),
        F.slice(F.array_distinct(F.coalesce(e["reference_view_hints"], F.array().cast("array<string>"))), 1, 5).alias("reference_view_hints"),
        F.when(character, squeeze(F.coalesce(e["voice_description"], F.lit("")))).alias("voice_description"),
        F.when(character, F.coalesce(e["speaks"], F.lit(False))).alias("speaks"),
    ]


def default_period(c: Column) -> Column:
    """A period default as given, trimmed; null and blank are empty."""
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(" \n\r\t"))
