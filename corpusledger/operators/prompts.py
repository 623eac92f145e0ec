"""Sectioned scene prompts: their sections, the strings they are made of, and the rules they must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .decisions import strictly_fewer

# The tasks that a summary may name, the markers of what is kept of a reference, the longest description
# in words, and the shortest shot in seconds.
TASKS = ["keyframe completion", "reference generation", "video editing", "video continuation", "audio reuse", "audio reference"]
VISIBLE_MARKERS = ["fully_preserved", "partially_preserved", "attribute_transfer", "weak_reference"]
AUDIO_MARKERS = ["fully_copy", "partially_copy", "reference", "weak_reference"]
MOST_WORDS, SHOT_SECONDS = 540, 2.5
# Fixed value: what ends every image prompt.
CLOSING = "Single image, single view. No added captions or watermark."


def allowed_shots(duration: Column, most: int) -> Column:
    """How many shots fit into a duration: each has a least length, and there are at most ``most``, one at least."""
    return F.least(F.lit(max(1, most)), F.greatest(F.lit(1), F.floor((duration + 1e-6) / SHOT_SECONDS).cast("int")))


def pacing(duration: Column, most: int) -> Column:
    """The sentence that states the pace of a scene."""
    cap, whole = allowed_shots(duration, most), F.format_string("%s s", duration.cast("string"))
    return F.when(cap == 1, F.concat(F.lit("One continuous shot of "), whole, F.lit("."))).otherwise(F.concat(F.lit("At most "), cap.cast("string"), F.lit(" shots within "), whole, F.lit(f"; each lasts {SHOT_SECONDS} s or more.")))


def expected_tasks(has_frame: Column, has_audio: Column) -> Column:
    """The tasks that a summary must name, by what its scene is bound to."""
    first = F.when(has_frame, "keyframe completion").otherwise("reference generation")
    return F.when(has_audio, F.array(first, F.lit("audio reference"))).otherwise(F.array(first))


def image_prompt(name: Column, style: Column, framing: Column, appearance: Column, composition: Column) -> Column:
    """One image's text: framing, style and name, appearance, composition, and what it must not have; empty parts are left out."""
    subject = F.concat(style, F.lit(" image of "), F.trim(name))
    ended = F.when(subject.rlike(r"[.!?]$"), subject).otherwise(F.concat(subject, F.lit(".")))
    shown = F.concat(F.rtrim(appearance, F.lit(". ")), F.lit("."))
    parts = [framing, ended, shown, F.trim(composition), F.lit(CLOSING)]
    return F.concat_ws(" ", *[F.nullif(F.coalesce(p, F.lit("")), F.lit("")) for p in parts])


def prompt_violations(rows: DataFrame, key: str, text_col: str, most_shots: int = 1) -> DataFrame:
    """Broken rules of sectioned prompts: key, rule, detail. ``rows`` is as ``with_broken`` has it."""
    # more than one section may be missing or repeated: each is a row of its own
    return with_broken(rows, "_found", text_col, most_shots).select(key, F.inline(F.array_compact("_found")))


def with_broken(rows: DataFrame, name: str, text_col: str, most_shots: int = 1) -> DataFrame:
    """Sectioned prompts with the rules that they break, in a column: an array of struct rule, detail, null for each that it keeps.

    ``rows`` has besides: duration (seconds), subjects (array of struct label, pictures), audio (array of labels) and has_frame. The
    rules: no internal ids outside dialogue; every section once, in order; the expected tasks; shots numbered from 1, the first without a
    time, the others with rising times within the duration and far enough apart; dialogue with its language; no fence; labels that
    are bound, defined and cited; markers that exist.
    """
    text, duration, given = F.col(text_col), F.col("duration"), rows.columns
    every = lambda pattern, group=0, of=text: F.regexp_extract_all(of, F.lit("(?U)" + pattern), F.lit(group))
    none = F.array().cast("array<string>")
    found: list[Column] = []

    def rule(name: str, test: Column, detail: Column | None = None) -> None:
        found.append(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.coalesce(detail if detail is not None else F.lit(""), F.lit("")).alias("detail"))))

    # each step is columns of its own: what several rules ask of a text is found once, not once a rule or an element
    heads = [rf"(?mi)^\s*{s}\s*:\s*$" for s in T.SECTIONS]
    bodies = {"_summary": "summary", "_detailed": "detailed_description", "_defs": "subject_definitions", "_kept": "retention_analysis"}
    rows = rows.withColumns({"_heads": F.array(*[F.regexp_count(text, F.lit(h)) for h in heads]), "_at": F.array(*[F.regexp_instr(text, F.lit(h)) for h in heads])} | {c: T.section_body(text, s) for c, s in bodies.items()})
    summary, detailed, defs, kept = map(F.col, bodies)
    stamp = r"\[Shot\s+(\d+)\] At (\d{2}):(\d{2})\.(\d{3}), "
    marked = r"(?m)^\s*<(Subject|Video|Audio)\s+\d+>.*?:\s*([a-z_]+)\s*-"
    rows = rows.withColumns({
        "_bracket": F.regexp_extract(summary, r"^\[([^\]]+)\]", 1),
        "_numbers": F.transform(every(r"\[Shot\s+(\d+)\]", 1, detailed), lambda n: n.cast("int")),
        "_stamps": F.arrays_zip(*[every(stamp, i, detailed).alias(n) for i, n in ((1, "shot"), (2, "m"), (3, "s"), (4, "ms"))]),
        "_words": T.word_count(detailed),
        "_lines": F.transform(F.split(defs, r"\r?\n"), lambda x: F.lower(F.ltrim(x))),
        "_marks": F.arrays_zip(every(marked, 1, kept).alias("k"), every(marked, 2, kept).alias("m")),
    })
    own = lambda s: F.filter("_lines", lambda x: F.startswith(x, F.lower(s["label"])) & F.substring(x, F.length(s["label"]) + 1, F.lit(1)).isin("", " ", "\t", ":"))
    bound = {"Subject": F.transform("subjects", lambda s: s["label"]), "Picture": F.flatten(F.transform("subjects", lambda s: s["pictures"])), "Audio": F.col("audio"), "Video": none}
    rows = rows.withColumns({
        "_tasks": F.transform(F.split("_bracket", r"\+"), lambda t: F.trim(t)),
        "_wanted": expected_tasks(F.col("has_frame"), F.size("audio") > 0),
        "_later": F.filter("_stamps", lambda p: p["shot"].cast("int") != 1),
        "_own": F.transform("subjects", lambda s: F.struct(s["label"].alias("label"), s["pictures"].alias("pictures"), own(s).alias("lines"))),
        "_wrong": F.filter("_marks", lambda z: F.when(z["k"] == "Audio", ~z["m"].isin(AUDIO_MARKERS)).otherwise(~z["m"].isin(VISIBLE_MARKERS))),
    } | {f"_loose{kind}": F.array_sort(F.array_except(every(rf"<{kind}\s+\d+>"), labels)) for kind, labels in bound.items()})
    pairs = lambda c: F.when(F.size(c) > 1, F.transform(F.sequence(F.lit(2), F.size(c)), lambda i: F.element_at(c, i) - F.element_at(c, i - 1))).otherwise(F.array().cast("array<double>"))
    numbers, later = F.col("_numbers"), F.col("_later")
    rows = rows.withColumns({
        "_unknown": F.array_except("_tasks", F.array(*map(F.lit, TASKS))),
        "_dense": numbers == F.sequence(F.lit(1), F.greatest(F.size(numbers), F.lit(1))),
        "_complete": F.size(later) == F.size(F.filter(numbers, lambda n: n != 1)),
        "_over": F.exists(later, lambda p: p["s"].cast("int") >= 60),
        "_times": F.transform(later, lambda p: p["m"].cast("double") * 60 + p["s"].cast("double") + p["ms"].cast("double") / 1000),
        "_missing": F.concat(F.transform(F.filter("_own", lambda s: F.size(s["lines"]) == 0), lambda s: s["label"]), F.filter("audio", lambda a: ~F.contains(defs, a))),
        "_uncited": F.flatten(F.transform(F.filter("_own", lambda s: F.size(s["lines"]) > 0), lambda s: F.filter(s["pictures"], lambda p: ~F.contains(s["lines"][0], F.lower(p))))),
    })
    rows = rows.withColumn("_steps", F.concat(F.array(F.lit(0.0)), "_times")).withColumn("_ends", F.concat("_steps", F.array(duration)))
    rows = rows.withColumns({"_rises": pairs(F.col("_steps")), "_gaps": pairs(F.col("_ends"))})

    rule("internal_id", F.regexp_replace(text, r"(?s)<d>.*?</d>", "").rlike(r"(?i)\b(?:PIC|AUD|CHAR|LOC|OBJ)_[A-Z0-9_]+\b"))
    for i, s in enumerate(T.SECTIONS):
        rule("section_count", F.col("_heads")[i] != 1, F.concat(F.lit(s + ":"), F.col("_heads")[i].cast("string")))
    rule("section_order", F.forall("_at", lambda x: x > 0) & (F.col("_at") != F.array_sort("_at")))
    named = F.length("_bracket") > 0
    rule("task_missing", ~named)
    rule("task_repeated", named & (F.size(F.array_distinct("_tasks")) < F.size("_tasks")))
    rule("task_unknown", named & (F.size("_unknown") > 0), F.array_join("_unknown", ","))
    rule("task_unexpected", named & (F.col("_tasks") != F.col("_wanted")), F.array_join("_wanted", " + "))
    rule("no_shot", F.size(numbers) == 0)
    rule("shot_numbering", (F.size(numbers) > 0) & ~F.col("_dense"), F.array_join(numbers, ","))
    rule("first_shot_timed", detailed.rlike(r"(?i)\[Shot\s+1\]\s+(?:At\s+)?\d+:\d+(?:\.\d+)?"))
    rule("too_many_shots", F.size(numbers) > allowed_shots(duration, most_shots), F.size(numbers).cast("string"))
    if most_shots == 1:
        rule("not_one_shot", numbers != F.array(F.lit(1)))
    rule("missing_timestamp", ~F.col("_complete"))
    rule("bad_seconds", F.col("_over"))
    rule("times_not_rising", F.exists("_rises", lambda d: d <= 0))
    rule("time_beyond_end", F.exists("_times", lambda t: t > duration + 1e-6))
    whole = (F.size(numbers) > 0) & F.col("_dense") & F.col("_complete") & ~F.col("_over") & F.forall("_gaps", lambda d: d >= 0)
    rule("short_shot", whole & F.exists("_gaps", lambda d: d + 1e-6 < F.least(F.lit(SHOT_SECONDS), duration)))
    rule("too_long", F.col("_words") > MOST_WORDS, F.col("_words").cast("string"))
    rule("dialogue_language", F.exists(every(r"(?s)<d>(.*?)</d>", 1), lambda d: ~F.regexp_replace(d, r"^\s+|\s+$", "").rlike(r"(?s)^\[[^\]]+\]\s+.+")))
    rule("code_fence", F.contains(text, F.lit("```")))
    for kind in bound:
        rule("unbound_label", F.size(f"_loose{kind}") > 0, F.array_join(f"_loose{kind}", ","))
    rule("undefined_label", F.size("_missing") > 0, F.array_join("_missing", ","))
    rule("uncited_picture", F.size("_uncited") > 0, F.array_join("_uncited", ","))
    rule("picture_kept_alone", kept.rlike(rf"(?m)^\s*<Picture\s+\d+>.*?:\s*(?:{'|'.join(VISIBLE_MARKERS)})\s*-"))
    rule("speaker_kept", kept.rlike(r"\(S\d+\)"))
    rule("unknown_marker", F.size("_wrong") > 0, F.array_join(F.transform("_wrong", lambda z: z["m"]), ","))
    return rows.select(*given, F.array(*found).alias(name))


#: Sections that each rule concerns; rules that are not named concern all, or those where their cause stands (``routed``).
ROUTES = {
    "summary": ["task_missing", "task_repeated", "task_unknown", "task_unexpected"],
    "subject_definitions": ["undefined_label", "uncited_picture"],
    "retention_analysis": ["picture_kept_alone", "speaker_kept", "unknown_marker"],
    "detailed_description": ["no_shot", "shot_numbering", "first_shot_timed", "too_many_shots", "not_one_shot", "missing_timestamp", "bad_seconds", "times_not_rising", "time_beyond_end", "short_shot", "too_long"],
}


def routed(found: DataFrame, rows: DataFrame, key: str, text_col: str) -> DataFrame:
    """Violations with the sections whose bodies are to be written anew: key, rule, detail, sections (array, in order).

    A fence, dialogue without its language and an unbound label concern the sections where they stand; what stands in none, and all
    that concerns the prompt as a whole, all sections.
    """
    asked = F.col("rule").isin("code_fence", "dialogue_language", "unbound_label")
    body = {s: F.col("_bodies")[i] for i, s in enumerate(T.SECTIONS)}
    every = F.array(*map(F.lit, T.SECTIONS))
    where = lambda test: F.array_compact(F.array(*[F.when(test(b), F.lit(s)) for s, b in body.items()]))
    mute = lambda b: F.exists(F.regexp_extract_all(b, F.lit(r"(?s)<d>(.*?)</d>"), F.lit(1)), lambda d: ~F.regexp_replace(d, r"^\s+|\s+$", "").rlike(r"(?s)^\[[^\]]+\]\s+.+"))
    standing = (
        F.when(F.col("rule") == "code_fence", where(lambda b: F.contains(b, F.lit("```"))))
        .when(F.col("rule") == "dialogue_language", where(mute))
        .when(F.col("rule") == "unbound_label", where(lambda b: F.exists(F.split("detail", ","), lambda x: F.contains(b, x))))
    )
    fixed = F.lit(None).cast("array<string>")
    for section, rules in ROUTES.items():
        fixed = F.when(F.col("rule").isin(rules), F.array(F.lit(section))).otherwise(fixed)
    sections = F.coalesce(fixed, F.when(F.size(standing) > 0, standing), every)
    met = found.join(rows.select(key, F.col(text_col).alias("_text")), key)
    met = met.withColumn("_bodies", F.when(asked, F.array(*[T.section_body(F.col("_text"), s) for s in T.SECTIONS])))
    return met.select(key, "rule", "detail", sections.alias("sections"))


def label_repairs(rows: DataFrame, key: str, text_col: str, most_shots: int = 1) -> DataFrame:
    """Rows with asset ids in definitions replaced by their picture labels where that mends the prompt, and ``repaired``.

    ``rows`` as ``prompt_violations`` has them, and assets (array of struct label, asset, picture). In the line that defines a label, an asset of it
    that stands for one picture only is replaced as a whole word; nothing else of the text changes. A repaired text stays only if the
    rules that it breaks are a strict part of those before.
    """
    text, body = F.col(text_col), T.section_body(F.col(text_col), "subject_definitions")
    head = r"(?mi)^\s*subject_definitions\s*:[ \t]*$"
    same = lambda a, b: (a["label"] == b["label"]) & (a["asset"] == b["asset"])
    pictures = lambda a: F.array_distinct(F.transform(F.filter("assets", lambda b: same(a, b)), lambda b: b["picture"]))
    clear = F.filter("assets", lambda a: (F.length(a["asset"]) > 0) & (F.size(pictures(a)) == 1))

    def mended(line: Column) -> Column:
        own = F.filter(clear, lambda a: F.startswith(line, a["label"]) & F.substring(line, F.length(a["label"]) + 1, F.lit(1)).isin(" ", "\t", ":"))
        whole = lambda a: F.concat(F.lit(r"(?U)(?<!\w)\Q"), a["asset"], F.lit(r"\E(?!\w)"))
        return F.aggregate(own, line, lambda now, a: F.regexp_replace(now, whole(a), a["picture"]))

    new = F.array_join(F.transform(F.split(body, "\n"), mended), "\n")
    # the body begins where it first stands behind its heading
    start = F.regexp_instr(text, F.lit(head)) + F.length(F.regexp_extract(text, head, 0))
    placed = rows.withColumns({"_body": body, "_new": new, "_start": start}).withColumn("_at", F.expr(f"locate(_body, `{text_col}`, _start)"))
    edit = F.when((F.col("_body") != F.col("_new")) & (F.col("_at") > 0), F.concat(F.left(text, F.col("_at") - 1), "_new", F.substring(text, F.col("_at") + F.length("_body"), F.length(text))))
    # all within a row, without a filter or join: a filter on the edit would be evaluated where rows are read, before they are dealt to many tasks;
    # a text without an edit is null to the rules, which cost little then
    edited = placed.withColumn("_edited", edit).select(*rows.columns, "_edited").withColumn("_given", F.when(F.col("_edited").isNotNull(), text))
    judged = with_broken(with_broken(edited, "_before", "_given", most_shots), "_after", "_edited", most_shots)
    better = F.col("_edited").isNotNull() & strictly_fewer(F.array_compact("_before"), F.array_compact("_after"))
    out = judged.withColumn("repaired", better)
    return out.select(*[F.when(F.col("repaired"), F.col("_edited")).otherwise(text).alias(c) if c == text_col else F.col(c) for c in rows.columns], "repaired")
