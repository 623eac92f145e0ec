"""Constraint queries: every rule returns its violations as rows (rule, key, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def violations(rows: DataFrame, rule: str, key: Column, detail: Column | None = None) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), (F.lit("") if detail is None else detail.cast("string")).alias("detail"))


def strict(found: DataFrame) -> None:
    """Raise an error that names the first rules broken."""
    first = found.limit(5).collect()
    if first:
        raise ValueError("; ".join(f"{r['rule']}: {r['key']} {r['detail']}".strip() for r in first))


def duplicate_keys(rows: DataFrame, keys: list[str], rule: str = "duplicate_key") -> DataFrame:
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return violations(counts, rule, F.concat_ws("/", *keys), F.col("_n"))


def id_coverage(expected: DataFrame, returned: DataFrame, key: str) -> DataFrame:
    """Ids that are missing, foreign or returned more than once."""
    e = expected.select(key).distinct().withColumn("_e", F.lit(True))
    r = returned.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    joined = e.join(r, key, "full_outer")
    rule = F.when(F.col("_n").isNull(), "missing").when(F.col("_e").isNull(), "foreign").when(F.col("_n") > 1, "repeated")
    return joined.withColumn("_r", rule).filter("_r IS NOT NULL").select(F.col("_r").alias("rule"), F.col(key).cast("string").alias("key"), F.coalesce(F.col("_n"), F.lit(0)).cast("string").alias("detail"))


def salvage(rows: DataFrame, known: DataFrame, key: str, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(rows kept, refused): a row stays if its id is known, occurs once, and it is valid by itself."""
    counted = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    marked = counted.join(known.select(key).distinct().withColumn("_k", F.lit(True)), key, "left")
    reason = F.when(F.col("_k").isNull(), "foreign id").when(F.col("_n") > 1, "repeated id").when(~F.coalesce(valid, F.lit(False)), "invalid")
    marked = marked.withColumn("reason", reason).drop("_n", "_k")
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def digest_mismatch(rows: DataFrame, key: str, text_col: str, digest_col: str) -> DataFrame:
    bad = rows.filter(~F.sha2(F.coalesce(text_col, F.lit("")), 256).eqNullSafe(F.col(digest_col)))
    return violations(bad, "sha_mismatch", F.col(key))


def link_chains(rows: DataFrame, key: str, link: str) -> DataFrame:
    """Links to themselves, to rows that link on, or to nothing."""
    t = rows.select(F.col(key).alias("_t"), F.col(link).alias("_next"))
    joined = rows.filter(F.col(link).isNotNull()).join(t, F.col(link) == F.col("_t"), "left")
    rule = F.when(F.col(key) == F.col(link), "self_link").when(F.col("_t").isNull(), "dangling_link").when(F.col("_next").isNotNull(), "chained_link")
    return joined.withColumn("_r", rule).filter("_r IS NOT NULL").select(F.col("_r").alias("rule"), F.col(key).cast("string").alias("key"), F.col(link).cast("string").alias("detail"))


def binding_violations(bindings: DataFrame, scenes: DataFrame, keys: list[str]) -> DataFrame:
    """Bindings of scenes where the subject is not visible, and bindings that repeat. ``scenes``: keys, presence."""
    lost = bindings.join(scenes.filter("presence = 'visible'").select(*keys), keys, "left_anti")
    return violations(lost, "not_visible", F.concat_ws("/", *keys)).unionByName(duplicate_keys(bindings, keys, "repeated_binding"))


def future_evidence(rows: DataFrame) -> DataFrame:
    """Explicit evidence that cites a later sequence: chapter, sequence, source_sequence, evidence."""
    return violations(rows.filter((F.col("evidence") == "explicit") & (F.col("source_sequence") > F.col("sequence"))), "future_evidence", F.concat_ws("/", "chapter", "sequence"), F.col("source_sequence"))


def spread_doubts(reviews: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """A review row counts for its target, or as a doubt on every target if the one it names does not exist."""
    n = targets.groupBy(key).agg(F.max("target").alias("_n"))
    rows = reviews.join(n, key)
    usable = F.col("target").between(1, F.col("_n"))
    numbers = F.when(usable, F.array("target")).otherwise(F.sequence(F.lit(1), F.col("_n")))
    return rows.select(key, "issue", F.explode(numbers).alias("target"), F.when(F.coalesce(usable, F.lit(False)), "issue").otherwise("doubt").alias("status"))


#: Lint limits. Fixed values.
MOST_WORDS, SHOT_SECONDS = 540, 2.5
def order_violations(rows: DataFrame, keys: list[str], order: str, first: int = 1) -> DataFrame:
    """Rows that break a numbering which must rise by one from ``first``: keys, order, rule ('not_increasing' or 'gap')."""
    w = Window.partitionBy(*keys).orderBy(order)
    seen = rows.select(*keys, order, (F.row_number().over(w) - 1 + first).alias("_k"), F.lag(order).over(w).alias("_p"))
    return seen.filter(F.col(order) != F.col("_k")).select(*keys, order, F.when(F.col(order) <= F.col("_p"), "not_increasing").otherwise("gap").alias("rule"))


def sequence_violations(rows: DataFrame, chapter: str, place: str) -> DataFrame:
    """Sequences that break the shape of a chapter: chapter, sequence, rule. ``rows``: chapter, place (in the document), sequence, source
    and adaptation (a struct of texts, the first and last of which are the states before and after).

    Numbers rise with the place; neither the source nor a state is blank.
    """
    names = rows.schema["adaptation"].dataType.names
    blank = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) == 0
    before = F.lag("sequence").over(Window.partitionBy(chapter).orderBy(place))
    rules = F.array_compact(F.array(
        F.when(F.col("sequence").isNull() | (F.col("sequence") < 1) | F.coalesce(F.col("sequence") <= before, F.lit(False)), "not_increasing"),
        F.when(blank(F.col("source")), "blank_source"),
        F.when(blank(F.col(f"adaptation.{names[0]}")) | blank(F.col(f"adaptation.{names[-1]}")), "blank_state"),
    ))
    return rows.select(chapter, "sequence", rules.alias("_r")).select(chapter, "sequence", F.explode("_r").alias("rule"))


def plan_violations(plans: DataFrame, keys: list[str]) -> DataFrame:
    """Broken rules of scene plans: keys, rule, detail (the place within the plan).

    ``plans``: keys, source, seconds (array of double: beats, then the pause), stated (double), reset, reset_evidence and updates (array
    of struct entity, aspect, fact, source_quote). Numbers are finite, their sum is positive and near the stated total; a reset
    quotes the source and only a reset does; facts are not blank and quote the source.
    """
    source = T.comparison_text(F.col("source"))
    quoted = lambda q: T.contained(T.comparison_text(F.coalesce(q, F.lit(""))), F.col("_source"))
    rows = plans.withColumn("_source", source)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    wild = ~F.forall(F.array_append("seconds", F.col("stated")), finite)
    total = F.aggregate("seconds", F.lit(0.0), lambda s, x: s + x)
    off = (total <= 0) | (F.abs(total - F.col("stated")) > 0.05)
    rule = lambda test, name, detail: F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(detail).alias("detail")))
    reset_quote = F.coalesce("reset_evidence", F.lit(""))
    whole = rows.select(*keys, F.inline(F.array_compact(F.array(
        rule(wild, "timing_nonfinite", "/timing"),
        rule(~wild & off, "timing_total_mismatch", "/timing/estimated_seconds"),
        rule(F.when(F.col("reset"), ~quoted(reset_quote)).otherwise(F.length(reset_quote) > 0), "reset_quote_mismatch", "/continuity/reset_evidence"),
    ))))
    facts = rows.select(*keys, "_source", F.posexplode("updates").alias("_i", "_u"))
    blank = F.lit(False)
    for c in ("entity", "fact", "source_quote"):
        blank = blank | (F.length(F.trim(F.coalesce(F.col(f"_u.{c}"), F.lit("")))) == 0)
    broken = F.when(blank | (T.entity_key(F.coalesce("_u.entity", F.lit(""))) == ""), "blank_fact_field").when(~quoted(F.col("_u.source_quote")), "source_quote_mismatch")
    each = facts.select(*keys, broken.alias("rule"), F.concat(F.lit("/continuity/updates/"), F.col("_i").cast("string")).alias("detail")).filter("rule IS NOT NULL")
    return whole.unionByName(each)


LABELS = ("Subject", "Picture", "Audio", "Video")


def lint(rows: DataFrame, key: str, text_col: str, bound: str, duration: float, most_shots: int) -> DataFrame:
    """Broken rules of scene texts: key, rule, detail. ``bound``: column with the array of labels that exist.

    Rules: word limit, code fence, unbound labels, shots present, numbered 1..n and not more than the limit, timestamps on every shot
    but the first, rising, and at least SHOT_SECONDS apart up to the end.
    """
    text = F.col(text_col)
    labels = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"<(?:{'|'.join(LABELS)}) \d+>"), F.lit(0)))
    shots = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^Shot (\d+):"), F.lit(1)), lambda x: x.cast("int"))
    stamps = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^Shot \d+: At (\d+:\d\d\.\d{3}),"), F.lit(1)), lambda s: F.split(s, ":")[0].cast("double") * 60 + F.split(s, ":")[1].cast("double"))
    times = F.concat(F.array(F.lit(0.0)), stamps, F.array(F.lit(float(duration))))
    gaps = F.transform(F.sequence(F.lit(1), F.size(times) - 1), lambda i: F.element_at(times, (i + 1).cast("int")) - F.element_at(times, i.cast("int")))
    least = min(SHOT_SECONDS, duration)
    cap = max(1, min(most_shots, int(duration // SHOT_SECONDS)))
    loose = F.array_sort(F.array_except(labels, F.col(bound)))
    rules = {
        "too_long": (F.regexp_count(text, F.lit(r"(?U)\b[\w'-]+\b")) > MOST_WORDS, F.lit("")),
        "code_fence": (F.contains(text, F.lit("```")), F.lit("")),
        "unbound_label": (F.size(loose) > 0, F.array_join(loose, ",")),
        "no_shot": (F.size(shots) == 0, F.lit("")),
        "shot_numbering": ((F.size(shots) > 0) & ~shots.eqNullSafe(F.sequence(F.lit(1), F.greatest(F.size(shots), F.lit(1)))), F.array_join(shots, ",")),
        "too_many_shots": (F.size(shots) > cap, F.size(shots).cast("string")),
        "missing_timestamp": ((F.size(shots) > 0) & (F.size(stamps) != F.size(shots) - 1), F.size(stamps).cast("string")),
        "short_shot": (F.exists(gaps, lambda g: g < least - 1e-9), F.lit("")),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(rule).alias("rule"), detail.alias("detail"))) for rule, (test, detail) in rules.items()]))
    return rows.select(F.col(key), F.inline(found))


def json_rules(rows: DataFrame, key: str, variant_col: str, required: dict[str, str], optional: dict[str, str] | None = None) -> DataFrame:
    """Shape violations of a JSON object column (variant): missing, wrongly typed or unknown fields.

    Types are those of ``schema_of_variant`` (BIGINT, STRING, BOOLEAN, DOUBLE, ARRAY, OBJECT), so a boolean is not a number.
    """
    fields = required | (optional or {})
    parts = []
    for name, kind in fields.items():
        value = F.try_variant_get(variant_col, f"$.{name}", "variant")
        shape = F.schema_of_variant(value)
        wrong = value.isNotNull() & ~F.startswith(shape, F.lit(kind))
        missing = value.isNull() if name in required else F.lit(False)
        parts.append(F.when(missing, F.struct(F.lit("missing_field").alias("rule"), F.lit(name).alias("detail"))).when(wrong, F.struct(F.lit("wrong_type").alias("rule"), F.lit(name).alias("detail"))))
    names = F.json_object_keys(F.to_json(F.col(variant_col)))
    extra = F.transform(F.array_sort(F.array_except(names, F.array(*map(F.lit, fields)))), lambda n: F.struct(F.lit("unknown_field").alias("rule"), n.alias("detail")))
    return rows.select(F.col(key), F.inline(F.concat(F.array_compact(F.array(*parts)), F.coalesce(extra, F.array().cast("array<struct<rule:string,detail:string>>")))))
