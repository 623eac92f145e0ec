"""Scene-addressed timelines, appearance, and the fact ledger."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .lineage import RANGE, checkpointed, in_ranges, keyed_rows

#: From most to least visible; scopes. Fixed values.
PRESENCE = ["visible", "offscreen", "mentioned"]
#: Facts that a ledger keeps at most. Fixed value.
MOST_FACTS = 24


def merge_timeline(rows: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """All observations of each address in order: keys, observations, none lost."""
    entry = F.struct(*[F.col(o) for o in order], value.alias("_v"))
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["_v"]).alias("observations"))


def first_occurrence(rows: DataFrame, entity: str = "entity", chapter: str = "chapter") -> DataFrame:
    """Per entity the first chapter and the first sequence within it."""
    first = F.min(F.struct(chapter, "sequence"))
    return rows.groupBy(entity).agg(first.alias("_f")).select(entity, F.col("_f")[chapter].alias("first_chapter"), F.col("_f.sequence").alias("first_sequence"))


def common_traits(rows: DataFrame) -> DataFrame:
    """Intrinsic attributes with exactly one description, case aside: entity, attribute, description (the first spelling)."""
    intrinsic = rows.filter("scope = 'intrinsic'").withColumn("_d", F.col("description").cast("string"))
    agg = intrinsic.groupBy("entity", "attribute").agg(F.min(F.lower("_d")).alias("_lo"), F.max(F.lower("_d")).alias("_hi"), F.min_by("_d", F.struct("chapter", "sequence", "ord")).alias("description"))
    return agg.filter("_lo = _hi").select("entity", "attribute", "description")


def scene_presence(rows: DataFrame) -> DataFrame:
    """Most visible presence of an entity at each address."""
    return rows.groupBy("entity", "chapter", "sequence").agg(F.min_by("presence", T.ranked_value(F.col("presence"), PRESENCE)).alias("presence"))


def local_traits(rows: DataFrame, common: DataFrame) -> DataFrame:
    """Distinct local values per address and attribute: values (number), description (of the last).

    Scene-scoped traits count, and intrinsic ones whose attribute has no common value; where an attribute has a scene-scoped
    trait at an address its intrinsic ones do not.
    """
    met = rows.withColumn("_d", F.col("description").cast("string")).join(common.select("entity", "attribute", F.lit(True).alias("_common")), ["entity", "attribute"], "left")
    address = ["entity", "chapter", "sequence", "attribute"]
    candidate = met.filter((F.col("scope") == "scene") | F.col("_common").isNull())
    scene = F.col("scope") == "scene"
    agg = candidate.groupBy(*address).agg(
        F.count_if(scene).alias("_scenes"),
        F.collect_set(F.when(scene, F.lower("_d"))).alias("_sv"),
        F.collect_set(F.when(~scene, F.lower("_d"))).alias("_iv"),
        F.max_by("_d", F.when(scene, F.col("ord"))).alias("_sl"),
        F.max_by("_d", F.when(~scene, F.col("ord"))).alias("_il"),
    )
    has = F.col("_scenes") > 0
    return agg.select(*address, F.when(has, F.size("_sv")).otherwise(F.size("_iv")).alias("n_values"), F.when(has, F.col("_sl")).otherwise(F.col("_il")).alias("description"))


def compile_appearance(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(common traits, scene states with presence and excluded attributes, scene traits).

    An attribute with two or more local values at an address is excluded there and its conflict is a row of the state; the
    common value is suppressed at that address too. Nothing is carried to other scenes.
    """
    common = common_traits(rows)
    local = local_traits(rows, common)
    excluded = local.filter("n_values > 1").groupBy("entity", "chapter", "sequence").agg(F.array_sort(F.collect_set("attribute")).alias("excluded_attributes"))
    state = scene_presence(rows).join(excluded, ["entity", "chapter", "sequence"], "left")
    state = state.withColumn("excluded_attributes", F.coalesce("excluded_attributes", F.array().cast("array<string>")))
    return common, state, local.filter("n_values = 1").drop("n_values")


def traits_at(common: DataFrame, state: DataFrame, local: DataFrame) -> DataFrame:
    """Traits of visible entities at every address: the common ones that are not excluded, overridden by the local ones."""
    address = ["entity", "chapter", "sequence"]
    seen = state.filter("presence = 'visible'")
    base = seen.join(common, "entity").filter(~F.array_contains("excluded_attributes", F.col("attribute"))).select(*address, "attribute", F.col("description").alias("_c"))
    own = local.join(seen.select(*address), address).select(*address, "attribute", F.col("description").alias("_l"))
    return base.join(own, [*address, "attribute"], "full_outer").select(*address, "attribute", F.coalesce("_l", "_c").alias("description"))


def variants(traits: DataFrame, state: DataFrame, common: DataFrame) -> DataFrame:
    """Scenes by appearance: entity, variant, n_scenes, first_chapter, first_sequence.

    The signature is the sorted set of attribute and folded description; it is ``base`` when it equals that of the common
    traits, else a digest.
    """
    address = ["entity", "chapter", "sequence"]
    pair = F.concat_ws("=", "attribute", F.lower("description"))
    sign = F.array_join(F.array_sort(F.collect_set(pair)), ";")
    scenes = state.filter("presence = 'visible'").select(*address).join(traits.groupBy(*address).agg(sign.alias("_s")), address, "left").fillna("", ["_s"])
    base = common.groupBy("entity").agg(sign.alias("_b"))
    marked = scenes.join(base, "entity", "left").fillna("", ["_b"])
    variant = F.when(F.col("_s") == F.col("_b"), "base").otherwise(F.concat(F.lit("state_"), F.left(F.sha2("_s", 256), F.lit(16))))
    grouped = marked.withColumn("variant", variant).groupBy("entity", "variant")
    first = F.min(F.struct("chapter", "sequence"))
    return grouped.agg(F.count(F.lit(1)).alias("n_scenes"), first.alias("_f")).select("entity", "variant", "n_scenes", F.col("_f.chapter").alias("first_chapter"), F.col("_f.sequence").alias("first_sequence"))


def collapse_equivalent(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Descriptions replaced by the representative that a decision confirmed: decisions have entity, attribute, description, selected."""
    d = decisions.groupBy("entity", "attribute", "description").agg(F.min("selected").alias("_sel"))
    return rows.join(d, ["entity", "attribute", "description"], "left").withColumn("description", F.coalesce("_sel", "description")).drop("_sel")


def resolve_presence(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(presence rows, unresolved rows) of rows chapter, sequence, local_id, presence, quote, label.

    Absent rows go; one quote and label on several ids makes those uncertain; a quote with two or more uncertain rows loses
    them to one unresolved row; unresolved labels that a certain row has are resolved.
    """
    here = ["chapter", "sequence"]
    kept = rows.filter("presence <> 'absent'").withColumn("_label", F.lower("label"))
    ids = kept.groupBy(*here, "quote", "_label").agg((F.count_distinct("local_id") > 1).alias("_many"))
    kept = kept.join(ids, [*here, "quote", "_label"]).withColumn("presence", F.when(F.col("_many"), "uncertain").otherwise(F.col("presence")))
    doubts = kept.groupBy(*here, "quote").agg(F.count_if(F.col("presence") == "uncertain").alias("_u"))
    kept = kept.join(doubts, [*here, "quote"])
    crowd = (F.col("presence") == "uncertain") & (F.col("_u") > 1)
    unresolved = kept.filter(crowd).select(*here, "quote").distinct().withColumn("label", F.lit("Unidentified character"))
    left = kept.filter(~crowd)
    certain = left.filter("presence <> 'uncertain'").select(*here, F.col("_label")).distinct()
    unresolved = unresolved.withColumn("_label", F.lower("label")).join(certain, [*here, "_label"], "left_anti").drop("_label")
    return left.select(*here, "local_id", "presence", "quote", "label"), unresolved


def advance(facts: list[dict], sequence: int, reset: bool, updates: list[dict], most: int | None = MOST_FACTS) -> list[dict]:
    """One step of the ledger: a reset empties it, an update retires all older facts of its entity, the last ``most`` stay."""
    changed = {u["key"] for u in updates}
    kept = [] if reset else [f for f in facts if f["key"] not in changed]
    kept += [u | {"sequence": sequence} for u in updates]
    return kept[-most:] if most else kept


LEDGER = "sequence int, entity string, aspect string, fact string, from_sequence int"
#: Facts that leave the ledger together.
WRITTEN = 20_000
FACT = "key:string,entity:string,aspect:string,fact:string,sequence:int"


def ledger_rows(updates: DataFrame, resets: DataFrame, chapter: str) -> DataFrame:
    """chapter, sequence, reset, updates (array in order); a sequence's updates are few."""
    ups = updates.groupBy(chapter, "sequence").agg(F.array_sort(F.collect_list(F.struct("update_no", T.entity_key(F.col("entity")).alias("key"), "entity", "aspect", "fact"))).alias("updates"))
    return resets.select(chapter, "sequence", "reset").join(ups, [chapter, "sequence"], "left").select(chapter, "sequence", "reset", "updates")


def steps_of(batches: Iterator[pd.DataFrame], chapter: str):
    """(chapter, sequence, reset, updates) of sorted rows, batch by batch."""
    for pdf, keys in keyed_rows(batches, [chapter]):
        for (key,), r in zip(keys, pdf.itertuples(index=False), strict=True):
            yield key, int(r.sequence), bool(r.reset), [dict(u) for u in r.updates] if r.updates is not None else []


def segment_summaries(dealt: DataFrame, chapter: str, most: int) -> DataFrame:
    """One row for a range's first and last chapter: what the segment does to any ledger that enters it.

    ``first_reset``; ``grown``: the sequences at which the segment's own facts first were 1, 2, ... up to ``most``; ``own``: its own facts that
    survive it. Which facts it retires is asked for the few that may enter it.
    """
    kind = dealt.schema[chapter].dataType.simpleString()
    columns = [RANGE, chapter, "is_first", "is_last", "last_sequence", "first_reset", "grown", "own"]

    def run(batches):
        begun, number, is_first, current = False, None, True, None
        facts, grown, cut, last = [], [], None, None

        def row(is_last):
            own = [{n: f[n] for n in ("key", "entity", "aspect", "fact", "sequence")} for f in facts]
            return pd.DataFrame([(number, current, is_first, is_last, last, cut, grown, own)], columns=columns)

        for pdf in batches:
            if not len(pdf):
                continue
            number = int(pdf[RANGE].iloc[0])
            for key, sequence, reset, given in steps_of([pdf], chapter):
                if not begun or key != current:
                    if begun and is_first:
                        yield row(False)
                    begun, is_first, current, facts, grown, cut = True, not begun, key, [], [], None
                facts = advance(facts, sequence, reset, given, most)
                grown += [sequence] * (len(facts) - len(grown))
                last = sequence
                cut = sequence if reset and cut is None else cut
        if begun:
            yield row(True)

    return dealt.mapInPandas(run, f"{RANGE} int, {chapter} {kind}, is_first boolean, is_last boolean, last_sequence int, first_reset int, grown array<int>, own array<struct<{FACT}>>")


def enter(facts: list[dict], grown: list[int], most: int) -> list[dict]:
    """Those of the facts that enter a segment (each with ``until``, the sequence that retires it, or None) which its growth lets live.

    A fact is dropped when itself, the newer ones that entered with it and the segment's own are more than ``most``. Newer ones
    only become fewer, so this can only happen at a sequence where the own facts are more than ever before.
    """
    kept = []
    for i, fact in enumerate(facts):
        pushed = False
        for many, at in enumerate(grown, 1):
            if fact["until"] is not None and at >= fact["until"]:
                break
            newer = sum(f["until"] is None or f["until"] > at for f in facts[i + 1 :])
            if many + newer >= most:
                pushed = True
                break
        if not pushed:
            kept.append(fact)
    return kept


def ledger_starts(dealt: DataFrame, chapter: str, most: int) -> dict[int, list[dict]]:
    """Range -> the ledger that its first chapter brings from the ranges before; at most ``most`` facts for each range."""
    known = checkpointed(segment_summaries(dealt, chapter, most))
    own = known.filter("is_last").select(RANGE, chapter, F.posexplode("own").alias("_i", "_f")).select(RANGE, chapter, "_i", "_f.*")
    # when the key of a fact that leaves its range is next updated: the first sequence of each range, then of the ranges that follow
    asked = F.broadcast(own.select(chapter, "key").distinct())  # most facts for each range
    updated = dealt.filter("updates IS NOT NULL").select(RANGE, chapter, "sequence", F.explode("updates.key").alias("key"))
    firsts = updated.join(asked, [chapter, "key"], "left_semi").groupBy(RANGE, chapter, "key").agg(F.min("sequence").alias("_first"))
    later = Window.partitionBy(chapter, "key").orderBy(RANGE).rangeBetween(1, Window.unboundedFollowing)
    ends = own.select(RANGE, chapter, "key", "_i").join(firsts, [RANGE, chapter, "key"], "full").withColumn("_until", F.min("_first").over(later))
    until = {(r[RANGE], r["_i"]): r["_until"] for r in ends.filter("_i IS NOT NULL").select(RANGE, "_i", "_until").collect()}
    starts: dict[int, list[dict]] = {}
    facts, current = [], None
    for r in known.orderBy(RANGE, F.desc("is_first")).collect():  # two rows for each range at most
        if not r["is_first"] or r[chapter] != current:
            facts = []
        elif facts:
            starts[r[RANGE]] = facts
        cut = r["first_reset"]
        entered = [f | {"until": min([u for u in (f["until"], cut) if u is not None], default=None)} for f in facts]
        facts = [f for f in enter(entered, r["grown"], most) if f["until"] is None or f["until"] > r["last_sequence"]]
        if r["is_last"]:
            facts += [f.asDict() | {"until": until[r[RANGE], i]} for i, f in enumerate(r["own"])]
            current = r[chapter]
    return starts


def fact_ledger(updates: DataFrame, resets: DataFrame, chapter: str = "chapter", most: int | None = MOST_FACTS, parts: int | None = None, last: bool = False) -> DataFrame:
    """Facts alive after every sequence: chapter, sequence, entity, aspect, fact, from_sequence.

    ``updates``: chapter, sequence, update_no, entity, aspect, fact; ``resets``: chapter, sequence, reset (one row per sequence);
    chapters and sequences are not null. A long chapter lies in several ranges (``parts`` in all, or as many as Spark makes), so it is not one task's: each range first tells what
    it does to a ledger that enters it, the ledgers that enter follow from these in turn, and all ranges fold at once. Without a
    bound (``most`` is None) a ledger may be as long as its chapter, and a chapter is one task's. With ``last`` only few sequences of a
    chapter come out, checkpointed; the last that has facts is one of them.
    """
    kind = resets.schema[chapter].dataType.simpleString()
    rows = ledger_rows(updates, resets, chapter)
    if most:
        dealt = in_ranges(rows, [chapter], ["sequence"], parts)
        starts = ledger_starts(dealt, chapter, most)
    else:
        dealt, starts = rows.withColumn(RANGE, F.lit(0)).repartition(chapter).sortWithinPartitions(chapter, "sequence"), {}

    names = ["key", "entity", "aspect", "fact"]
    columns = [chapter, "sequence", "entity", "aspect", "fact", "from_sequence"]

    def written(batch: pa.RecordBatch, store: pa.Table, at: list[int], kept: list[list[int]]) -> pa.RecordBatch:
        """The facts ``kept`` (places in the store) after the rows ``at`` of the batch."""
        row = pa.array(np.repeat(np.array(at, np.int64), [len(k) for k in kept]))
        facts = store.take(pa.array([i for k in kept for i in k], pa.int64())).combine_chunks()
        values = [batch[chapter].take(row), batch["sequence"].take(row).cast(pa.int32()), *[facts[n].chunk(0) for n in (*names[1:], "sequence")]]
        return pa.RecordBatch.from_arrays(values, columns)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, alive, of = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            own = batch["updates"].flatten()
            many = batch["updates"].value_lengths().fill_null(0).to_pylist()
            kinds = [own.type.field(n).type for n in names]
            if store is None:  # the facts that enter the range
                given = starts.get(batch[RANGE][0].as_py(), [])
                store = pa.table([*[pa.array([f[n] for f in given], t) for n, t in zip(names, kinds, strict=True)], pa.array([f["sequence"] for f in given], pa.int32())], [*names, "sequence"])
                alive, of = list(range(len(given))), batch[chapter][0].as_py()
            at = len(store)
            own_sequences = batch["sequence"].take(pa.array(np.repeat(np.arange(len(batch)), many))).cast(pa.int32())
            store = pa.concat_tables([store, pa.table([*[own.field(n) for n in names], own_sequences], [*names, "sequence"])])
            keys = store["key"].to_pylist()
            rows, kept, size = [], [], 0
            for i, (key, reset, n) in enumerate(zip(batch[chapter].to_pylist(), batch["reset"].to_pylist(), many, strict=True)):
                begins = key != of
                if begins or reset:
                    alive, of = [], key
                elif n:
                    changed = keys[at : at + n]
                    alive = [f for f in alive if keys[f] not in changed]
                alive = [*alive, *range(at, at + n)]
                alive, at = alive[-most:] if most else alive, at + n
                if not alive:
                    continue
                if last and rows and not begins and owner == key:
                    rows[-1], kept[-1] = i, alive
                else:
                    rows.append(i)
                    kept.append(alive)
                owner, size = key, size + len(alive)
                if size >= WRITTEN and not last:
                    yield written(batch, store, rows, kept)
                    rows, kept, size = [], [], 0
            if rows:
                yield written(batch, store, rows, kept)
            store, alive = store.take(pa.array(alive, pa.int64())), list(range(len(alive)))

    ledger = dealt.mapInArrow(fold, f"{chapter} {kind}, {LEDGER}")
    return checkpointed(ledger) if last else ledger


def unbounded_facts(updates: DataFrame, resets: DataFrame, chapter: str = "chapter") -> DataFrame:
    """The ledger without its bound, as intervals: each fact with the sequence that ends it (null if none).

    A fact of sequence s ends at the next sequence with an update of its entity or a reset.
    """
    keyed = updates.withColumn("_key", T.entity_key(F.col("entity")))
    steps = keyed.select(chapter, "_key", "sequence").distinct()
    by_entity = Window.partitionBy(chapter, "_key").orderBy("sequence")
    steps = steps.withColumn("_next", F.lead("sequence").over(by_entity))
    # the next reset, over the chapter's resets and steps together
    marks = steps.select(chapter, "sequence").distinct().unionByName(resets.filter("reset").select(chapter, "sequence", F.col("sequence").alias("_reset")), allowMissingColumns=True)
    later = Window.partitionBy(chapter).orderBy("sequence").rangeBetween(1, Window.unboundedFollowing)
    cuts = marks.withColumn("_cut", F.min("_reset").over(later)).groupBy(chapter, "sequence").agg(F.min("_cut").alias("_cut"))
    ends = steps.join(cuts, [chapter, "sequence"])
    ends = ends.withColumn("until_sequence", F.least("_next", "_cut"))
    return keyed.join(ends.select(chapter, "_key", "sequence", "until_sequence"), [chapter, "_key", "sequence"]).drop("_key")


def previous(rows: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Rows with previous_<column> of the row before them, per key and in order."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumns({f"previous_{c}": F.lag(c).over(w) for c in columns})


def around(rows: DataFrame, keys: list[str], order: str, value: Column) -> DataFrame:
    """Rows with history and future: the values of all rows before and after, in order. The output grows with the square of a key's
    rows by its definition."""
    w = Window.partitionBy(*keys).orderBy(order)
    past, later = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumns({"history": F.collect_list(value).over(past), "future": F.collect_list(value).over(later)})


def resume(committed: DataFrame, texts: DataFrame, saved: DataFrame, chapter: str = "chapter_id") -> DataFrame:
    """What of a saved run may stand: chapter, cursor, n_sequences, rule (null if all of it may).

    Committed sequences must be numbered from 1 without a gap, together be the beginning of the chapter's text of today, and
    replay to the saved ledger; else the rule says which it is and the cursor is 0, so the chapter starts again. A chapter
    without committed sequences starts at 0. ``committed``: chapter, sequence, source; ``texts``: chapter, text; ``saved``: chapter,
    saved_digest of the saved ledger and replayed_digest of the one that ``fact_ledger`` gives for the committed sequences.
    """
    parts = committed.groupBy(chapter).agg(
        F.count(F.lit(1)).alias("n_sequences"),
        (F.count_distinct("sequence") == F.count(F.lit(1))).alias("_once"),
        F.min("sequence").alias("_lo"), F.max("sequence").alias("_hi"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence", "source"))), lambda s: s["source"]), "").alias("_source"),
    )
    met = texts.select(chapter, "text").join(parts, chapter, "left").join(saved, chapter, "left")
    dense = F.col("_once") & (F.col("_lo") == 1) & (F.col("_hi") == F.col("n_sequences"))
    rule = (
        F.when(F.col("n_sequences").isNull(), None)
        .when(~F.coalesce(dense, F.lit(False)), "numbering")
        .when(~F.coalesce(F.startswith("text", F.col("_source")), F.lit(False)), "source_changed")
        .when(~F.col("saved_digest").eqNullSafe(F.col("replayed_digest")), "ledger_differs")
    )
    stands = rule.isNull() & F.col("n_sequences").isNotNull()
    return met.select(chapter, F.when(stands, F.length("_source")).otherwise(0).alias("cursor"), F.when(stands, F.col("n_sequences")).otherwise(0).alias("n_sequences"), rule.alias("rule"))


def ledger_digest(ledger: DataFrame, chapter: str = "chapter") -> DataFrame:
    """chapter, digest of the facts after its last sequence."""
    last = ledger.groupBy(chapter).agg(F.max("sequence").alias("sequence"))
    line = F.concat_ws("|", "entity", "aspect", "fact", "from_sequence")
    return ledger.join(last, [chapter, "sequence"]).groupBy(chapter).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ";"), 256).alias("digest"))


def duration_issues(beats: DataFrame, scenes: DataFrame, keys: list[str], most: float) -> DataFrame:
    """Violations of timing: keys, rule, total. ``beats``: keys, seconds; ``scenes``: keys, pause, stated."""
    sums = beats.groupBy(*keys).agg(F.sum("seconds").alias("_s"), F.count(F.lit(1)).alias("_n"))
    rows = scenes.join(sums, keys).withColumn("total", F.bround(F.col("_s") + F.col("pause"), 3))
    rule = F.when((F.col("total") <= 0) | (F.abs(F.col("total") - F.col("stated")) > 0.05), "total_mismatch").when(F.col("total") > most, "over_limit").when((F.col("_n") > 1) & (F.col("total") * 1.25 > most), "over_margin")
    return rows.withColumn("rule", rule).filter("rule IS NOT NULL").select(*keys, "rule", "total")


def coverage_violations(parts: DataFrame, wholes: DataFrame, keys: list[str], part: str, whole: str) -> DataFrame:
    """Wholes that their ordered parts do not make up, white space aside: keys, rule. ``parts``: keys, number, part."""
    joined = parts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", part))), lambda s: s[part]), " ").alias("_p"))
    rows = wholes.join(joined, keys, "left").withColumn("_p", T.squeeze(F.coalesce("_p", F.lit("")))).withColumn("_w", T.squeeze(F.col(whole)))
    rule = F.when(F.col("_p") == F.col("_w"), None).when(F.startswith("_w", F.col("_p")), "deferred_suffix").otherwise("not_covered")
    return rows.withColumn("rule", rule).filter("rule IS NOT NULL").select(*keys, "rule")
