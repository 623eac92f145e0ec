"""Identity: name similarity with blocking, components, merges, conflicts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.udfs import NameLinks, seq_ratio
from .lineage import checkpointed, numbered, spread

#: Candidates of an entity at most; a pool that is taken whole; the least score; how many are taken without one.
MOST_CANDIDATES, WHOLE_POOL, FLOOR, FALLBACK = 12, 35, 0.15, 3
#: Names of a block that meet in one task; a larger block is dealt into parts that meet each other.
BLOCK_NAMES = 2000
THRESHOLD, MOST_CLUSTER = 0.68, 24
#: Decisions of a key that are merged as one group, whatever they connect.
SMALL_KEY = 20_000
#: Names that a word joins at most where it holds more than one in HOT_SHARE of all words.
HOT_NAMES, HOT_SHARE = 1000, 4096
#: Characters that are counted each for itself when a ratio is bound; all others are counted together.
COUNTED = "abcdefghijklmnopqrstuvwxyz 0123456789éèàç"


def jaccard(a: Column, b: Column) -> Column:
    """Token overlap of two name keys; empty ones have none."""
    x, y = (F.array_distinct(F.filter(F.split(c, " "), lambda t: F.length(t) > 0)) for c in (a, b))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.size(F.array_union(x, y)))


def names_of(entities: DataFrame, id_col: str, name_col: str, aliases_col: str | None = None) -> DataFrame:
    """Distinct non-empty name keys: id, name."""
    every = F.array(F.col(name_col)) if aliases_col is None else F.concat(F.array(F.col(name_col)), F.coalesce(F.col(aliases_col), F.array().cast("array<string>")))
    return entities.select(F.col(id_col), F.explode(every).alias("_n")).select(id_col, T.name_key(F.col("_n")).alias("name")).filter(F.length("name") > 0).distinct()


def blocks(names: DataFrame) -> DataFrame:
    """Names with their block keys: the first three characters, and every token of three or more."""
    tokens = F.transform(F.filter(F.split("name", " "), lambda t: F.length(t) >= 3), lambda t: F.concat(F.lit("t:"), t))
    return names.select("*", F.explode(F.array_distinct(F.concat(F.array(F.concat(F.lit("p:"), F.left("name", F.lit(3)))), tokens))).alias("block"))


def char_counts(name: Column) -> Column:
    """How often each character of COUNTED stands in a name, then how often any other does."""
    each = [F.length(name) - F.length(F.replace(name, F.lit(c))) for c in COUNTED]
    return F.array(*each, F.length(name) - sum(each[1:], each[0]))


def ratio_bound(x: Column, y: Column, x_counts: Column, y_counts: Column) -> Column:
    """What the matching-block ratio of two names cannot exceed: matching characters are no more than the characters that both hold."""
    shared = sum((F.least(x_counts[i], y_counts[i]) for i in range(1, len(COUNTED) + 1)), F.least(x_counts[0], y_counts[0]))
    return F.lit(2.0) * shared / (F.length(x) + F.length(y))


def name_pairs(entities: DataFrame, id_col: str, type_col: str, name_col: str, threshold: float = THRESHOLD, aliases_col: str | None = None, ratio: bool = True) -> DataFrame:
    """Distinct pairs of names of one type that meet in a block and may reach the threshold: _type, x, y (x < y), overlap, bound.

    The bound is that of the character counts and, where that reaches the threshold, of the edit distance too: matching characters are in
    one order in both names, so twice their number is no more than both lengths less the distance. Only pairs whose overlap or bound
    reaches the threshold stay.
    """
    kept = names_of(entities, id_col, name_col, aliases_col).join(entities.select(id_col, F.col(type_col).alias("_type")), id_col)
    distinct = blocks(kept.select("_type", "name").distinct())
    sizes = distinct.groupBy("_type", "block").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    parts = F.ceil(F.col("_n") / BLOCK_NAMES)
    dealt = distinct.join(sizes, ["_type", "block"])
    if ratio:
        dealt = dealt.withColumn("_c", char_counts(F.col("name")))
    counts = ["_c"] if ratio else []
    left = dealt.select("_type", "block", F.col("name").alias("x"), *[F.col(c).alias(f"{c}x") for c in counts], F.pmod(F.xxhash64("name"), parts).alias("_part"))
    right = dealt.select("_type", "block", F.col("name").alias("y"), *[F.col(c).alias(f"{c}y") for c in counts], F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("_part"))
    met = left.join(right, ["_type", "block", "_part"]).filter("x < y")
    bound = F.lit(0.0)
    if ratio:
        by_counts, both = ratio_bound(F.col("x"), F.col("y"), F.col("_cx"), F.col("_cy")), F.length("x") + F.length("y")
        bound = F.when(by_counts >= threshold, F.least(by_counts, (both - F.levenshtein("x", "y")) / both)).otherwise(by_counts)
    overlap = jaccard(F.col("x"), F.col("y"))
    may = (bound >= threshold) | (overlap >= threshold)
    return met.filter(may).select("_type", "x", "y", overlap.alias("overlap"), bound.alias("bound")).distinct()


def similar_pairs(entities: DataFrame, id_col: str, type_col: str, name_col: str, threshold: float = THRESHOLD, aliases_col: str | None = None, ratio: bool = True) -> DataFrame:
    """Pairs of one type whose similarity reaches the threshold: _type, x, y (x < y), score.

    Score: 1 for equal name keys, else the larger of token overlap and matching-block ratio over all names. Distinct names of a
    type are compared, not entities, so a name that very many entities share is one row; those entities are linked in a
    star by ``name_links``. The ratio is computed only where its bound reaches the threshold (``name_pairs``).
    """
    pairs = name_pairs(entities, id_col, type_col, name_col, threshold, aliases_col, ratio)
    if not ratio:
        return pairs.select("_type", "x", "y", F.col("overlap").alias("score"))
    near, far = pairs.filter(F.col("bound") >= threshold), pairs.filter(F.col("bound") < threshold)
    scored = near.select("_type", "x", "y", F.greatest("overlap", seq_ratio("x", "y")).alias("score"))
    return scored.filter(F.col("score") >= threshold).unionByName(far.select("_type", "x", "y", F.col("overlap").alias("score")))


def name_links(entities: DataFrame, id_col: str, type_col: str, name_col: str, threshold: float = THRESHOLD, aliases_col: str | None = None, ratio: bool = True) -> DataFrame:
    """Edges (a, b) that connect entities as all similar pairs would: a star per equal name, and one edge per similar pair of names."""
    kept = names_of(entities, id_col, name_col, aliases_col).join(entities.select(id_col, F.col(type_col).alias("_type")), id_col)
    holder = kept.groupBy("_type", "name").agg(F.min(id_col).alias("_h"))
    stars = kept.join(holder, ["_type", "name"]).filter(F.col(id_col) != F.col("_h")).select(F.col(id_col).alias("a"), F.col("_h").alias("b"))
    pairs = similar_pairs(entities, id_col, type_col, name_col, threshold, aliases_col, ratio)
    x = holder.select("_type", F.col("name").alias("x"), F.col("_h").alias("a"))
    y = holder.select("_type", F.col("name").alias("y"), F.col("_h").alias("b"))
    return stars.unionByName(pairs.join(x, ["_type", "x"]).join(y, ["_type", "y"]).filter("a <> b").select("a", "b"))


def components(edges: DataFrame, nodes: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """id, component (the smallest member): large and small stars in turn until nothing changes.

    Each round is checkpointed. ``nodes`` adds those without edges.
    """
    now = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        now = checkpointed(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        after = mark(now)
        if after == before:
            break
        before = after
    out = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", id_col)
    out = out.unionByName(now.select(F.col("b").alias(id_col), F.col("b").alias("component")).distinct())
    if nodes is not None:
        out = nodes.select(id_col).distinct().join(out, id_col, "left").withColumn("component", F.coalesce("component", F.col(id_col)))
    return out


def clusters(components_: DataFrame, id_col: str = "id", most: int = MOST_CLUSTER) -> DataFrame:
    """Components cut into slices of at most ``most`` members in order; members left alone are dropped: component, slice, id."""
    order = Window.partitionBy("component").orderBy(id_col)
    cut = components_.withColumn("slice", F.floor((F.row_number().over(order) - 1) / most).cast("int"))
    sizes = cut.groupBy("component", "slice").agg(F.count(F.lit(1)).alias("_n"))
    return cut.join(sizes.filter("_n > 1").drop("_n"), ["component", "slice"]).select("component", "slice", id_col)


def top_candidates(incoming: DataFrame, pool: DataFrame, type_col: str = "kind", most: int = MOST_CANDIDATES, whole: int = WHOLE_POOL) -> DataFrame:
    """Candidates of each incoming entity in its type, by score and then the pool's order: in_id, pool_id, score, place.

    ``incoming``: in_id, type, in_name; ``pool``: pool_id, type, pool_name. A small pool is taken whole; else those with a
    score of FLOOR or more, or the best FALLBACK if there are none. Distinct names meet by the words that they share, so names of
    a type that share none are not compared; incoming entities of one name share its candidates. Two empty names are equal.

    A word that very many names of the pool hold (``hot_words``) joins no names. Names that share such words alone have a score that follows from these words and
    the numbers of words, so of the pool's entities that agree in both only the first ``most`` can be among the candidates.
    """
    left = incoming.withColumn("in_key", T.name_key(F.col("in_name")))
    right = pool.withColumn("pool_key", T.name_key(F.col("pool_name")))
    small = right.groupBy(type_col).agg(F.count(F.lit(1)).alias("_pool")).filter(F.col("_pool") <= whole).select(type_col)
    names, pool_names = left.select(type_col, "in_key").distinct(), right.select(type_col, "pool_key").distinct()
    hot = hot_words(pool_names, type_col, "pool_key")
    cold = lambda rows, key: words_of_names(rows, type_col, key).join(hot, [type_col, "_word"], "left_anti")
    shared = cold(names, "in_key").join(cold(pool_names, "pool_key"), [type_col, "_word"]).select(type_col, "in_key", "pool_key").distinct()
    scored = shared.select(type_col, "in_key", "pool_key", jaccard_of(F.array_distinct(F.split("in_key", " ")), F.array_distinct(F.split("pool_key", " "))).alias("score"))
    # of a pool name at most so many entities can be among the first, so no more are carried
    first = F.row_number().over(Window.partitionBy(type_col, "pool_key").orderBy("pool_id"))
    short = right.withColumn("_k", first).filter(F.col("_k") <= max(most, whole)).select(type_col, "pool_key", "pool_id")
    found = scored.join(short, [type_col, "pool_key"]).select(type_col, "in_key", "pool_id", "score")
    if not hot.isEmpty():
        found = found.unionByName(hot_candidates(names, right, hot, type_col, most))
    # every name is also given the whole of a small pool, or the first of a large one, without a score
    ids = F.row_number().over(Window.partitionBy(type_col).orderBy("pool_id"))
    start = right.withColumn("_k", ids).filter(F.col("_k") <= max(whole, FALLBACK)).join(small.withColumn("_small", F.lit(True)), type_col, "left")
    start = start.filter(F.col("_small") | (F.col("_k") <= FALLBACK)).select(type_col, "pool_id", F.lit(0.0).alias("score"))
    rows = found.unionByName(names.join(start, type_col)).groupBy(type_col, "in_key", "pool_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(type_col, "in_key").orderBy(F.desc("score"), "pool_id"))
    over = F.count_if(F.col("score") >= FLOOR).over(Window.partitionBy(type_col, "in_key"))
    marked = rows.withColumn("place", rank).withColumn("_over", over).join(small.withColumn("_small", F.lit(True)), type_col, "left")
    keep = F.col("_small") | ((F.col("place") <= most) & (F.col("score") >= FLOOR)) | ((F.col("_over") == 0) & (F.col("place") <= FALLBACK))
    return left.join(marked.filter(keep), [type_col, "in_key"]).select("in_id", "pool_id", "score", "place")


def jaccard_of(x: Column, y: Column) -> Column:
    """Overlap of two lists of distinct words."""
    shared = F.size(F.array_intersect(x, y))
    return shared / (F.size(x) + F.size(y) - shared)


def words_of_names(names: DataFrame, type_col: str, key: str) -> DataFrame:
    return names.select(type_col, key, F.explode(F.array_distinct(F.split(key, " "))).alias("_word"))


def hot_words(names: DataFrame, type_col: str, key: str) -> DataFrame:
    """type, _word of the words that more than HOT_NAMES names of a type hold, and more than one in HOT_SHARE of all words: HOT_SHARE rows at most."""
    counts = checkpointed(words_of_names(names, type_col, key).groupBy(type_col, "_word").agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    return F.broadcast(checkpointed(counts.filter((F.col("_n") > HOT_NAMES) & (F.col("_n") * HOT_SHARE > total)).select(type_col, "_word")))


def hot_candidates(names: DataFrame, pool: DataFrame, hot: DataFrame, type_col: str, most: int) -> DataFrame:
    """type, in_key, pool_id, score of the best ``most`` by the hot words that each name shares; a score may be too low where other words are shared too.

    ``names``: type, in_key; ``pool``: type, pool_key, pool_id. Names with the same hot words and as many words in all are one kind; kinds meet, not names.
    """

    def kinds(rows: DataFrame, key: str, mark: str) -> DataFrame:
        held = words_of_names(rows.select(type_col, key).distinct(), type_col, key).join(hot, [type_col, "_word"]).groupBy(type_col, key).agg(F.array_sort(F.collect_set("_word")).alias(f"{mark}_hot"))
        return held.withColumn(f"{mark}_n", F.size(F.array_distinct(F.split(key, " "))))

    asked, mine, theirs = kinds(names, "in_key", "in"), [type_col, "in_hot", "in_n"], [type_col, "pool_hot", "pool_n"]
    order = F.row_number().over(Window.partitionBy(*theirs).orderBy("pool_id"))
    members = pool.select(type_col, "pool_key", "pool_id").join(kinds(pool, "pool_key", "pool"), [type_col, "pool_key"]).withColumn("_k", order).filter(F.col("_k") <= most)
    members = checkpointed(members.select(*theirs, "pool_id"))
    a = asked.select(*mine).distinct().withColumn("_word", F.explode("in_hot"))
    b = members.select(*theirs).distinct().withColumn("_word", F.explode("pool_hot"))
    met = a.join(b, [type_col, "_word"]).drop("_word").distinct()
    shared = F.size(F.array_intersect("in_hot", "pool_hot"))
    scored = met.withColumn("score", shared / (F.col("in_n") + F.col("pool_n") - shared)).join(members, theirs)
    best = F.row_number().over(Window.partitionBy(*mine).orderBy(F.desc("score"), "pool_id"))
    top = scored.withColumn("_k", best).filter(F.col("_k") <= most).select(*mine, "pool_id", "score")
    return asked.join(top, mine).select(type_col, "in_key", "pool_id", "score")


def apply_merges(entities: DataFrame, groups: DataFrame, id_col: str, type_col: str) -> tuple[DataFrame, DataFrame]:
    """(mapping id -> kept id, refused groups). ``groups``: group_no, id.

    Ids that don't exist are ignored, as is an id that an earlier group took; a group must be of one type and have two
    members left. The smallest id is kept.
    """
    known = groups.join(entities.select(id_col, F.col(type_col).alias("_type")), id_col)
    first = known.groupBy(id_col).agg(F.min("group_no").alias("group_no"))
    mine = known.join(first, [id_col, "group_no"]).distinct()
    state = mine.groupBy("group_no").agg(F.count_distinct("_type").alias("_types"), F.count_distinct(id_col).alias("_n"), F.min(id_col).alias("kept_id"))
    refused = state.filter("_types > 1 OR _n < 2").select("group_no", F.when(F.col("_types") > 1, "mixed types").otherwise("too few").alias("reason"))
    return mine.join(state.filter("_types = 1 AND _n > 1"), "group_no").select(F.col(id_col), "kept_id"), refused


def assign_ids(rows: DataFrame, taken: DataFrame, type_col: str, order: list[str], prefix: Column) -> DataFrame:
    """Rows with global_id ``PREFIX_001`` numbered per type after the largest number taken; ``taken``: type, number. The order is unique within a type."""
    start = taken.groupBy(type_col).agg(F.max("number").alias("_max"))
    joined = numbered(rows, [type_col], order).join(start, type_col, "left").withColumn("_k", (F.col("number") + F.coalesce("_max", F.lit(0))).cast("string"))
    return joined.withColumn("global_id", F.concat(prefix, F.lit("_"), F.lpad("_k", F.greatest(F.lit(3), F.length("_k")), F.lit("0")))).drop("number", "_k", "_max")


def unambiguous(aliases: DataFrame, id_col: str, alias_col: str, keys: list[str]) -> DataFrame:
    """Aliases that, folded, belong to one entity only."""
    folded = aliases.withColumn("_f", F.lower(alias_col))
    owners = folded.groupBy(*keys, "_f").agg(F.count_distinct(id_col).alias("_n")).filter("_n = 1").drop("_n")
    return folded.join(owners, [*keys, "_f"], "left_semi").drop("_f")


def value_pairs(rows: DataFrame, group: list[str], id_col: str, value_col: str) -> DataFrame:
    """Pairs of different values within a group, one per pair of values: group, left_value, right_value, the first id of each."""
    values = rows.groupBy(*group, value_col).agg(F.min(id_col).alias("_id"))
    a = values.select(*group, F.col(value_col).alias("left_value"), F.col("_id").alias("left_id"))
    b = values.select(*group, F.col(value_col).alias("right_value"), F.col("_id").alias("right_id"))
    return a.join(b, group).filter("left_value < right_value")


def roll_up(rows: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    """Traits without conflicted ids: keys, trait, value, scope, n, first_id."""
    kept = rows.join(excluded.select("evidence_id"), "evidence_id", "left_anti")
    scope = F.when((F.col("classification") == "explicit") & (F.col("persistence") == "persistent"), "global").otherwise("temporary")
    return kept.withColumn("scope", scope).groupBy(*keys, "trait", "value", "scope").agg(F.count(F.lit(1)).alias("n"), F.min("evidence_id").alias("first_id"))


def conflict_groups(rows: DataFrame, edges: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """Choices of each conflict: component, choice_no, value, n, first_id, selected; the first value found is selected."""
    parts = components(edges, id_col=id_col)
    grouped = rows.join(parts, id_col).groupBy("component", value_col).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id"))
    number = F.row_number().over(Window.partitionBy("component").orderBy("first_id"))
    return grouped.withColumn("choice_no", number).withColumn("selected", F.col("choice_no") == 1)


def seeded_reach(edges: DataFrame, seeds: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids reachable from the seeds, with the number of steps; new ids only travel on."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = checkpointed(both)  # not made distinct: ids are, after each step
    found = checkpointed(seeds.select(F.col(id_col)).distinct().withColumn("steps", F.lit(0)))
    front, step = found, 0
    while True:
        step += 1
        new = front.select(F.col(id_col).alias("a")).join(spread(both, "a"), "a").select(F.col("b").alias(id_col)).distinct()
        front = checkpointed(new.join(found, id_col, "left_anti").withColumn("steps", F.lit(step)))
        if front.isEmpty():
            return found
        found = checkpointed(found.unionByName(front))


def unique_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, key: str) -> DataFrame:
    """Pairs that share a key and have no other partner on either side."""
    pairs = left.join(right, key).select(left_id, right_id).distinct()
    a = pairs.groupBy(left_id).agg(F.count(F.lit(1)).alias("_a"))
    b = pairs.groupBy(right_id).agg(F.count(F.lit(1)).alias("_b"))
    return pairs.join(a.filter("_a = 1"), left_id, "left_semi").join(b.filter("_b = 1"), right_id, "left_semi")


def alias_edges(names: DataFrame, contexts: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of names that some context of their group supports as one: keys, x, y (x < y). ``names``: keys, name; ``contexts``: keys, context.

    All names of a group are searched at once in each of its contexts (``NameLinks``); a group's names are few. Null names and contexts are left out.
    """
    labels = names.filter("name IS NOT NULL").groupBy(*keys).agg(F.array_sort(F.collect_set("name")).alias("_names"))
    rows = contexts.filter("context IS NOT NULL").join(labels, keys).select(*keys, "_names", "context")
    schema = ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys] + ["x string", "y string"])

    def run(batches):
        of, links = None, None
        for pdf in batches:
            out = []
            for *key, listed, context in pdf.itertuples(index=False, name=None):
                if links is None or tuple(listed) != of:
                    of = tuple(listed)
                    links = NameLinks(list(of))
                out += [(*key, *pair) for pair in sorted(links.find(context))]
            yield pd.DataFrame(out, columns=[*keys, "x", "y"])

    return rows.mapInPandas(run, schema).distinct()


#: Shares in which the dossiers of one label meet the others. Fixed value.
SHARES = 16


def dossier_pairs(labels: DataFrame, quotes: DataFrame, compared: DataFrame, blocked: DataFrame, bridges: DataFrame, group: str = "group") -> DataFrame:
    """Pairs of dossiers worth comparing: a, b (a < b).

    Two dossiers are, if they share a label or a quotation of one names a label of the other, and some label of one is connected
    with a label of the other by necessary alias links; pairs compared before or kept apart are left out. ``labels``: group, label;
    ``quotes``: group, quotation; ``compared`` and ``blocked``: a, b in any order; ``bridges``: label, component (``components`` of
    ``alias_edges``; a label without an edge is a component of its own).
    """
    from .catalogs import mentions

    own = labels.select(group, "label").filter("label IS NOT NULL").distinct()
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    names = own.select("label").distinct().withColumn("_name", F.col("label"))
    named = mentions(quotes, names, group, "quotation", "label", "_name").groupBy(group).agg(F.collect_set("label").alias("_named"))
    parts = own.join(bridges.select("label", F.col("component").cast("string").alias("_c")), "label", "left")
    cards = parts.groupBy(group).agg(F.collect_set("label").alias("_own"), F.collect_set(F.coalesce("_c", F.concat(F.lit("label:"), "label"))).alias("_parts"))
    cards = cards.join(named, group, "left").withColumn("_named", F.coalesce("_named", F.array().cast("array<string>")))
    # a label that many share is many tasks': each dossier meets those of the others once in its share
    side = lambda x, listed, share: cards.select(F.struct(F.col(group).alias("id"), "_own", "_named", "_parts").alias(x), F.explode(listed).alias("label"), share.alias("_share"))
    every = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))
    left = side("l", F.array_union("_own", "_named"), F.pmod(F.hash(group), F.lit(SHARES)))
    right = side("r", F.col("_own"), F.lit(None)).select("r", "label", every.alias("_share"))
    # each pair comes once: by the smallest label that leads to it, by a shared one before a named one, from its smaller end first
    both = F.array_intersect("l._own", "r._own")
    led = F.array_intersect("l._named", "r._own")
    shared = (F.col("l.id") < F.col("r.id")) & (F.array_min(both) == F.col("label"))
    quoted = (F.size(both) == 0) & (F.col("l.id") != F.col("r.id")) & (F.array_min(led) == F.col("label")) & ((F.col("l.id") < F.col("r.id")) | ~F.arrays_overlap("r._named", "l._own"))
    met = left.join(right, ["label", "_share"]).filter((F.array_contains("l._own", F.col("label")) & shared) | quoted).filter(F.arrays_overlap("l._parts", "r._parts"))
    pairs = met.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b"))
    return pairs.join(ordered(compared.unionByName(blocked)), ["a", "b"], "left_anti")


def partition_violations(partition: DataFrame, supports: DataFrame, records: DataFrame, links: DataFrame) -> DataFrame:
    """Broken rules of a partition of evidence into profiles: profile (null for an id in none), evidence_id, rule.

    Every id is in one profile; a profile's name is a label of its evidence; an ambiguous one has one id; its support is explicit
    evidence of its own, and connects all its labels. ``partition``: profile, evidence_id, canonical_name, identity_status;
    ``supports``: profile, evidence_id; ``records``: evidence_id, character, classification; ``links``: profile, x, y (the labels that
    contexts of its support show to be one, from ``alias_edges``).
    """
    row = lambda df, rule: df.select("profile", "evidence_id", F.lit(rule).alias("rule"))
    nobody, nothing = F.lit(None).cast(partition.schema["profile"].dataType), F.lit(None).cast(partition.schema["evidence_id"].dataType)
    uses = partition.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("evidence_id")))
    known = uses.join(records, "evidence_id", "left")
    missing = records.join(partition, "evidence_id", "left_anti").select(nobody.alias("profile"), "evidence_id")
    whole = known.groupBy("profile").agg(F.count(F.lit(1)).alias("_n"), F.bool_or(F.col("identity_status") == "ambiguous").alias("_a"), F.bool_or(F.col("character").eqNullSafe(F.col("canonical_name"))).alias("_named"))
    whole = whole.withColumn("evidence_id", nothing)
    support = supports.join(partition.select("profile", "evidence_id", F.lit(True).alias("_own")), ["profile", "evidence_id"], "left").join(records, "evidence_id", "left")
    labels = known.filter("character IS NOT NULL").select("profile", F.col("character").alias("label")).distinct()
    node = lambda c: F.struct("profile", F.col(c).alias("label"))
    parts = components(links.select(node("x").alias("a"), node("y").alias("b")), labels.select(node("label").alias("id")))
    apart = parts.groupBy(F.col("id.profile").alias("profile")).agg(F.count_distinct("component").alias("_parts")).filter("_parts > 1").withColumn("evidence_id", nothing)
    return (
        row(missing, "missing_id")
        .unionByName(row(known.filter("_n > 1"), "repeated_id"))
        .unionByName(row(known.filter("character IS NULL"), "foreign_id"))
        .unionByName(row(whole.filter("NOT _named"), "name_not_supplied"))
        .unionByName(row(whole.filter("_a AND _n > 1"), "ambiguous_merge"))
        .unionByName(row(support.filter("_own IS NULL"), "foreign_support"))
        .unionByName(row(support.filter("_own AND NOT classification <=> 'explicit'"), "weak_support"))
        .unionByName(row(apart, "labels_not_connected"))
    )


def profiles_of(partition: DataFrame, records: DataFrame, violations: DataFrame) -> DataFrame:
    """The profiles that break no rule: profile, local_id, canonical_name, aliases, evidence_ids; the id follows from the evidence alone."""
    sound = partition.join(violations.filter("profile IS NOT NULL").select("profile").distinct(), "profile", "left_anti").join(records.select("evidence_id", "character"), "evidence_id")
    rows = sound.groupBy("profile").agg(F.min("canonical_name").alias("canonical_name"), F.array_sort(F.collect_set("character")).alias("_l"), F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))
    ids = T.digest_id("char_", 24, F.array_join(F.transform("evidence_ids", lambda x: x.cast("string")), "\u001e"))
    return rows.select("profile", ids.alias("local_id"), "canonical_name", F.array_remove("_l", F.col("canonical_name")).alias("aliases"), "evidence_ids")


def constrained_merge(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, component: "same" edges joined in order unless a "different" decision stands between the two parts.

    ``decisions``: keys, order, a, b, relation; equal orders are taken by a, b. The result depends on the order within a
    component of a key's "same" edges, so one such component is one group; ids without such an edge stay alone. A key of few
    decisions (``SMALL_KEY``) is one group as it is.
    """
    id_type = decisions.schema["a"].dataType.simpleString()
    schema = ", ".join(f"`{k}` {decisions.schema[k].dataType.simpleString()}" for k in keys) + f", id {id_type}, component {id_type}"
    rows = decisions.select(*keys, "order", "a", "b", F.when(F.col("relation") == "different", 0).when(F.col("relation") == "same", 1).otherwise(2).alias("_what"))
    # keys and nodes are dealt by hashes: rows of equal hashes only come together, groups are told apart by their keys
    rows = checkpointed(rows.withColumn("_root", F.xxhash64(*keys) if keys else F.lit(0).cast("long")))
    large = checkpointed(rows.groupBy("_root").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > SMALL_KEY).select("_root"))
    if not large.isEmpty():
        rows = rows.join(large, "_root", "left_anti").unionByName(by_components(rows.join(large, "_root", "left_semi"), keys))

    def least(key: tuple, part: dict) -> Iterator[tuple]:
        of_part = {id(p): min(p) for p in {id(p): p for p in part.values()}.values()}
        return ((*key, n, of_part[id(p)]) for n, p in part.items())

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, part, apart, types = None, {}, {}, None

        def found(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [*keys, "id", "component"])

        for batch in batches:
            types = [*[batch.schema.field(k).type for k in keys], *[batch.schema.field("a").type] * 2]
            out: list[tuple] = []
            groups = zip(*[batch[k].to_pylist() for k in ("_root", *keys)], strict=True)
            for group, what, a, b in zip(groups, *[batch[c].to_pylist() for c in ("_what", "a", "b")], strict=True):
                if group != of:
                    if part:
                        out += least(of[1:], part)
                    of, part, apart = group, {}, {}
                x, y = part.get(a), part.get(b)
                if x is None:
                    x = part[a] = {a}
                if y is None:
                    y = part.setdefault(b, {b})
                if what == 0:
                    apart.setdefault(a, set()).add(b)
                    apart.setdefault(b, set()).add(a)
                elif what == 1 and part[a] is not y:
                    if len(x) < len(y):
                        x, y = y, x
                    if all(q not in apart or x.isdisjoint(apart[q]) for q in y):
                        x |= y
                        for member in y:
                            part[member] = x
            if out:
                yield found(out)
        if part:
            yield found(list(least(of[1:], part)))

    order = [F.col(c).asc_nulls_last() for c in ("order", "a", "b")]
    return spread(rows, "_root").sortWithinPartitions("_root", *keys, "_what", *order).mapInArrow(fold, schema)


def by_components(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Decisions of large keys with the component of their "same" edges as ``_root``; of one between two components only the nodes stay, each in its own."""
    node = lambda c: F.xxhash64(*keys, c)
    known = checkpointed(rows.drop("_root").withColumns({"_a": node("a"), "_b": node("b")}))
    parts = checkpointed(components(known.filter("_what = 1").select(F.col("_a").alias("a"), F.col("_b").alias("b")), id_col="_node"))
    side = lambda c: parts.select(F.col("_node").alias(c), F.col("component").alias(f"_part{c}"))
    met = known.join(side("_a"), "_a", "left").join(side("_b"), "_b", "left").withColumns({f"_root{c}": F.coalesce(f"_part{c}", c) for c in ("_a", "_b")})
    edge = F.array(F.struct(F.col("a"), F.col("b"), "_what", F.col("_root_a").alias("_root")))
    nodes = F.array(*[F.struct(F.col(c).alias("a"), F.col(c).alias("b"), F.lit(2).alias("_what"), F.col(f"_root_{c}").alias("_root")) for c in ("a", "b")])
    return met.select(*keys, "order", F.inline(F.when(F.col("_root_a") == F.col("_root_b"), edge).otherwise(nodes)))
