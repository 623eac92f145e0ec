"""Queries that do their whole job, against plain Python on small tables."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from corpusledger.operators import assets, catalogs, chunking, identity, reviews, timeline
from corpusledger.operators.lineage import numbered
from corpusledger.plans import registry
from corpusledger.sources import chapters as sources


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def parts_of(edges, nodes):
    """Node -> smallest member of its component."""
    part = {n: {n} for n in nodes}
    for a, b in edges:
        if part[a] is not part[b]:
            part[a] |= part[b]
            for n in part[b]:
                part[n] = part[a]
    return {n: min(p) for n, p in part.items()}


PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"


def similar(x, y):
    if x == y:
        return True
    a, b = set(x.split()), set(y.split())
    near = max(len(a & b) / len(a | b), difflib.SequenceMatcher(None, *sorted((x, y))).ratio()) >= 0.68
    return near and bool({"p:" + x[:3]} & {"p:" + y[:3]} or {t for t in a if len(t) >= 3} & {t for t in b if len(t) >= 3})


def test_components_take_similar_names(spark, tmp_path):
    names = ["red ring", "red rings", "old plate", "old plates here", "tin ring", "red ring", "lead cup"]
    rows = [(i, names[i % 7], f"B{i % 2}", f"T{i % 3}", i % 50) for i in range(60)]
    put(spark, tmp_path, "part", rows, PART)
    edges = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[2] == b[2] and similar(a[1], b[1])]
    expected = parts_of(edges, [r[0] for r in rows])
    assert values(registry.QUERIES["components_all"](spark, str(tmp_path)), "id", "component") == sorted(expected.items(), key=str)
    members, cut = {}, []
    for i, c in sorted(expected.items()):
        members.setdefault(c, []).append(i)
    for c, ids in members.items():
        slices = [ids[k : k + 24] for k in range(0, len(ids), 24)]
        cut += [(c, k, i) for k, ids_ in enumerate(slices) if len(ids_) > 1 for i in ids_]
    assert values(registry.QUERIES["audit_clusters_all"](spark, str(tmp_path)), "component", "slice", "id") == sorted(cut, key=str)
    assert len(set(expected.values())) < len({(r[1], r[2]) for r in rows})


def test_designs_meet_the_whole_registry(spark, tmp_path):
    kind = lambda i: i % 3
    rows = [(i, f"name {i}" if i < 500 else f"name {i - 294}", "B", "T", 1) for i in (*range(0, 600, 7), 1200, 1203)]
    put(spark, tmp_path, "part", rows, PART)
    same = {r[0]: [q[0] for q in rows if kind(q[0]) == kind(r[0]) and q[1] == r[1]] for r in rows}
    found = values(registry.QUERIES["import_designs"](spark, str(tmp_path)), "design_id", "entity", "reason")
    assert found == sorted([(i, i, None) if len(q) == 1 else (i, None, "ambiguous") for i, q in same.items()], key=str)
    assert (1200, 1200, None) in found and any(r[2] for r in found)


def test_designs_are_counted_on_both_sides(spark):
    designs = spark.createDataFrame([(1, "A b", "x"), (2, "a B", "x"), (3, "c", "x"), (4, "d", "x"), (5, "e", "x")], "design_id long, canonical_name string, kind string")
    known = spark.createDataFrame([(7, "a b", "x"), (8, "C", "x"), (9, "d", "x"), (10, "D", "x"), (11, "e", "y")], "entity long, canonical_name string, kind string")
    matched, rejects = reviews.import_designs(designs, known)
    assert values(matched, "design_id", "entity") == [(3, 8)]
    assert values(rejects, "design_id", "reason") == [(1, "ambiguous"), (2, "ambiguous"), (4, "ambiguous"), (5, "unknown")]


def test_customers_meet_all_suppliers(spark, tmp_path):
    put(spark, tmp_path, "customer", [(i, f"Customer#{i % 450:09d}") for i in range(600)], "c_custkey long, c_name string")
    put(spark, tmp_path, "supplier", [(i, f"Supplier#{i + 100:09d}") for i in range(400)], "s_suppkey long, s_name string")
    found = values(registry.QUERIES["unique_match"](spark, str(tmp_path)), "c_custkey", "s_suppkey")
    assert found == sorted([(c, c - 100) for c in range(150, 450)], key=str)


LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string"


def merged(decisions):
    """(group, id) -> component of decisions (group, order, a, b, relation), one at a time as the rule has it."""
    part = {(d[0], x): {x} for d in decisions for x in d[2:4]}
    apart = {(d[0], frozenset(d[2:4])) for d in decisions if d[4] == "different"}
    for g, _, a, b, relation in sorted(decisions, key=lambda d: d[1:4]):
        x, y = part[g, a], part[g, b]
        if relation == "same" and x is not y and not any((g, frozenset((p, q))) in apart for p in x for q in y):
            x |= y
            for m in y:
                part[g, m] = x
    return sorted(((g, i, min(p)) for (g, i), p in part.items()), key=str)


def test_reach_and_merges_take_every_line(spark, tmp_path):
    dice = random.Random(3)
    rows = [(k // 3, dice.randrange(2000), dice.randrange(60), k % 3 + 1, dice.choice("RANN")) for k in range(400)]
    rows += [(500 + k, 5, 7, 1, flag) for k, flag in enumerate("NRN")]
    put(spark, tmp_path, "lineitem", rows, LINE)
    near: dict = {}
    for _, p, s, _, _ in rows:
        near.setdefault(p, set()).add(-1 - s)
        near.setdefault(-1 - s, set()).add(p)
    steps = {n: 0 for n in near if n % 97 == 0}
    front = list(steps)
    while front:
        front = sorted({m for n in front for m in near[n]} - steps.keys())
        steps |= dict.fromkeys(front, max(steps.values()) + 1)
    assert values(registry.QUERIES["seeded_reach"](spark, str(tmp_path)), "id", "steps") == sorted(steps.items(), key=str)
    decisions = [(s, o * 10 + n, p, -1 - s, "different" if f == "R" else "same") for o, p, s, n, f in rows]
    assert values(registry.QUERIES["constrained_merge"](spark, str(tmp_path)), "group", "id", "component") == merged(decisions)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_reach_reads_its_edges_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    edges = spark.createDataFrame([(i, i + 1) for i in range(5)], "a long, b long").mapInPandas(counted, "a long, b long")
    assert values(identity.seeded_reach(edges, spark.createDataFrame([(0,)], "id long")), "id", "steps") == [(i, i) for i in range(6)]
    assert read.value <= 10  # from both ends


def test_location_views_by_one_sort(spark):
    """Every plan of up to two views in two scenes, with repeated, foreign, missing and null ones."""
    scenes = [(k, s) for k in range(8) for s in (1, 2)] + [(2, 2), (9, None), (None, 1)]
    plan = [(0, "a", 1), (0, "b", 2), (1, "a", 1), (2, "a", 1), (2, "a", 2), (3, "a", 1), (3, "a", 1), (3, "b", 2), (4, "a", 1), (4, "b", 2), (4, "c", 3), (5, "a", 1), (5, "b", 1), (5, "b", 2), (9, "a", None), (None, "a", 1)]
    views, bad = catalogs.location_views(spark.createDataFrame(plan, "location int, view string, scene int"), spark.createDataFrame(scenes, "location int, scene int"))
    assert values(bad, "location", "rule", "scene") == sorted([(1, "scene without view", 2), (3, "repeated", 1), (4, "foreign scene", 3), (9, "foreign scene", None), (9, "scene without view", None), (None, "foreign scene", 1)], key=str)
    good = [p for p in plan if p[0] in (0, 2, 5, None)]
    assert values(views, "location", "view", "scene") == sorted(good + [(k, "wide", s) for k, s in scenes if k not in (0, 2, 5)], key=str)
    assert "Join" not in plan_of(views)


def test_group_rules_by_group(spark):
    groups = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 3), (3, 4), (3, 99), (4, None), (5, 5), (5, 6), (6, 7), (6, 8)], "group_no int, local_id int")
    kinds = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "x"), (5, "x"), (6, "y"), (7, "x"), (8, "x"), (8, "y")], "local_id int, kind string")
    quotes = spark.createDataFrame([(1, "q", False), (1, "r", False), (2, "q", True), (8, "q", False), (3, "q", None)], "group_no int, quote string, found boolean")
    out = catalogs.group_violations(groups, kinds, quotes)
    rules = [(1, "quote not in source"), (2, "id used twice"), (2, "one member"), (3, "unknown id"), (4, "unknown id"), (4, "one member"), (5, "several kinds"), (6, "several kinds"), (8, "quote not in source")]
    assert values(out, "group_no", "rule") == sorted(rules, key=str)
    assert "Expand" not in plan_of(out)


def test_slots_by_windows_of_a_scene(spark):
    """Against the rule in turn: first ones, then later levels of those; no scene is joined."""
    dice = random.Random(8)
    seen = {(s, k): (dice.random() < 0.3, dice.randrange(3), dice.randrange(1, 4)) for s in range(12) for k in range(dice.randrange(1, 9))}
    want = []
    for scene in range(12):
        of = {k: v for (s, k), v in seen.items() if s == scene}
        first = sorted(of, key=lambda k: (not of[k][0], of[k][1], k))[:4]
        later = sorted((n, of[k][1], k) for k in first for n in range(1, min(of[k][2], 3)))[: 4 - len(first)]
        both = sorted([(of[k][1], k, 0) for k in first] + [(p, k, n) for n, p, k in later])
        want += [(scene, k, n, i) for i, (_, k, n) in enumerate(both, 1)]
    rows = [(s, k, loc, p, k, n) for (s, k), (loc, p, views) in seen.items() for n in range(views)] + [(None, 1, False, 1, 1, n) for n in range(2)]
    out = assets.budgeted_slots(spark.createDataFrame(rows, "scene int, subject int, is_location boolean, prominence int, ord int, level int"), ["scene"], 4, 3)
    assert values(out, "scene", "subject", "level", "slot") == sorted([*want, (None, 1, 0, 1)], key=str)
    assert "Join" not in plan_of(out)


def test_merges_with_separations_in_every_order(spark):
    dice = random.Random(5)
    rows = [(f"g{dice.randrange(4)}", k // 2, dice.randrange(25), dice.randrange(25), dice.choice(["same", "same", "different"])) for k in range(160)]
    df = spark.createDataFrame(rows, "k string, `order` long, a long, b long, relation string").repartition(7)
    assert values(identity.constrained_merge(df, ["k"]), "k", "id", "component") == merged(rows)


@pytest.mark.parametrize("most", [0, 30, 1000])
def test_merges_of_small_keys_are_not_cut_first(spark, monkeypatch, most):
    """Keys of few decisions go as they are, others by their components: the same merges, and no component is sought in vain."""
    dice = random.Random(6)
    rows = [(dice.randrange(9) % 6, k // 2, dice.randrange(14), dice.randrange(14), dice.choice(["same", "different", "same", "other"])) for k in range(160)]
    cut = []
    monkeypatch.setattr(identity, "SMALL_KEY", most)
    monkeypatch.setattr(identity, "components", lambda *a, _f=identity.components, **k: cut.append(1) or _f(*a, **k))
    df = spark.createDataFrame(rows, "k int, `order` long, a long, b long, relation string")
    assert values(identity.constrained_merge(df, ["k"]), "k", "id", "component") == merged(rows)
    assert bool(cut) == (most < 1000)


def test_targets_are_dropped_beyond_the_fortieth_trait(spark, tmp_path):
    rows = [(i * 7 % 401, f"name {i}", "B", f"T{min(i % 5, 1)}", 1) for i in range(200)]
    put(spark, tmp_path, "part", rows, PART)
    expected = []
    for kind in ("T0", "T1"):
        names = [r[1] for r in sorted(rows) if r[3] == kind]
        expected += [(kind, k, n) for k, n in enumerate(names, 1) if k % 3]
    assert max(r[1] for r in expected) > 40
    assert values(registry.QUERIES["drop_targets"](spark, str(tmp_path)), "entity", "number", "trait") == sorted(expected, key=str)


def test_candidates_equal_a_search_of_all_pairs(spark):
    dice = random.Random(8)
    words = "red old tin ring plate cup lid".split()
    name = lambda: " ".join(dice.choices(words, k=dice.randrange(4)))
    pool = [(i, "big" if i % 4 else "small", name()) for i in range(100)]
    asked = [(1000 + i, dice.choice(["big", "small", "none"]), name() if i else "of no kin") for i in range(30)]
    left, right = spark.createDataFrame(asked, "in_id long, kind string, in_name string"), spark.createDataFrame(pool, "pool_id long, kind string, pool_name string")
    out = values(identity.top_candidates(left, right), "in_id", "pool_id", F.round("score", 9), "place")

    def score(x, y):
        a, b = set(x.split()), set(y.split())
        return 1.0 if x == y else len(a & b) / max(1, len(a | b))

    want = []
    for i, kind, n in asked:
        ranked = sorted((-score(n, m), p) for p, k, m in pool if k == kind)
        size, over = len(ranked), sum(-s >= 0.15 for s, _ in ranked)
        kept = ranked if size <= 35 else [r for r in ranked[:12] if -r[0] >= 0.15] if over else ranked[:3]
        want += [(i, p, round(-s, 9), k) for k, (s, p) in enumerate(kept, 1)]
    assert out == sorted(want, key=str)


def test_large_blocks_are_dealt_into_parts(spark):
    e = spark.createDataFrame([(i, "k", f"abc {i % 7} d{i}") for i in range(30)], "i long, kind string, name string")
    whole = values(identity.similar_pairs(e, "i", "kind", "name", 0.3), "x", "y")
    kept = identity.BLOCK_NAMES
    try:
        identity.BLOCK_NAMES = 4
        assert values(identity.similar_pairs(e, "i", "kind", "name", 0.3), "x", "y") == whole
    finally:
        identity.BLOCK_NAMES = kept


def test_numbering_has_no_single_task(spark):
    rows = spark.createDataFrame([(k, i) for k in ("a", "a", "b") for i in range(40)], "k string, i long").distinct()
    out = numbered(rows.repartition(7), ["k"], ["i"])
    assert values(out, "k", "number") == sorted([(k, i + 1) for k in "ab" for i in range(40)], key=str)
    assert values(numbered(rows, [], ["k", "i"]), "k", "i", "number") == sorted([(k, i, i + 1 + 40 * (k == "b")) for k in "ab" for i in range(40)], key=str)
    assert numbered(rows.limit(0), [], ["i"]).count() == 0


def unpartitioned_windows(df):
    """Windows over all rows in a plan, but for those over the ranges themselves, which are as many as partitions."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Window [" in line and line.rstrip().count("[") < 3 and "windowspecdefinition(_range#" not in line]


def test_no_window_over_all_rows_carries_texts(spark):
    docs = spark.createDataFrame([(i, "some text " * 40 + str(i % 3)) for i in range(12)], "i long, t string")
    interned = chunking.intern(docs, "t", ["i"])
    assert unpartitioned_windows(interned) == [] and values(interned, "value_id", "uses") == [(1, 4), (2, 4), (3, 4)]
    files = spark.createDataFrame([(f"p{i}.txt", f"p{i}.txt", f"text {i}".encode()) for i in (10, 2, 1)], "path string, name string, content binary")
    kept, _ = sources.read_chapters(files)
    assert unpartitioned_windows(kept) == [] and values(kept, "ord", "chapter_id") == [(1, "p1"), (2, "p2"), (3, "p10")]
    known = spark.createDataFrame([("character", 4)], "kind string, number long")
    given = identity.assign_ids(spark.createDataFrame([("character", i) for i in range(3)], "kind string, i long"), known, "kind", ["i"], F.lit("CHAR"))
    assert values(given, "i", "global_id") == [(0, "CHAR_005"), (1, "CHAR_006"), (2, "CHAR_007")]


def test_ids_are_made_unique_whatever_they_meet(spark):
    rows = [(1, "a"), (2, "a"), (3, "a_001"), (4, "b"), (5, "a_002"), (6, "a_002")]
    out = sources.unique_ids(spark.createDataFrame(rows, "k long, s string"), "k", "s")
    found = values(out, "k", "unique_id")
    assert len({u for _, u in found}) == 6 and found[3] == (4, "b") and found[2] == (3, "a_001") and found[1] == (2, "a_002")


def test_facts_end_at_resets_and_updates(spark):
    dice = random.Random(4)
    ups = [(c, s, 1, f"The {dice.choice('xyz')}", "a", "f") for c in range(3) for s in range(1, 15) if dice.random() < 0.7]
    cuts = [(c, s, dice.random() < 0.2) for c in range(3) for s in range(1, 15)]
    df = timeline.unbounded_facts(spark.createDataFrame(ups, "chapter long, sequence int, update_no int, entity string, aspect string, fact string"), spark.createDataFrame(cuts, "chapter long, sequence int, reset boolean"))
    want = []
    for c, s, _, e, _, _ in ups:
        ends = [q for d, q, r in cuts if d == c and q > s and r] + [q for d, q, _, x, _, _ in ups if d == c and q > s and x == e]
        want.append((c, s, e, min(ends, default=None)))
    assert values(df, "chapter", "sequence", "entity", "until_sequence") == sorted(want, key=str)
