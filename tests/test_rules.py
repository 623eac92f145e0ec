"""Cases of the rules of traits, references, prompts, documents, resumed runs, names and partitions."""

import time

import pytest
from pyspark.sql import functions as F

from corpusledger.functions import text as T
from corpusledger.functions import udfs
from corpusledger.operators import assets, catalogs, documents, identity, lineage, prompts, quality, timeline, traits
from corpusledger.sources import export, stages


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize(
    "value,quotation,trait,kind,rule",
    [
        ("yeux verts", "ses yeux verts", "eye_color", "global", None),
        ("Yeux verts", "ses yeux verts", "hair_color", "global", "trait_subject"),
        ("noirs", "des cheveux noirs", "hair_color", "global", None),
        ("noirs", "des cheveux et une barbe noirs", "beard_color", "global", None),
        ("noirs", "des cheveux noirs", "eye_color", "global", "trait_subject"),
        ("jeune femme", "une jeune femme", "gender", "global", None),
        ("jeune", "une jeune femme", "gender", "global", "trait_subject"),
        ("long black hair", "", "hair_color", "global", None),
        ("long black hair", "", "hair_style", "global", "hair_property"),
        ("élancée et grande", "", "build", "global", None),
        ("slim and tall", "", "height", "global", None),
        ("hairy legs", "", "skin_color", "global", "limb_property"),
        ("exposed arms", "", "arm_build", "global", "exposed_clothing"),
        ("exposed arms", "", "arm_build", "local", None),
        ("bright eyes", "", "eye_color", "local", "eye_brightness"),
        ("two-day beard", "", "facial_hair", "global", "passing_trait"),
        ("a scar on the chin", "", "chin", "global", "trait_subject"),
        ("a scar on the chin", "", "distinguishing_mark", "global", None),
        ("powerful arms", "", "arm_build", "global", None),
        ("tout en bras, en jambes", "", "build", "global", None),
        ("beard", "", "context", "context", None),
        (None, None, "height", "global", None),
    ],
)
def test_trait_subjects(spark, value, quotation, trait, kind, rule):
    attributes = [*traits.PHYSICAL, "clothing", "accessory", "voice", None]
    rows = spark.createDataFrame([(str(a), trait, kind, value, quotation, a) for a in attributes], "evidence_id string, trait string, kind string, value string, quotation string, attribute string")
    found = traits.trait_violations(rows).collect()
    assert {r["evidence_id"]: r["rule"] for r in found} == ({a: rule for a in traits.PHYSICAL} if rule else {})


def test_trait_subjects_ask_every_part(spark):
    from corpusledger.plans import rule_queries

    rows = rule_queries.trait_rows(spark, "/root/testdata/sf0.001")
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
    assert rows.filter(F.col("attribute").isin(traits.PHYSICAL)).count() == parts


def test_global_traits_and_evidence(spark):
    given = [(1, "t", "global", "explicit", "persistent", "age"), (2, "t", "global", "inferred", "persistent", "age"), (3, "t", "global", "explicit", "persistent", "clothing"), (4, "t", "local", "inferred", None, None), (5, "t", "global", None, None, None)]
    rows = spark.createDataFrame(given, "evidence_id long, trait string, kind string, classification string, persistence string, attribute string")
    assert values(traits.global_violations(rows), "evidence_id", "rule") == [(2, "weak_global"), (3, "temporary_global"), (5, "weak_global")]
    trait = "array<struct<attribute:string,description:string,scope:string,evidence:string>>"
    seen = [("s", "a", "characters", "visible", [("wardrobe_coat", "red", "scene", "a red  coat"), ("eye_color", "x", "scene", "red")]), ("s", "b", "objects", "visible", [("colour", "x", "scene", "red")]), ("s", "c", "locations", "near", []), ("s", "d", "locations", "visible", [("fog", "x", "scene", "in fog"), ("fog", None, "scene", "red"), ("fog", "x", "scene", "wore a red coat")]), ("s", "e", "locations", "visible", None)]
    observations = spark.createDataFrame(seen, f"k string, entity string, kind string, presence string, visual_traits {trait}")
    texts = spark.createDataFrame([("s", "Mara wore a red\ncoat.")], "k string, t string")
    found = values(traits.evidence_violations(observations, texts, ["k"], "t"), "entity", "trait_no", "rule")
    assert found == [("a", 2, "character_trait"), ("b", 1, "object_trait"), ("c", 0, "invalid_observation"), ("d", 1, "evidence_not_local"), ("d", 2, "invalid_trait"), ("e", 0, "invalid_observation")]
    scene = "array<struct<chapter:string,sequence:string,presence:string,traits:" + trait + ",excluded_attributes:array<string>>>"
    good, bad = ("wood", "oak", "intrinsic", "oak"), ("fog", "x", "scene", "fog")
    refs = spark.createDataFrame([("a", "locations", [good, bad], [("c", "1", "visible", [bad], ["x"]), ("c", "0", "visible", [], []), ("c", "2", "seen", [], []), ("c", "3", "visible", [("", "x", "scene", "y")], [])]), ("b", "objects", [good], [])], f"entity string, kind string, common_traits {trait}, scenes {scene}")
    assert values(traits.reference_violations(refs), "entity", "place", "rule") == [("a", "c/0", "invalid_scene"), ("a", "c/2", "invalid_scene"), ("a", "c/3", "invalid_trait"), ("a", "common", "common_not_intrinsic")]


GOOD = """subject_definitions:
<Subject 1>: Mara, seen in <Picture 1>
<Audio 1>: her voice

summary:
[reference generation + audio reference] Mara walks.

retention_analysis:
<Subject 1> face: fully_preserved - kept
<Audio 1> voice: reference - kept

detailed_description:
[Shot 1] Mara walks. <d>[English] Hello.</d>
[Shot 2] At 00:03.000, she stops.

overall_soundscape:
wind

non_diegetic_music:
none
"""


@pytest.mark.parametrize(
    "old,new,rules",
    [
        ("", "", []),
        ("wind", "wind PIC_9", ["internal_id"]),
        ("[English] Hello", "[English] CHAR_1", []),
        ("overall_soundscape:\nwind\n\n", "", ["section_count"]),
        ("overall_soundscape:\nwind\n\nnon_diegetic_music:\nnone", "non_diegetic_music:\nnone\n\noverall_soundscape:\nwind", ["section_order"]),
        ("[reference generation + audio reference] ", "", ["task_missing"]),
        ("+ audio reference]", "+ reference generation]", ["task_repeated", "task_unexpected"]),
        ("+ audio reference]", "+ song]", ["task_unexpected", "task_unknown"]),
        ("[Shot 2]", "[Shot 3]", ["shot_numbering"]),
        ("[Shot 1] Mara", "[Shot 1] At 0:01 Mara", ["first_shot_timed"]),
        (" At 00:03.000,", "", ["missing_timestamp"]),
        ("00:03.000", "00:01.000", ["short_shot"]),
        ("00:03.000", "00:63.000", ["bad_seconds", "time_beyond_end"]),
        ("00:03.000", "00:07.000", ["short_shot"]),
        ("00:03.000", "00:00.000", ["short_shot", "times_not_rising"]),
        ("[English] Hello", "Hello", ["dialogue_language"]),
        ("wind", "```wind", ["code_fence"]),
        ("wind", "<Subject 2> <Video 1>", ["unbound_label", "unbound_label"]),
        ("Mara, seen in <Picture 1>", "Mara", ["uncited_picture"]),
        ("<Subject 1>: Mara, seen", "Mara, seen", ["undefined_label"]),
        ("<Audio 1>: her voice\n", "", ["undefined_label"]),
        ("fully_preserved", "fully_copy", ["unknown_marker"]),
        ("<Subject 1> face: fully", "<Picture 1> face: fully", ["picture_kept_alone"]),
        ("face: fully_preserved - kept", "face: fully_preserved - kept (S1)", ["speaker_kept"]),
        ("she stops.", "she stops " * 300, ["too_long"]),
    ],
)
def test_prompt_rules(spark, old, new, rules):
    row = (1, GOOD.replace(old, new, 1) if old else GOOD, 8.0, [("<Subject 1>", ["<Picture 1>"])], ["<Audio 1>"], False)
    df = spark.createDataFrame([row], "k long, text string, duration double, subjects array<struct<label:string,pictures:array<string>>>, audio array<string>, has_frame boolean")
    assert [r[1] for r in values(prompts.prompt_violations(df, "k", "text", 3), "k", "rule")] == sorted(rules)


def test_prompts_are_read_once_by_many_tasks(spark):
    from corpusledger.plans import rule_queries

    rows = rule_queries.prompt_rows(spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() == 4
    bodies = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count(r"[\s\S]*?")
    assert bodies(prompts.prompt_violations(rows, "c_custkey", "text", 3)) == 4  # one for each body that a rule asks for
    found = spark.createDataFrame([(1, "code_fence", "")], "c_custkey long, rule string, detail string")
    assert bodies(prompts.routed(found, rows, "c_custkey", "text")) == len(T.SECTIONS)


def test_one_shot_and_strings(spark):
    df = spark.createDataFrame([(1, GOOD, 8.0, [("<Subject 1>", ["<Picture 1>"])], ["<Audio 1>"], True)], "k long, text string, duration double, subjects array<struct<label:string,pictures:array<string>>>, audio array<string>, has_frame boolean")
    assert [r[0] for r in values(prompts.prompt_violations(df, "k", "text", 1), "rule")] == ["not_one_shot", "task_unexpected", "too_many_shots"]
    one = lambda e: spark.range(1).select(e.alias("x")).first()["x"]
    assert [one(prompts.allowed_shots(F.lit(d), 3)) for d in (1.0, 5.0, 7.5, 60.0)] == [1, 2, 3, 3]
    assert one(prompts.pacing(F.lit(2.0), 3)).startswith("One continuous shot") and "At most 2" in one(prompts.pacing(F.lit(5.0), 9))
    assert one(prompts.image_prompt(F.lit(" Mara "), F.lit("ink"), F.lit("Close."), F.lit("red coat. "), F.lit(None).cast("string"))) == "Close. ink image of Mara. red coat. Single image, single view. No added captions or watermark."


def test_documents(spark):
    schema = {"type": "object", "properties": {"a": {"type": "integer"}, "l": {"type": "array", "min_items": 1, "items": {"type": "object", "properties": {"k": {"type": "string", "enum": ["x", "y"]}}}}}, "required": ["a"]}
    given = [(1, '{"a": 1, "l": [{"k": "x"}]}'), (2, '{"a": true, "l": []}'), (3, '{"l": [{"k": "z"}, {"j": 1}, 5]}'), (4, "[]"), (5, None), (6, '{"a": null, "b": {}}')]
    rows = spark.createDataFrame(given, "i long, t string").select("i", F.parse_json("t").alias("v"))
    found = documents.document_violations(rows, "i", "v", schema)
    assert values(found, "i", "path", "rule") == [(2, "$.a", "wrong_type"), (2, "$.l", "too_few_items"), (3, "$", "missing_field"), (3, "$.l[0].k", "not_in_enum"), (3, "$.l[1]", "missing_field"), (3, "$.l[1].j", "unknown_field"), (3, "$.l[2]", "wrong_type"), (4, "$", "wrong_type"), (5, "$", "wrong_type"), (6, "$.a", "wrong_type"), (6, "$.b", "unknown_field")]
    assert values(documents.first_violations(found, "i"), "i", "path")[1] == (3, "$")


def test_resume(spark):
    texts = spark.createDataFrame([(i, "abcdef") for i in range(6)], "chapter_id long, text string")
    committed = spark.createDataFrame([(0, 1, "ab"), (0, 2, "cd"), (1, 1, "ab"), (1, 3, "cd"), (2, 1, "ab"), (2, 2, "xx"), (3, 1, "ab"), (4, 1, "ab"), (4, 1, "cd")], "chapter_id long, sequence int, source string")
    saved = spark.createDataFrame([(i, "d", "e" if i == 3 else "d") for i in range(6)], "chapter_id long, saved_digest string, replayed_digest string")
    assert values(timeline.resume(committed, texts, saved), "chapter_id", "cursor", "n_sequences", "rule") == [(0, 4, 2, None), (1, 0, 0, "numbering"), (2, 0, 0, "source_changed"), (3, 0, 0, "ledger_differs"), (4, 0, 0, "numbering"), (5, 0, 0, None)]


@pytest.mark.parametrize(
    "a,b,context,linked",
    [
        ("Henry", "Jones", "There stood Henry Jones.", True),
        ("Henry", "Jones", "There stood Henry, Jones.", False),
        ("Henry", "Jones", "Henry\nJones", False),
        ("Alice", "Lady Alice", "Then Lady Alice came.", True),
        ("Alice", "Lady Alice", "Then Alice came.", False),
        ("Jones", "Indy", "Henry Jones Jr., surnommé Indy, rit.", True),
        ("Jones", "Indy", "Jones met Indy.", False),
        ("Mara", "the Heron", "Mara is also known as the Heron.", True),
        ("le Héron", "Mara", "Mara était appelée « le Héron ».", True),
        ("Mara Voss", "Min", "Mara Voss. Those who knew her called her Min.", False),
        ("Mara Voss", "Min", "Mara Voss. But those who knew her called her Min.", True),
        ("", "Min", "Min", False),
    ],
)
def test_names_link(a, b, context, linked):
    assert udfs.names_link(a, b, context) is linked and udfs.names_link(b, a, context) is linked


def test_labels_are_repaired_where_it_helps(spark):
    subject = "array<struct<label:string,pictures:array<string>>>"
    assets = "array<struct<label:string,asset:string,picture:string>>"
    one = [("<Subject 1>", "a.jpg", "<Picture 1>")]
    bad = GOOD.replace("seen in <Picture 1>", "seen in a.jpg, xa.jpg").replace("wind", "wind a.jpg")
    given = {
        "mended": (bad, one, True),
        "two pictures": (bad, [*one, ("<Subject 1>", "a.jpg", "<Picture 2>")], False),
        "another's": (bad, [("<Subject 2>", "a.jpg", "<Picture 1>")], False),
        "no help": (GOOD.replace("Mara, seen", "Mara a.jpg, seen"), one, False),
        "no assets": (bad, [], False),
        "nothing to do": (GOOD, one, False),
        "no text": (None, one, False),
        "no section": ("a.jpg", one, False),
    }
    rows = spark.createDataFrame([(k, t, 6.0, [("<Subject 1>", ["<Picture 1>"])], ["<Audio 1>"], False, a) for k, (t, a, _) in given.items()], f"k string, text string, duration double, subjects {subject}, audio array<string>, has_frame boolean, assets {assets}")
    out = {r["k"]: (r["text"], r["repaired"]) for r in prompts.label_repairs(rows, "k", "text", 2).collect()}
    assert out == {k: (t.replace("seen in a.jpg,", "seen in <Picture 1>,") if mended else t, mended) for k, (t, _, mended) in given.items()}
    broken = lambda df: {(r["k"], r["rule"], r["detail"]) for r in prompts.prompt_violations(df, "k", "text", 2).collect()}
    assert broken(prompts.label_repairs(rows, "k", "text", 2).drop("repaired")) < broken(rows)


def test_a_local_catalog_makes_its_keys_once(spark):
    given = [
        (1, "p", "The Mara", "Red", 3, 5), (1, "p", "MARA", "red", 2, 7), (1, "p", "Mara", "Mara", 1, 11),
        (1, "p", "Stra\u00dfe", "Boss", 1, 6), (1, "p", "STRASSE", "boss", 4, 9), (1, "l", "Harbour", "Boss", 1, 8), (1, "l", "Harbour", "Mara", 1, 10),
        (1, "p", " ", "Nobody", 1, 1), (1, "p", None, "Red", 1, 2), (1, "l", "Quay", None, 9, 12), (1, "l", "Quay", "Nobody", 9, 13), (1, "l", "Quay", "", 9, 14), (2, "p", "mara", "Boss", 1, 1),
    ]
    out = catalogs.local_catalog(spark.createDataFrame(given, "chapter_id int, kind string, name string, alias string, sequence int, ord long"))
    want = [(1, "l", "l_001", "Harbour", 1, []), (1, "l", "l_002", "Quay", 9, ["Nobody"]), (1, "p", "p_001", "The Mara", 1, ["Red"]), (1, "p", "p_002", "Stra\u00dfe", 1, []), (2, "p", "p_001", "mara", 1, ["Boss"])]
    assert values(out, "chapter_id", "kind", "local_id", "canonical_name", "first_sequence", "aliases") == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan


def test_labels_are_repaired_within_rows(spark):
    from corpusledger.operators.lineage import spread

    bad = GOOD.replace("seen in <Picture 1>", "seen in a.jpg")
    given = [(1, bad), (1, GOOD), (2, bad), (2, bad), (3, None)]  # a key may come again
    rows = spread(spark.createDataFrame([(k, t, 6.0, [("<Subject 1>", ["<Picture 1>"])], ["<Audio 1>"], False, [("<Subject 1>", "a.jpg", "<Picture 1>")]) for k, t in given], "k long, text string, duration double, subjects array<struct<label:string,pictures:array<string>>>, audio array<string>, has_frame boolean, assets array<struct<label:string,asset:string,picture:string>>"), "k")
    out = prompts.label_repairs(rows, "k", "text", 2)
    assert values(out, "k", "text", "repaired") == sorted([(k, GOOD if t else t, t == bad) for k, t in given], key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # what a row's edit costs is paid after the rows are dealt, and once
    assert "Join" not in plan and "Filter " not in plan and plan.index("Project") < plan.index("RepartitionByExpression")
    assert "regexp_extract" not in plan[plan.index("RepartitionByExpression") :]


def test_dossier_pairs_come_once_without_a_sort_of_all(spark):
    import itertools
    import random

    pick = random.Random(4)
    names = [f"Name{c}" for c in "ABCDEF"]
    own = {i: set(pick.sample(names, pick.randint(1, 3))) for i in range(40)}
    said = {i: set(pick.sample(names, 2)) for i in range(0, 40, 3)}
    seen = {(a, a + 1) for a in range(0, 39, 5)}
    labels = spark.createDataFrame([(i, x) for i, given in own.items() for x in given], "group long, label string")
    quotes = spark.createDataFrame([(i, f"{' met '.join(given)}.") for i, given in said.items()], "group long, quotation string")
    compared = spark.createDataFrame([(b, a) for a, b in seen], "a long, b long")
    bridges = spark.createDataFrame([("NameA", "x"), ("NameB", "x"), ("NameC", "y")], "label string, component string")
    part = lambda i: {{"NameA": "x", "NameB": "x", "NameC": "y"}.get(n, n) for n in own[i]}
    met = lambda a, b: own[a] & own[b] or said.get(a, set()) & own[b] or said.get(b, set()) & own[a]
    want = [(a, b) for a, b in itertools.combinations(own, 2) if met(a, b) and part(a) & part(b) and (a, b) not in seen]
    found = identity.dossier_pairs(labels, quotes, compared, compared.limit(0), bridges)
    assert values(found, "a", "b") == sorted(want, key=str)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join Inner")]


def test_errors_are_routed(spark):
    rows = spark.createDataFrame([("a", GOOD.replace("[English] Hello.", "Hello.").replace("wind", "```wind <Picture 7>").replace("Mara walks.\n\nretention", "Mara <Picture 7> <Picture 8> walks.\n\nretention"))], "k string, text string")
    found = spark.createDataFrame([("a", r, d) for r, d in [("task_missing", ""), ("dialogue_language", ""), ("code_fence", ""), ("unbound_label", "<Picture 7>,<Picture 8>"), ("section_order", ""), ("too_long", "600"), ("unbound_label", "<Picture 9>")]], "k string, rule string, detail string")
    out = {(r["rule"], r["detail"]): r["sections"] for r in prompts.routed(found, rows, "k", "text").collect()}
    every = list(T.SECTIONS)
    assert out == {("task_missing", ""): ["summary"], ("dialogue_language", ""): ["detailed_description"], ("code_fence", ""): ["overall_soundscape"], ("unbound_label", "<Picture 7>,<Picture 8>"): ["summary", "overall_soundscape"], ("section_order", ""): every, ("too_long", "600"): ["detailed_description"], ("unbound_label", "<Picture 9>"): every}


def test_all_names_at_once_link_as_pairs_do(spark):
    """One automaton over all names against one for each pair of them."""
    import itertools
    import random

    pick = random.Random(9)
    names = ["Mara", "Voss", "Mara Voss", "Min", "the Heron", "Al", "Alba", "Heron", "le Héron", "Jones Jr."]
    glue = [" ", " ", ", ", ", alias ", " was called ", " est nommé « ", ". But those who knew her called her ", " and ", "  ", "\n", "\u00a0", " Jr., surnommée ", "-", " is also known as the ", ". "]
    contexts = ["".join(pick.choice(names) + pick.choice(glue) for _ in range(pick.randint(1, 7))) for _ in range(150)] + [None, ""]
    want = {tuple(sorted(p)) for c in contexts if c for p in itertools.combinations(names, 2) if udfs.names_link(*p, c)}
    every = udfs.NameLinks(names)
    for c in contexts:
        assert every.find(c) == {tuple(sorted(p)) for p in itertools.combinations(names, 2) if c and udfs.names_link(*p, c)}
    named = spark.createDataFrame([("g", n) for n in [*names, None, " "]] + [("h", "Mara"), (None, "Min")], "g string, name string")
    given = spark.createDataFrame([("g", c) for c in contexts] + [("h", "Mara Voss"), (None, "Min")], "g string, context string")
    assert {(r["x"], r["y"]) for r in identity.alias_edges(named, given, ["g"]).collect() if r["g"] == "g"} == want and len(want) > 12
    began = time.time()
    assert len(udfs.NameLinks([f"Name{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]).find("Namecb met Namede. " * 20_000)) == 0 and time.time() - began < 10


def test_dossiers_and_partitions(spark):
    labels = spark.createDataFrame([(1, "Mara"), (2, "Mara"), (3, "Heron"), (4, "Otto"), (5, None)], "group long, label string")
    quotes = spark.createDataFrame([(1, "Mara is the Heron."), (4, "He met Mara.")], "group long, quotation string")
    bridges = spark.createDataFrame([("Mara", "c"), ("Heron", "c")], "label string, component string")
    none = spark.createDataFrame([], "a long, b long")
    compared = spark.createDataFrame([(3, 1)], "a long, b long")
    assert values(identity.dossier_pairs(labels, quotes, none, none, bridges), "a", "b") == [(1, 2), (1, 3)]
    assert values(identity.dossier_pairs(labels, quotes, compared, none, bridges), "a", "b") == [(1, 2)]
    records = spark.createDataFrame([(i, n, "explicit" if i < 5 else "inferred") for i, n in ((1, "Mara"), (2, "Heron"), (3, "Otto"), (4, "Otto"), (5, "Ida"), (6, "Ida"))], "evidence_id long, character string, classification string")
    plan = spark.createDataFrame([("p", 1, "Mara", "confirmed"), ("p", 2, "Mara", "confirmed"), ("q", 3, "Otto", "ambiguous"), ("q", 4, "Otto", "ambiguous"), ("r", 5, "Max", "confirmed"), ("r", 9, "Max", "confirmed"), ("s", 1, "Mara", "confirmed")], "profile string, evidence_id long, canonical_name string, identity_status string")
    supports = spark.createDataFrame([("p", 1), ("r", 5), ("q", 1)], "profile string, evidence_id long")
    links = spark.createDataFrame([("p", "Mara", "Heron")], "profile string, x string, y string")
    found = identity.partition_violations(plan, supports, records, links)
    assert values(found, "profile", "evidence_id", "rule") == sorted([(None, 6, "missing_id"), ("p", 1, "repeated_id"), ("s", 1, "repeated_id"), ("r", 9, "foreign_id"), ("r", None, "name_not_supplied"), ("q", None, "ambiguous_merge"), ("q", 1, "foreign_support"), ("r", 5, "weak_support")], key=str)
    assert values(identity.partition_violations(plan.filter("profile = 'p'"), supports.limit(0), records.limit(2), links.limit(0)), "profile", "rule") == [("p", "labels_not_connected")]
    sound = plan.filter("profile = 'p'")
    out = identity.profiles_of(sound, records, found.limit(0)).first()
    assert out["aliases"] == ["Heron"] and out["evidence_ids"] == [1, 2] and out["local_id"].startswith("char_") and len(out["local_id"]) == 29


def test_scene_projections(spark):
    seqs = spark.createDataFrame([("c", 1, "src", ("i", "e", "")), ("c", 12, "src2", ("e", "e", "f"))], "chapter_id string, sequence int, source string, adaptation struct<initial:string,event:string,ending:string>")
    rows = values(catalogs.phase_rows(seqs, "chapter_id"), "sequence", "phase", "content_id")
    assert [r[:2] for r in rows] == [(1, "event"), (1, "initial"), (12, "ending"), (12, "event"), (12, "initial")] and len({r[2] for r in rows}) == 5
    cat = spark.createDataFrame([("c", 1, "hall", "location", "visible"), ("c", 12, "hall", "location", "visible"), ("c", 12, "yard", "location", "visible"), ("c", 12, "mara", "character", "visible")], "chapter_id string, sequence int, entity string, entity_type string, presence string")
    scenes = catalogs.scene_skeletons(seqs, cat, " spring ")
    assert values(scenes, "title", "location", "visible_entities") == [("Sequence 001", "hall", ["hall"]), ("Sequence 012", None, ["hall", "yard"])]
    assert scenes.first()["adaptation_notes"].endswith("\nspring")
    new = spark.createDataFrame([("c", 12, "yard")], "chapter_id string, sequence int, location string")
    assert values(catalogs.with_metadata(scenes, new, ["chapter_id", "sequence"], ["location"]), "sequence", "location") == [(1, "hall"), (12, "yard")]
    assert spark.range(1).select(T.default_period(F.lit(" \n1920s "))).first()[0] == "1920s"
    names = spark.createDataFrame([(1, "Old Mill"), (2, "mara"), (3, "…")], "n long, name string")
    texts = spark.createDataFrame([(7, "By the OLD mill, Mara."), (8, "old millstone"), (9, None)], "i long, t string")
    assert values(catalogs.mentions(texts, names, "i", "t", "n", "name"), "i", "n") == [(7, 1), (7, 2)]


def test_stage_files(spark, tmp_path):
    import json

    def put(name, **document):
        (tmp_path / name).write_text(json.dumps({"schema_version": "v1"} | document))

    state = lambda a, b="e", c="z": {"initialState": a, "event": b, "endingState": c}
    put("c10.cinematic.json", chapter_id="c10", sequences=[{"sequence": 1, "source": "s", "adaptation": state("a")}, {"sequence": 1, "source": " ", "adaptation": state("")}])
    put("c2.cinematic.json", chapter_id="c2", sequences=[])
    put("c1_references.json", chapter_id="c1", entities=[])
    put("consolidated_references.json", entities=[{"global_id": "CHAR_001"}], picture_assets=[])
    (tmp_path / "bad.cinematic.json").write_text("{")
    chapters, rejects = stages.load(spark, str(tmp_path), "chapters", "v1")
    assert values(chapters, "ord", "chapter_id", "source_file") == [(1, "c2", "c2.cinematic.json"), (2, "c10", "c10.cinematic.json")]
    assert values(rejects, "source_file", "reason") == [("bad.cinematic.json", "broken")]
    rows, bad = stages.sequences_of(chapters)
    assert rows.count() == 2 and values(bad, "chapter_id", "rule") == [("c10", "blank_source"), ("c10", "blank_state"), ("c10", "not_increasing"), ("c2", "no_sequences")]
    assert values(stages.load(spark, str(tmp_path), "catalogs", "v1")[0], "source_file") == [("c1_references.json",)]
    assert values(stages.load(spark, str(tmp_path), "registry", "v1")[0], "source_file") == [("consolidated_references.json",)]
    digest = spark.range(1).select(F.sha2(F.lit("text"), 256)).first()[0]
    seen = [{"evidence_id": "e1", "character": "Mara"}]
    put("a_evidence.json", chapter_id="a", source_text="text", source_text_sha256=digest, observations=seen)
    put("b_evidence.json", chapter_id="b", source_text="text, edited", source_text_sha256=digest, observations=seen)
    found, edited = stages.evidence_of(stages.load(spark, str(tmp_path), "evidence", "v1")[0])
    assert values(found, "chapter_id", "evidence_id") == [("a", "e1")] and values(edited, "rule", "key") == [("sha_mismatch", "b")]
    put("x_profiles.json", profiles=[{"local_id": "p", "link_to_local_id": "q"}, {"local_id": "q", "link_to_local_id": "none"}])
    _, links = stages.profiles_of(stages.load(spark, str(tmp_path), "profiles", "v1")[0])
    assert values(links, "rule", "key") == [("chained_link", "p"), ("dangling_link", "q")]


def test_folds_stream_over_batches(spark):
    rows = spark.createDataFrame([(g, i) for i in range(50) for g in (None, 1, 2)], "g long, i int").repartition(5)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        out = lineage.folded(rows, ["g"], ["i"], lambda: 0, lambda s, r: (s + r.i, (s + r.i, None)), {"total": "long", "note": "string"})
        assert values(out, "g", "i", "total", "note") == sorted([(g, i, i * (i + 1) // 2, None) for g in (None, 1, 2) for i in range(50)], key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_plans_lookups_sheets(spark):
    update = "array<struct<entity:string,aspect:string,fact:string,source_quote:string>>"
    good = ("Mara", "place", "hall", "in the hall")
    given = [(1, "She sat in the hall.", [1.0, 0.5], 1.5, False, None, [good]), (2, "She sat.", [float("inf")], 1.0, True, "in a dream", [good]), (3, "In a dream.", [0.0], 0.0, True, "in a dream", [("the", "a", "f", "In a dream"), ("", "a", "f", "In a dream")]), (4, "x", [1.0], 2.0, False, "x", [])]
    plans = spark.createDataFrame(given, f"k long, source string, seconds array<double>, stated double, reset boolean, reset_evidence string, updates {update}")
    assert values(quality.plan_violations(plans, ["k"]), "k", "rule") == [(2, "reset_quote_mismatch"), (2, "source_quote_mismatch"), (2, "timing_nonfinite"), (3, "blank_fact_field"), (3, "reset_quote_mismatch"), (3, "timing_total_mismatch"), (4, "reset_quote_mismatch"), (4, "timing_total_mismatch")]
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    rows = spark.createDataFrame([(1,), (3,)], "k long")
    assert values(assets.lookup(rows, table, "k"), "k", "v") == [(1, "a"), (3, None)]
    with pytest.raises(Exception, match="more than one row for 1"):
        assets.lookup(rows, table.unionByName(table), "k").collect()
    scene = spark.createDataFrame([("c", 1, "T", None, [("<Subject 1>", "Mara", "character", [("<Picture 1>", "face", "base", "m.png")])], [("<Audio 1>", "Mara", "m.wav")], [("Dog", "object")], ["late"], "go \n")], "chapter_id string, sequence int, title string, previous_sequence int, subjects array<struct<label:string,name:string,entity_type:string,pictures:array<struct<label:string,view:string,variant:string,file:string>>>>, audio array<struct<label:string,name:string,file:string>>, unreferenced array<struct<name:string,entity_type:string>>, errors array<string>, prompt string")
    sheet = export.scene_sheet(scene).first()["sheet"]
    assert sheet.split("\n") == ["SCENE: T", "", "REFERENCES IN ORDER:", "<Subject 1> = Mara (character)", "  <Picture 1> = Mara | face | base | m.png", "<Audio 1> = Mara | m.wav", "No image attached: Dog (object)", "", "VALIDATION WARNINGS:", "late", "", "PROMPT:", "go", ""] or sheet.rstrip().endswith("go")


def test_name_ratio_equals_plain_python(spark, tmp_path):
    import difflib

    from corpusledger.plans import registry

    names = ["red ring", "red rings", "old plate", "cold plates", "tin", "lead cup", ""]
    rows = [(i, names[i % 7], f"B{i % 3}", "T", i) for i in range(40)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    want, last = [], {}
    for i, n, brand, *_ in rows:
        if brand in last:
            m = difflib.SequenceMatcher(None, n, last[brand])
            block = difflib.SequenceMatcher(None, n, last[brand], autojunk=False).find_longest_match()
            want.append((i, round(m.ratio(), 9), block.a, block.b, block.size))
        last[brand] = n
    out = registry.QUERIES["name_ratio"](spark, str(tmp_path))
    assert values(out, "entity_id", F.round("ratio", 9), "a_start", "b_start", "size") == sorted(want, key=str)


def test_structs_and_context(spark):
    rows = spark.createDataFrame([(1, 2, "t", "s", "c")], "k long, sequence int, title string, source string, _source_context string")
    packed = catalogs.as_struct(catalogs.without_context(rows), ["k"], "scene", ["source"])
    assert packed.columns == ["k", "scene"] and catalogs.from_struct(packed, ["k"], "scene").columns == ["k", "sequence", "title"]
    assert catalogs.without_context(rows).columns == ["k", "sequence", "title", "source"]
