"""Cases of the engine's own operators on small invented rows."""

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusledger.functions import text as T
from corpusledger.functions import udfs
from corpusledger.operators import assets, chunking, decisions, evidence, identity, intervals, quality, spans, timeline
from corpusledger.plans import registry
from corpusledger.sources import chapters as sources
from corpusledger.sources import export


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,normal", [("a\r\nb\rc", "a\nb\nc"), ("\u00abl\u2019\u00e9t\u00e9\u00bb", "\"l'\u00e9t\u00e9\""), ("a\u00a0b\u202fc", "a b c"), ("x\u2028y\u2029z", "x\ny\n\nz"), ("e\u0301", "\u00e9"), ("", "")])
def test_normalize(spark, raw, normal):
    assert one(spark, T.normalize_text(F.lit(raw))) == normal


def test_text_functions(spark):
    assert one(spark, T.comparison_text(F.lit(" a\u00a0 \n b  "))) == "a b"
    assert one(spark, T.contained(F.lit(""), F.lit("abc"))) is False
    names = ["chapter10", "Chapter2", "chapter1"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r["n"] for r in df.orderBy(T.natural_key(F.col("n"))).collect()] == ["chapter1", "Chapter2", "chapter10"]
    assert one(spark, T.slug(F.lit("  Été: à / l'eau.. "))) == "Été_à_l_eau"
    assert one(spark, T.slug(F.lit("..."))) == "chapter"
    assert one(spark, T.name_key(F.lit("Straße-42, O'Neil"))) == "strasse 42 o neil"
    assert one(spark, T.attribute_key(F.lit(" Hair Color! "))) == "hair_color"
    assert one(spark, T.entity_key(F.lit("The  Old   Mill"))) == "old mill"
    assert one(spark, T.entity_key(F.lit("L’Île"))) == "île"
    assert one(spark, T.timestamp_seconds(F.lit("02:03.500"))) == 123.5
    assert one(spark, T.word_count(F.lit("l'eau est-elle l\u00e0?"))) == 3
    assert one(spark, T.leaks_metadata(F.lit("a\n source_excerpt: b"))) is True
    assert one(spark, T.dedupe_folded(F.array(*map(F.lit, ["A b", "a  B", "c", ""])), 5)) == ["A b", "c"]
    assert one(spark, T.compact_strings(F.array(*map(F.lit, [" abcdef ", "abc", "x"])), 3, 2)) == ["abc", "x"]
    a, b = (one(spark, T.digest_id("e_", 24, F.lit(x), F.lit(y).cast("string"))) for x, y in (("q", None), ("q", "")))
    assert a != b and len(a) == 26
    reply = F.lit("<think>{no}</think>\n```json\n{\"a\": {\"b\": [1, \"two\"]}}\n```")
    assert one(spark, T.pointer_value(T.reply_json(reply), "/a/b/1")) == "two"
    assert one(spark, T.pointer_value(T.reply_json(F.lit("say {\"a\": 1} now")), "/a")) == "1"
    text = F.lit("subject_definitions:\n<Subject 1>\n\nSummary: \n[x] a hall\nwide\n\n")
    assert one(spark, T.section_map(text)) == {"subject_definitions": "<Subject 1>", "summary": "[x] a hall\nwide"}
    assert one(spark, T.sections_text(T.section_map(text))) == "subject_definitions:\n<Subject 1>\n\nsummary:\n[x] a hall\nwide"
    assert one(spark, T.fully_sectioned(text)) is False
    full = F.lit("\n".join(f"{s}: body {i} <d>[En]x</d>" for i, s in enumerate(T.SECTIONS)))
    canonical = T.canonical_sections(full)
    assert one(spark, T.fully_sectioned(canonical)) is True and one(spark, T.section_body(canonical, "non_diegetic_music")) == "body 5 <d>[En] x</d>"
    new = F.create_map(F.lit("summary"), F.lit("changed"))
    assert one(spark, T.section_map(T.replaced_sections(canonical, new)))["summary"] == "changed" and one(spark, T.replaced_sections(text, new)) is None
    assert one(spark, T.path_key(F.lit("C:/Books/A.txt"))) == "c:\\books\\a.txt"
    assert one(spark, udfs.plain(F.lit("Éléonore ﬁ"))) == "Eleonore fi"


@pytest.mark.parametrize("text,quote,found", [("aaaa", "aaa", [(0, 3), (1, 4)]), ("one two\n three", "two three", [(4, 14)]), ("abc", "", []), ("abc", "abd", []), ("", "a", []), ("x y x y", "x y", [(0, 3), (4, 7)])])
def test_spans(text, quote, found):
    assert udfs.find_spans(text, quote) == found


def test_span_operators(spark):
    texts = spark.createDataFrame([(1, "Night fell.\nThe bell rang. Night  fell."), (2, None), (3, "  The bell rang.  ")], "d long, t string")
    quotes = spark.createDataFrame([(7, "Night fell."), (8, "The bell rang."), (9, None), (10, " ")], "q long, s string")
    places = spans.locate(texts, quotes, "d", "t", "q", "s")
    assert values(places, "d", "q", "start_char", "end_char") == [(1, 7, 0, 11), (1, 7, 27, 39), (1, 8, 12, 26), (3, 8, 2, 16)]
    assert values(spans.with_lines(places, ["d", "q"]), "d", "q", "start_line")[:3] == [(1, 7, 1), (1, 7, 2), (1, 8, 2)]
    assert values(spans.unique(places, ["d", "q"]), "d", "q") == [(1, 8), (3, 8)]
    assert values(spans.restored(places, ["d", "q"]), "d", "q") == [(1, 8), (3, 8)]
    assert values(spans.prefix_span(places, ["d", "q"]), "d", "q", "start_char", "end_char") == [(1, 7, 0, 11), (3, 8, 0, 16)]
    assert values(spans.suffix_span(places, ["d", "q"]), "d", "q", "start_char", "end_char") == [(1, 7, 26, 39), (3, 8, 0, 18)]
    assert values(spans.anchored(places, quotes, ["d", "q"], "q", "s"), "d", "q", "quote") == [(1, 7, "Night fell."), (1, 8, "The bell rang."), (3, 8, "The bell rang.")]
    kept, spans.MOST_QUOTES = spans.MOST_QUOTES, 1
    try:
        again = spans.locate(texts, quotes, "d", "t", "q", "s")
        assert values(again, "d", "q", "start_char", "end_char") == values(places, "d", "q", "start_char", "end_char")
    finally:
        spans.MOST_QUOTES = kept


def test_cutting(spark):
    spark.udtf.register("lossless_chunks", udfs.LosslessChunks)
    for text in ("", "a" * 25, "One. Two! Three? Four five six seven", "a b\n\nc d e f g h i", "Été… oui. " * 20):
        for most in (5, 9, 40):
            rows = spark.createDataFrame([(text,)], "t string").createOrReplaceTempView("_cut") or spark.sql(f"SELECT p.* FROM _cut, LATERAL lossless_chunks(t, {most}) p ORDER BY piece_no").collect()
            assert "".join(r["piece"] for r in rows) == text and all(0 < len(r["piece"]) <= most for r in rows)
            assert [r["start_char"] for r in rows] == [sum(len(q["piece"]) for q in rows[:i]) for i in range(len(rows))]
    for text, most, cut in (("ab\n \ncd. ef gh", 12, 5), ("ab cd. ef gh", 10, 7), ('ab? "cd." ef', 9, 9), ("ab cdef gh", 6, 3), ("abcdefgh", 5, 5), ("a.b c", 4, 4), (" \n\n abc", 5, 3)):
        assert udfs.last_pause(text, 0, most) == cut
    df = spark.createDataFrame([(1, "x" * 250), (2, ""), (3, "ab")], "d long, t string")
    out = values(chunking.fixed_passages(df, "t", 100), "d", "start_char", F.length("passage"))
    assert out == [(1, 0, 100), (1, 150, 100), (1, 75, 100), (3, 0, 2)]
    paragraphs = spark.createDataFrame([(1, "aaa\n\nbbb\n \ncccccccccc\n\nd"), (2, "\n\n")], "d long, t string")
    assert values(chunking.paragraph_chunks(paragraphs, "t", 8), "d", "chunk_no", "chunk") == [(1, 0, "aaa\n\nbbb"), (1, 1, "cccccccccc"), (1, 2, "d"), (2, 0, "\n\n")]
    parts = chunking.segments(spark.createDataFrame([(1, " a  b c\n"), (2, "  "), (3, "")], "d long, t string"), "t")
    assert values(parts, "d", "segment_no", "segment") == [(1, 1, " a  "), (1, 2, "b "), (1, 3, "c\n"), (2, 1, "  ")]
    ends = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (2, 1, 5)], "d long, span_no int, end int")
    good, bad = chunking.spans_of_segments(ends, parts, ["d"])
    assert values(good, "d", "span") == [(1, " a  b "), (1, "c\n")] and values(bad, "d", "detail") == [(2, 1)]
    assert values(chunking.halve(spark.createDataFrame([(1, "y" * 1000), (2, "z")], "d long, t string"), "t"), "d", "part", F.length("piece"), "status") == [(1, 0, 625, "split"), (1, 1, 500, "split"), (2, 0, 1, "too_small")]


def test_packing(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate([4, 4, 9, 30, 1, 1, 1])], "d long, i long, c int")
    out = values(chunking.pack(df, ["d"], "i", F.col("c"), 10, most_items=3), "i", "batch_no", "status")
    assert out == [(0, 0, "packed"), (1, 0, "packed"), (2, 1, "packed"), (3, None, "over_budget"), (4, 1, "packed"), (5, 2, "packed"), (6, 2, "packed")]


@pytest.mark.parametrize("n_quotes,copy", [(50_000, 1000), (300, 3)])
def test_many_quotes_meet_the_texts_by_words(spark, n_quotes, copy, monkeypatch):
    import random

    pick = random.Random(n_quotes)
    words = ["the", "of", "stone", "river", "a.b*", "é", "gate,", *(f"w{i}" for i in range(400))]
    gaps = [" ", " ", " ", "\n", " \u00a0", "\x1c", "\t "]
    texts = ["".join(pick.choice(words) + pick.choice(gaps) for _ in range(150)) for _ in range(60)]
    quotes = []
    for _ in range(n_quotes):
        parts = pick.choice(texts).split()
        a, n = pick.randrange(140), pick.randint(1, 6)
        quote = pick.choice(gaps).join(parts[a : a + n])
        quotes.append(pick.choice([quote, quote, quote[1:], quote[:-1], quote + " nowhere"]))
    quotes += [None, "  ", "the stone the", quotes[0]]
    given = spark.createDataFrame([*((i % 58, t) for i, t in enumerate(texts)), (None, texts[0]), (99, None)], "d long, t string")
    asked = spark.createDataFrame([*enumerate(quotes), (7, quotes[7])], "q long, s string")
    columns = ["d", "q", "start_char", "end_char", "start_line", "wording", "closing_start"]
    monkeypatch.setattr(spans, "MOST_QUOTES", n_quotes * 2)
    want = values(spans.locate(given, asked, "d", "t", "q", "s"), *columns)
    monkeypatch.setattr(spans, "MOST_QUOTES", 20_000 if n_quotes > 20_000 else 150)
    monkeypatch.setattr(spans, "QUOTES_A_COPY", copy)
    long = asked.filter(F.size(spans.words(F.col("s"))) >= 3)
    out = spans.places_by_words(given, long, "d", "t", "q", "s")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2  # texts once, and what is asked of them
    assert values(spans.locate(given, asked, "d", "t", "q", "s"), *columns) == want and len(want) > n_quotes / 2


@pytest.mark.parametrize("most,most_items,gap,parts", [(10, None, 0, 9), (25, 3, 2, 6), (400, None, 1, 5), (3, 2, 0, 12), (10**6, None, 0, 4)])
def test_packing_in_ranges_equals_the_fold(spark, most, most_items, gap, parts):
    import random

    pick = random.Random(most + parts)
    given = [(g, i, pick.choice([0, 0, 1, 2, 3, 5, 9, 11, 30, None])) for g, n in (("a", 2), ("b", 150), ("c", 1), (None, 60), ("d", 7)) for i in range(n)]
    want, at = [], object()
    for g, i, c in sorted(given, key=lambda r: (str(r[0]), r[1])):
        if g != at:
            at, batch, size, items = g, 0, 0, 0
        if c is None or c > most:
            want.append((g, i, None, "over_budget"))
            continue
        more = c + (gap if items else 0)
        if items and (size + more > most or (most_items and items >= most_items)):
            batch, size, items, more = batch + 1, 0, 0, c
        size, items = size + more, items + 1
        want.append((g, i, batch, "packed"))
    out = chunking.pack(spark.createDataFrame(given, "g string, i long, c int"), ["g"], "i", F.col("c"), most, most_items, gap, parts)
    assert values(out, "g", "i", "batch_no", "status") == sorted(want, key=str)


def test_one_large_group_is_packed_by_many_tasks(spark):
    n, most = 1_000_000, 1000
    cost = F.pmod(F.xxhash64("i"), F.lit(90)).cast("int")
    rows = spark.range(n).withColumnRenamed("id", "i").select(F.lit(1).alias("g"), "i", cost.alias("c"))
    out = chunking.pack(rows, ["g"], "i", F.col("c"), most, parts=8)
    assert out.rdd.getNumPartitions() == 8
    table = out.select("i", "c", "batch_no").toArrow().sort_by("i")
    batch, size, items, want = 0, 0, 0, []
    for c in table.column("c").to_pylist():
        if items and size + c > most:
            batch, size, items = batch + 1, 0, 0
        size, items = size + c, items + 1
        want.append(batch)
    assert table.column("batch_no").to_pylist() == want and batch > 40_000


@pytest.mark.parametrize("parts", [1, 7])
def test_identity_windows_in_ranges(spark, parts):
    import random

    from corpusledger.operators import reviews

    pick = random.Random(parts)
    jobs = [(g, i, pick.choice([100, 3000, 7000, 12_000, 15_000]), pick.choice([0, 3, 20, 40])) for g, n in (("a", 90), ("b", 1), ("c", 30)) for i in range(n)]
    want, at = [], None
    for g, i, chars, many in jobs:
        if g != at:
            at, window, count, sums, context, before = g, 0, 0, (0, 0), None, None
        if count and (count >= reviews.WINDOW_JOBS or sums[0] + chars > reviews.WINDOW_CHARS or sums[1] + many > reviews.WINDOW_CANDIDATES):
            window, count, sums, context = window + 1, 0, (0, 0), before
        count, sums, before = count + 1, (sums[0] + chars, sums[1] + many), i
        want.append((g, i, window, context))
    out = reviews.identity_windows(spark.createDataFrame(jobs, "g string, ord long, n_chars int, n_candidates int"), ["g"], parts)
    assert values(out, "g", "ord", "window_no", "context") == sorted(want, key=str)


def test_intervals(spark):
    df = spark.createDataFrame([("k", 0, 5), ("k", 5, 7), ("k", 6, 9), ("k", 20, 20), ("k", 10, 12), (None, 1, 2)], "k string, s int, e int")
    assert values(intervals.merge(df, ["k"], "s", "e"), "k", "s", "e") == [("k", 0, 9), ("k", 10, 12), (None, 1, 2)]
    assert values(intervals.merge(df, ["k"], "s", "e", touching=False), "k", "s", "e") == [("k", 0, 5), ("k", 10, 12), ("k", 5, 9), (None, 1, 2)]
    spans_ = spark.createDataFrame([("f", 1, 0, 700), ("f", 2, 200, 900), ("f", 3, 900, 950), ("g", 4, 0, 700)], "f string, item int, start_char int, end_char int")
    contexts, refs = chunking.shared_contexts(spans_, ["f"])
    assert contexts.count() == 3 and values(refs, "item", "passage_id", "offset") == [(1, 1, 0), (2, 1, 200), (3, 2, 0), (4, 1, 0)]


def test_names(spark):
    texts = spark.createDataFrame([(1, "Then Mara met l'Étienne. Stone walls. He said: Mara ran."), (2, "A stone fell on Mara. Walls fell.")], "d long, t string")
    found = {r["name"] for r in evidence.index_names(texts, ["d"], "t").collect()}
    assert found == {"mara", "étienne"}
    rows = [r for r in evidence.index_names(texts, ["d"], "t").collect() if r["name"] == "étienne"]
    assert [(r["start_char"], r["end_char"]) for r in rows] == [(14, 23)]


def test_locate_and_verdicts(spark):
    obs = spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (1, 3, "y")], "d long, observation_id long, content string")
    found = spark.createDataFrame([(1, 1, 0, 5, 9), (1, 2, 1, 5, 9), (1, 3, 1, 5, 9), (1, 2, 1, 20, 24)], "d long, observation_id long, passage_no int, start_char int, end_char int")
    located, dropped = evidence.locate_observations(obs, found, ["d"])
    assert values(located, "observation_id", "start_char") == [(1, 5), (2, 20), (3, 5)] and dropped.count() == 0
    located, dropped = evidence.locate_observations(obs, found.filter("start_char = 5"), ["d"])
    assert values(dropped, "observation_id", "reason") == [(2, "duplicate locations")]
    rows = spark.createDataFrame([(1,), (2,), (3,), (4,)], "i long")
    verdicts = spark.createDataFrame([(1, "valid", "none"), (2, "valid", "tone"), (3, "invalid", "tone"), (3, "invalid", "tone")], "i long, verdict string, issue string")
    assert values(evidence.apply_verdicts(rows, verdicts, "i"), "i", "verdict", "issue") == [(1, "valid", "none"), (2, "uncertain", "unavailable"), (3, "uncertain", "unavailable"), (4, "uncertain", "unavailable")]


def test_appearance(spark):
    row = "entity string, chapter string, sequence int, ord int, attribute string, description string, scope string, presence string"
    rows = spark.createDataFrame(
        [
            ("bell", "1", 1, 1, "material", "Bronze", "intrinsic", "visible"),
            ("bell", "1", 2, 2, "material", "bronze", "intrinsic", "mentioned"),
            ("bell", "1", 2, 3, "fog", "thin", "scene", "visible"),
            ("bell", "2", 1, 4, "fog", "thin", "scene", "visible"),
            ("bell", "2", 1, 5, "fog", "thick", "scene", "visible"),
            ("gate", "1", 1, 6, "material", "iron", "intrinsic", "visible"),
            ("gate", "1", 2, 7, "material", "oak", "intrinsic", "visible"),
            ("gate", "1", 3, 8, "material", "oak", "intrinsic", "offscreen"),
        ],
        row,
    )
    common, state, local = timeline.compile_appearance(rows)
    assert values(common, "entity", "attribute", "description") == [("bell", "material", "Bronze")]
    assert values(state.filter("size(excluded_attributes) > 0"), "entity", "chapter", "sequence") == [("bell", "2", 1)]
    at = values(timeline.traits_at(common, state, local), "entity", "chapter", "sequence", "attribute", "description")
    assert at == sorted([("bell", "1", 1, "material", "Bronze"), ("bell", "1", 2, "material", "Bronze"), ("bell", "1", 2, "fog", "thin"), ("bell", "2", 1, "material", "Bronze"), ("gate", "1", 1, "material", "iron"), ("gate", "1", 2, "material", "oak")], key=str)
    variants = values(timeline.variants(timeline.traits_at(common, state, local), state, common), "entity", "n_scenes")
    assert variants == [("bell", 1), ("bell", 2), ("gate", 1), ("gate", 1)]


def ledger_rows(spark, many):
    ups = spark.createDataFrame([(1, s, 1, f"the entity {s}", "a", f"f{s}") for s in range(1, many + 1)] + [(2, 1, 1, "The Gate", "a", "x"), (2, 2, 1, "gate", "b", "y"), (2, 3, 1, "hall", "a", "z")], "chapter long, sequence int, update_no int, entity string, aspect string, fact string")
    resets = spark.createDataFrame([(1, s, False) for s in range(1, many + 1)] + [(2, 1, False), (2, 2, False), (2, 3, True), (2, 4, False)], "chapter long, sequence int, reset boolean")
    return ups, resets


def test_ledger(spark):
    facts = timeline.fact_ledger(*ledger_rows(spark, 30))
    last = facts.filter("chapter = 1 AND sequence = 30")
    assert last.count() == 24 and last.agg(F.min("from_sequence")).first()[0] == 7
    assert values(facts.filter("chapter = 2"), "sequence", "fact") == [(1, "x"), (2, "y"), (3, "z"), (4, "z")]
    free = timeline.unbounded_facts(*ledger_rows(spark, 3))
    assert values(free.filter("chapter = 2"), "fact", "until_sequence") == [("x", 2), ("y", 3), ("z", None)]


@pytest.mark.parametrize("most,parts", [(1, 5), (3, 7), (3, 1), (8, 12)])
def test_ledger_in_ranges_equals_the_fold(spark, most, parts):
    """One chapter lies in many ranges: resets, retirements and overflows across their borders."""
    import random

    pick = random.Random(most * parts)
    steps = {(c, s): (pick.random() < 0.08, [(k, f"the e{pick.randint(0, 12)}", "a", f"f{c}.{s}.{k}") for k in range(pick.choice([0, 1, 1, 2, 4]))]) for c, n in ((1, 3), (2, 150), (3, 1), (4, 40)) for s in range(1, n + 1)}
    ups = spark.createDataFrame([(c, s, *u) for (c, s), (_, us) in steps.items() for u in us], "chapter long, sequence int, update_no int, entity string, aspect string, fact string")
    resets = spark.createDataFrame([(c, s, r) for (c, s), (r, _) in steps.items()], "chapter long, sequence int, reset boolean")
    want, facts, at = [], [], None
    for (c, s), (reset, us) in sorted(steps.items()):
        facts = timeline.advance(facts if c == at else [], s, reset, [{"key": e, "fact": f} for _, e, _, f in us], most)
        at = c
        want += [(c, s, f["fact"], f["sequence"]) for f in facts]
    out = timeline.fact_ledger(ups, resets, most=most, parts=parts)
    assert values(out, "chapter", "sequence", "fact", "from_sequence") == sorted(want, key=str)


@pytest.mark.parametrize("parts", [1, 6])
def test_ends_of_the_ledger_without_the_rest(spark, parts):
    """The digests are those of the whole ledger; a chapter whose last sequences leave no facts ends before them; few rows come out."""
    steps = [(c, s, s % 9 == 0 or s > 38) for c in (1, 2, 3) for s in range(1, 41)] + [(4, 1, True)]
    ups = spark.createDataFrame([(c, s, 1, f"e{s % 4}", "a", f"f{s}") for c, s, _ in steps if s < 39 and c < 4], "chapter long, sequence int, update_no int, entity string, aspect string, fact string")
    resets = spark.createDataFrame(steps, "chapter long, sequence int, reset boolean")
    whole, ends = timeline.fact_ledger(ups, resets, parts=parts), timeline.fact_ledger(ups, resets, parts=parts, last=True)
    assert values(timeline.ledger_digest(ends), "chapter", "digest") == values(timeline.ledger_digest(whole), "chapter", "digest")
    assert values(ends.groupBy("chapter").agg(F.max("sequence").alias("s")), "chapter", "s") == [(1, 38), (2, 38), (3, 38)]
    assert ends.count() <= 3 * 4 * parts


def test_streaming_ledger_equals_the_batch(spark, tmp_path):
    from corpusledger.streaming import jobs

    ups, resets = ledger_rows(spark, 30)
    grouped = ups.groupBy("chapter", "sequence").agg(F.transform(F.array_sort(F.collect_list(F.struct("update_no", "entity", "aspect", "fact"))), lambda u: F.struct(u["entity"].alias("entity"), u["aspect"].alias("aspect"), u["fact"].alias("fact"))).alias("updates"))
    rows = resets.join(grouped, ["chapter", "sequence"], "left")
    late = rows.filter("sequence % 3 = 0").coalesce(1)
    late.write.parquet(f"{tmp_path}/in/a")
    rows.filter("sequence % 3 <> 0").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    late.write.parquet(f"{tmp_path}/in/c")  # arrives twice
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = jobs.stream_ledger(stream).writeStream.format("memory").queryName("ledger").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(240)
    columns = ["chapter", "sequence", "entity", "aspect", "fact", "from_sequence"]
    out = spark.table("ledger")
    assert values(out.filter("n_held IS NULL"), *columns) == values(timeline.fact_ledger(ups, resets), *columns)
    waiting = out.filter("n_held IS NOT NULL AND fact IS NULL")
    assert values(waiting, "chapter", "sequence", "n_held") == [(1, 1, 10), (2, 1, 1)]


def test_ledger_notes_and_expiry(spark, tmp_path):
    from corpusledger.streaming import jobs

    given = [(1, None, False, None), (1, 3, False, [("gate", "a", "x")]), (2, 1, False, [("hall", "a", "y")])]
    spark.createDataFrame(given, jobs.LEDGER_IN).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    stream = spark.readStream.schema(jobs.LEDGER_IN).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")

    def run(trigger, check):
        q = jobs.stream_ledger(stream, idle_ms=1).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(**trigger).start()
        for _ in range(60):
            q.awaitTermination(2)
            q.exception()
            if not q.isActive or check():
                break
        q.stop()

    run({"availableNow": True}, lambda: False)
    read = lambda: values(spark.read.parquet(f"{tmp_path}/out").filter("note IS NOT NULL"), "chapter", "note", "n_held")
    assert ("no_sequence" in {n for _, n, _ in read()}) and (1, "waiting", 1) in read()
    run({"processingTime": "1 second"}, lambda: {(1, "expired", 1), (2, "expired", 0)} <= set(read()))
    assert {(1, "expired", 1), (2, "expired", 0)} <= set(read())


def test_incremental_ingest(spark, tmp_path):
    from corpusledger.streaming import jobs

    schema = "chapter_id string, text_sha256 string, changed int"

    def put(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        q = jobs.ingest(stream, f"{tmp_path}/table", f"{tmp_path}/cp", order="changed")
        q.awaitTermination(120)
        return q

    table = lambda: values(spark.read.parquet(f"{tmp_path}/table"), "chapter_id", "version", "text_sha256", "batch_no")
    put("a", [("x", "A", 1), ("y", "A", 1), ("x", "A", 2)])
    run()
    put("b", [("x", "B", 3), ("y", "A", 3)])
    run()
    put("c", [("x", "A", 4), ("z", None, 1), ("z", "C", 3), ("z", "B", 2), (None, "A", 1)])
    q = run()
    want = [("x", 1, "A", 0), ("x", 2, "B", 1), ("x", 3, "A", 2), ("y", 1, "A", 0), ("z", 1, None, 2), ("z", 2, "B", 2), ("z", 3, "C", 2), (None, 1, "A", 2)]
    assert sorted(table(), key=str) == sorted(want, key=str)
    assert f"{tmp_path}/table" not in str(q.lastProgress["sources"])  # what was seen is state, not read back
    # the last batch runs again: its commit is lost, its offsets are not
    import glob
    import os

    for f in glob.glob(f"{tmp_path}/cp/commits/2") + glob.glob(f"{tmp_path}/cp/commits/.2.crc"):
        os.remove(f)
    run()
    assert sorted(table(), key=str) == sorted(want, key=str)


def test_few_pairs_of_names_are_scored(spark):
    """All pairs of a block by difflib against those whose bound passes."""
    import difflib
    import random

    pick = random.Random(4)
    syllables = "al ba cor den el fin gar hol is jo ka lum mor nen os pel qui ran sol tur".split()
    name = lambda: "".join(pick.choices(syllables, k=pick.randint(1, 4))).title()
    names = [f"{pick.choice(['Sir', '', '', 'Lady'])} {name()} {name()}" for _ in range(300)]
    names += [n[:-1] + pick.choice("xyz") for n in names[:60]] + ["Sir Zoë Œuvre", "Sir Zoë Œuvr", "Sir", "Sir Sir Sir", "Ünal Ünal", "Ünal Ünel"]
    e = spark.createDataFrame([(i, "k", n) for i, n in enumerate(names)], "i long, kind string, name string")
    keys = sorted({r[0] for r in e.select(T.name_key(F.col("name"))).collect()})
    blocks_of = lambda n: {n[:3]} | {f"t:{t}" for t in n.split() if len(t) >= 3}
    every = [(x, y) for k, x in enumerate(keys) for y in keys[k + 1 :] if {f"p:{x[:3]}"} & {f"p:{y[:3]}"} or (blocks_of(x) & blocks_of(y))]
    want = {}
    for x, y in every:
        a, b = set(x.split()), set(y.split())
        score = max(len(a & b) / len(a | b), difflib.SequenceMatcher(None, x, y).ratio())
        if score >= identity.THRESHOLD:
            want[x, y] = round(score, 9)
    pairs = identity.name_pairs(e, "i", "kind", "name")
    out = identity.similar_pairs(e, "i", "kind", "name")
    assert {(r["x"], r["y"]): round(r["score"], 9) for r in out.collect()} == want and len(want) > 50
    assert pairs.count() * 10 < len(every)
    flat = {(r["x"], r["y"]) for r in identity.similar_pairs(e, "i", "kind", "name", ratio=False).collect()}
    assert flat == {(x, y) for x, y in every if len(set(x.split()) & set(y.split())) / len(set(x.split()) | set(y.split())) >= identity.THRESHOLD}


def test_identity(spark):
    e = spark.createDataFrame([(1, "character", "Lady Alice", ["Alice"]), (2, "character", "Alice", []), (3, "location", "Alice", []), (4, "character", "Bernard", None), (5, "character", "", [])], "i long, kind string, name string, aliases array<string>")
    parts = identity.components(identity.name_links(e, "i", "kind", "name", aliases_col="aliases"), id_col="i")
    assert values(identity.clusters(parts, "i"), "component", "i") == [(1, 1), (1, 2)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r["component"] for r in identity.components(chain).collect()} == {0, 100}
    groups = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3), (3, 1), (3, 99)], "group_no long, i long")
    mapping, refused = identity.apply_merges(e, groups, "i", "kind")
    assert values(mapping, "i", "kept_id") == [(1, 1), (2, 1)] and values(refused, "group_no") == [(2,)]
    d = spark.createDataFrame([("k", 1, "a", "b", "same"), ("k", 2, "b", "c", "same"), ("k", 3, "a", "c", "different"), ("k", 4, "c", "d", "same")], "k string, `order` int, a string, b string, relation string")
    assert values(identity.constrained_merge(d, ["k"]), "id", "component") == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")]
    names = spark.createDataFrame([("g", "Mara"), ("g", "Mara Voss"), ("g", "the Heron")], "g string, name string")
    contexts = spark.createDataFrame([("g", "Mara Voss was called the Heron, then left."), ("g", "Mara saw it.")], "g string, context string")
    assert values(identity.alias_edges(names, contexts, ["g"]), "x", "y") == sorted([("Mara", "Mara Voss"), ("Mara", "the Heron"), ("Mara Voss", "the Heron")], key=str)
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "a long, b long")
    assert values(identity.seeded_reach(edges, spark.createDataFrame([(1,)], "id long")), "id", "steps") == [(1, 0), (2, 1), (3, 2)]


def test_budget(spark):
    rows = [("s", "hall", True, 3, 9, v) for v in range(2)] + [("s", "mara", False, 1, 1, v) for v in range(3)] + [("s", "bern", False, 2, 2, v) for v in range(3)] + [("s", "dog", False, 3, 3, 0)]
    c = spark.createDataFrame(rows, "scene string, subject string, is_location boolean, prominence int, ord int, level int")
    out = values(assets.budgeted_slots(c, ["scene"], 5, 3), "subject", "level")
    assert out == [("bern", 0), ("dog", 0), ("hall", 0), ("mara", 0), ("mara", 1)]
    gaps = assets.coverage_gaps(c.select("scene", "subject").distinct(), c.filter("subject <> 'dog'").select("subject"), assets.budgeted_slots(c, ["scene"], 2, 1), ["scene"])
    assert values(gaps, "subject", "reason") == [("bern", "budget exhausted"), ("dog", "no image")]


def test_quality(spark):
    with pytest.raises(ValueError, match="duplicate_key"):
        quality.strict(quality.duplicate_keys(spark.createDataFrame([(1,), (1,)], "i int"), ["i"]))
    quality.strict(quality.duplicate_keys(spark.createDataFrame([], "i int"), ["i"]))
    rows = spark.createDataFrame([(1, '{"k": 1, "n": "x"}'), (2, '{"k": true}'), (3, '{"n": 5, "z": 0}')], "i int, t string").withColumn("v", F.try_parse_json("t"))
    assert values(quality.json_rules(rows, "i", "v", {"k": "BIGINT"}, {"n": "STRING"}), "i", "rule", "detail") == [(2, "wrong_type", "k"), (3, "missing_field", "k"), (3, "unknown_field", "z"), (3, "wrong_type", "n")]
    text = "Shot 1: <Picture 1>\nShot 2: At 00:03.000, hall\nShot 3: At 00:09.500, end"
    lint = quality.lint(spark.createDataFrame([(1, text, ["<Picture 1>"])], "i int, t string, b array<string>"), "i", "t", "b", 12.0, 3)
    assert lint.count() == 0


def test_decisions(spark):
    d = spark.createDataFrame([(1, "a", None), (2, "a", ""), (3, "b", "x")], "i int, p string, q string")
    prints = decisions.fingerprints(d, ["p", "q"], "v1")
    assert prints.select("fingerprint").distinct().count() == 3
    old = prints.filter("i = 3").select("fingerprint", F.lit("yes").alias("result"))
    decided, left = decisions.reuse(prints.select("i", "fingerprint"), [old])
    assert values(decided, "i", "result") == [(3, "yes")] and values(left, "i") == [(1,), (2,)]
    b = spark.createDataFrame([("s", "completed", 0), ("s", "failed", 0), ("t", "completed", 0), ("u", "completed", 1)], "k string, status string, issues int")
    assert values(decisions.approval(b, ["k"]), "k", "approved") == [("s", False), ("t", True), ("u", False)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "chapter10.txt").write_bytes("\ufeffTen\r\nlines".encode())
    (tmp_path / "chapter2.MD").write_bytes("Two".encode())
    (tmp_path / "blank.txt").write_bytes(b" \n")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "x.pdf").write_bytes(b"pdf")
    (tmp_path / "note.doc").write_bytes(b"no")
    files = sources.scan_chapters(spark, [str(tmp_path)])
    kept, rejects = sources.read_chapters(files)
    assert values(kept, "ord", "chapter_id", "text") == [(1, "chapter2", "Two"), (2, "chapter10", "Ten\nlines")]
    assert sorted(r["reason"] for r in rejects.collect()) == ["blank", "unreadable", "unreadable"]
    kept, _ = sources.read_chapters(files, lambda data: data.decode().upper())
    assert kept.count() == 3
    assert sources.length_gate(kept)[1].count() == 3
    from pyspark.sql import types as S

    (tmp_path / "a.json").write_text('{"schema_version": "v2", "name": "x"}')
    (tmp_path / "b.json").write_text('{"schema_version": "v1", "name": "y"}')
    (tmp_path / "c.json").write_text("{broken")
    schema = S.StructType([S.StructField("schema_version", S.StringType()), S.StructField("name", S.StringType())])
    docs, bad = sources.scan_documents(spark, str(tmp_path), schema, "v2")
    assert values(docs, "name", "source_file") == [("x", "a.json")] and sorted(r["reason"] for r in bad.collect()) == ["broken", "version"]
    rows = spark.createDataFrame([("c", 1, "m", "t1"), ("c", 2, "m", "t2"), ("c", 3, "n", "t3")], "c string, i int, e string, t string")
    block = export.with_headers(rows, ["c"], "e", ["i"], F.col("t"), F.concat(F.lit("# "), F.col("e"))).first()["block"]
    assert block == "# m\nt1\nt2\n# n\nt3"
    assert export.manifest(rows, "c", ["t"]).first()["n_scenes"] == 3


def test_every_query_has_a_name_and_most_have_sql():
    assert registry.FLAGSHIP in registry.QUERIES and set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert len(registry.ORACLE_SQL) > 80


def test_reviews(spark):
    from corpusledger.operators import reviews

    payload = '{"scene": {"mood": "calm", "list": [1, 2]}}'
    issues = spark.createDataFrame([(1, "/scene/mood", "d", payload), (2, "/scene/mood", "d", payload), (3, "/scene/none", "d", payload), (4, "/other", "d", payload)], "issue_id int, path string, description string, t string").withColumn("v", F.try_parse_json("t"))
    kept, bad = reviews.review_violations(issues, "v", ["/scene/mood", "/scene/none"])
    assert values(kept, "issue_id", "cited_value") == [(1, "calm")] and values(bad, "rule", "key") == [("path_not_found", "3"), ("path_not_offered", "4")]
    plan = spark.createDataFrame([("c", 1, 1), ("c", 3, 2), ("c", 2, 3)], "chapter string, sequence int, ord int")
    sequences = spark.createDataFrame([("c", 1), ("c", 2), ("c", 3), ("c", 4)], "chapter string, sequence int")
    placed = spark.createDataFrame([("c", 1, "x", "object", "explicit", 2), ("c", 2, "y", "object", "inferred", 4)], "chapter string, sequence int, entity string, kind string, evidence string, source_sequence int")
    registry_ = spark.createDataFrame([("x", "object"), ("y", "location")], "entity string, kind string")
    found = values(reviews.spatial_violations(plan, sequences, placed, registry_), "rule", "key")
    assert found == [("future_evidence", "c/1"), ("missing", "c/4"), ("order", "c/2"), ("unknown_entity", "c/2")]


def test_reconcile(spark):
    from corpusledger.operators import catalogs

    columns = "kind string, names array<string>, importance string, priority string, speaks boolean"
    known = spark.createDataFrame([("CHAR_002", 2, "character", ["Mara"], "minor", "optional", False)], f"entity string, number long, {columns}")
    incoming = spark.createDataFrame([("a", 1, "character", ["mara", "Mara Voss"], "major", "optional", True), ("b", 2, "character", ["Bern"], "minor", "required", False), ("c", 3, "location", ["Hall"], "minor", "optional", False)], f"local_id string, ord int, {columns}")
    decisions_ = spark.createDataFrame([("a", "CHAR_002"), ("b", "NEW"), ("c", "CHAR_002")], "local_id string, match string")
    out, members = catalogs.reconcile(known, incoming, decisions_, ["ord"])
    assert values(out, "entity", "number", F.array_join("names", "|"), "importance", "speaks") == [("CHAR_002", 2, "Mara|Mara Voss", "major", True), ("CHAR_003", 3, "Bern", "minor", False), ("LOCA_001", 1, "Hall", "minor", False)]
    assert values(members, "local_id", "entity") == [("a", "CHAR_002"), ("b", "CHAR_003"), ("c", "LOCA_001")]


def test_downstream_chapters(spark):
    schema = "c int, sequences array<struct<n:int,review:struct<a:int>>>, narrative_review struct<issues:array<struct<code:string,proposals:array<struct<o:int,review:string>>>>,attempts:int>, review string"
    given = [(1, [(1, (5,)), (2, None)], ([("x", [(1, "r"), (2, None)]), ("y", None)], 3), "kept"), (2, None, None, None), (3, [], (None, 1), None)]
    out = export.downstream_chapters(spark.createDataFrame(given, schema)).orderBy("c")
    assert out.schema.simpleString() == "struct<c:int,sequences:array<struct<n:int>>,narrative_review:struct<issues:array<struct<code:string,proposals:array<struct<o:int>>>>>,review:string>"
    rows = [r.asDict(True) for r in out.collect()]
    assert rows[0] == {"c": 1, "sequences": [{"n": 1}, {"n": 2}], "narrative_review": {"issues": [{"code": "x", "proposals": [{"o": 1}, {"o": 2}]}, {"code": "y", "proposals": None}]}, "review": "kept"}
    assert rows[1] == {"c": 2, "sequences": None, "narrative_review": None, "review": None} and rows[2] == {"c": 3, "sequences": [], "narrative_review": {"issues": []}, "review": None}


def test_open_rows_are_asked_in_halves(spark):
    """Two rows spoil every batch that holds them; batches of 8, 4, 2 and 1 leave only these undecided."""
    sizes = spark.sparkContext.accumulator(0)

    def answer(pdf):
        sizes.add(1)
        return (pdf if not pdf["id"].isin([3, 12]).any() else pdf.iloc[:0])[["id"]].assign(result="ok")

    rows = spark.createDataFrame([(i,) for i in range(16)], "id long")
    out = decisions.decide_with_retries(rows, "id", answer, "id long, result string", F.lit(True), 4, F.lit("none"), 1, batch_rows=8)
    found = {r["id"]: (r["result"], r["attempt"], r["status"]) for r in out.collect()}
    assert {i for i, f in found.items() if f[2] == "default"} == {3, 12} and {found[i][1] for i in (0, 1)} == {3} and found[2][1] == 4 and {found[i][1] for i in (4, 5, 6, 7)} == {2}


def test_answers_to_small_batches_leave_together(spark):
    """A batch of a row is answered by itself, but not handed on by itself; frames and Arrow batches alike."""
    given = pd.DataFrame({"id": range(2_500)})
    sizes = []
    out = list(decisions.in_batches(lambda b: (sizes.append(len(b)), b)[1], 1)(iter([given[:7], given[7:]])))
    assert set(sizes) == {1} and [len(b) for b in out] == [1_000, 1_000, 500] and pd.concat(out)["id"].tolist() == given["id"].tolist()
    arrow = [pa.RecordBatch.from_pandas(given[a:b], preserve_index=False) for a, b in ((0, 5), (5, 2_500))]
    out = list(decisions.in_batches(lambda b: b.slice(0, 0) if b["id"][0].as_py() == 4 else b, 4, decisions.ARROW)(iter(arrow)))
    assert [i for b in out for i in b["id"].to_pylist()] == [i for i in range(2_500) if i not in range(4, 8)]
    with pytest.raises(ValueError):
        decisions.decide_with_retries(spark.range(3), "id", None, "id long", F.lit(True), 2, F.lit("none"), None, arrow=True)


@pytest.mark.parametrize("hot", [0, 4, 1000])
def test_candidates_without_joins_of_hot_words(spark, hot, monkeypatch):
    """Every score by brute force against words that join no names: none, some and all of them."""
    import random

    pick = random.Random(hot)
    words = ["sir", "sir", "sir", "the", "the", "al", "bo", "cy", "di", "ed", "flo", "gus"]
    name = lambda: " ".join(pick.choices(words, k=pick.randint(1, 4)))
    pool = [(i, pick.choice("kkkkp"), name()) for i in range(220)] + [(300, "k", ""), (301, "small", "sir al"), (302, "small", "x"), (303, "k", None)]
    asked = [(i, pick.choice("kkp"), name()) for i in range(40)] + [(100, "k", ""), (101, "k", "nobody"), (102, "small", "sir"), (103, "none", "sir")]
    want = []
    for i, kind, n in asked:
        mine, rows = set((n or "").split(" ")), []
        for p, k, m in pool:
            if k == kind and m is not None:
                theirs = set(m.split(" "))
                rows.append((-len(mine & theirs) / len(mine | theirs), p))
        rows.sort()
        good = [r for r in rows if -r[0] >= identity.FLOOR]
        kept = rows if len(rows) <= identity.WHOLE_POOL else good[: identity.MOST_CANDIDATES] or rows[: identity.FALLBACK]
        want += [(i, p, round(-s, 9), k) for k, (s, p) in enumerate(kept, 1)]
    monkeypatch.setattr(identity, "HOT_NAMES", hot)
    left = spark.createDataFrame(asked, "in_id long, kind string, in_name string")
    right = spark.createDataFrame([p for p in pool if p[2] is not None], "pool_id long, kind string, pool_name string")
    out = identity.top_candidates(left, right)
    assert sorted((r["in_id"], r["pool_id"], round(r["score"], 9), r["place"]) for r in out.collect()) == sorted(want)


def test_marked_words_are_those_of_the_places():
    import random

    from corpusledger.functions.udfs import words_in

    pick = random.Random(3)
    bits = ["Mara", "l'Ombre", "d’eau", "porte-voix", "x1", "_a", "the", " ", "  ", "\n", ". ", "! ", "«", "—", "-", "’", " " * 63, " " * 64, "É", "ß", "7"]
    texts = [None, "", "Mara", " Mara", ".Mara", *("".join(pick.choice(bits) for _ in range(pick.randint(1, 40))) for _ in range(400))]
    for text in texts:
        want = {evidence.uses(word, before) for _, _, word, before in words_in(text)}
        assert {evidence.uses(word, before) for word, before in evidence.marked_words(text)} == want


def test_texts_are_unpacked_by_portions(spark):
    import pyarrow as pa

    held = []
    assert udfs.by_portions(pa.array(["É", None, "e\u0301"] * 100), lambda t: held.append(t) or t.casefold()).to_pylist() == ["é", None, "e\u0301"] * 100
    assert udfs.by_portions(pa.array([], pa.string()), str).to_pylist() == [] and len(held) == 200
    rows = spark.createDataFrame([("Straße É",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(udfs.plain("t").alias("p")).collect()] == ["Straße E", None, ""]
    assert {u.func.__annotations__["text"] for u in (udfs.nfc, udfs.fold, udfs.plain, udfs.normalized_json)} == {"pa.Array"}
