"""Decontamination against plain Python, and the plans that it may not have."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusledger.llm import decontamination as deco


def words(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[s : s + size])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if (at := tuple(w[s : s + n])) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[at]
        listed = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def case(seed=1, n=60):
    pick = random.Random(seed)
    vocabulary = [*"abcdefgh", "É", "é", "x1", "日本"]
    line = lambda k: " ".join(pick.choices(vocabulary, [9, 6, 4, 3, 2, 1, 1, 1, 1, 1, 1, 1], k=k))
    items = [(i, line(pick.choice([1, 3, 9, 10, 11, 30]))) for i in range(25)] + [(10, "solo"), (11, None), (12, ""), (13, "!?"), (3, "again " * 12), (3, "again " * 12), (None, "never named " * 6), (30, "again " * 14)]
    docs = [(i, line(pick.randint(0, 80)) + " " + (pick.choice(items)[1] or "") + "-" + line(5)) for i in range(n)]
    docs += [(100, None), (101, ""), (102, "SOLO Again. again"), (103, "again " * 9000), (104, "never named " * 7), (5, docs[5][1]), (5, docs[5][1]), (6, "another text a b"), (None, docs[7][1])]
    return docs, items


@pytest.mark.parametrize("lists", [1, 2, 4])
def test_decontaminate(spark, lists, monkeypatch):
    monkeypatch.setattr(deco.phrase_places, "__defaults__", (lists,))
    docs, items = case()
    given = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id long, text string, _word string, _pos int, _h int")
    tests = spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, _phrase int")
    out = deco.decontaminate(given, tests)
    assert sorted(map(tuple, out.collect()), key=str) == brute(docs, items)
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", out._jdf.queryExecution().toString())


def test_empty_tables(spark):
    docs, items = case(n=8)
    given, tests = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert deco.decontaminate(given.filter("false"), tests).count() == 0
    assert sorted(map(tuple, deco.decontaminate(given, tests.filter("false")).collect()), key=str) == brute(docs, [])


def test_large_test_sets_are_shuffled(spark, monkeypatch):
    """Beyond FEW phrases nothing is broadcast by hand; the result is the same."""
    monkeypatch.setattr(deco, "FEW", 0)
    docs, items = case(2, 30)
    out = deco.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, out.collect()), key=str) == brute(docs, items)


def test_index_and_places(spark):
    given = deco.keyed(spark.createDataFrame([(1, "To be or not TO be"), (2, "be quick")], "doc_id long, text string"), "doc_id", "text")
    index = deco.build_index(given)
    assert sorted((r["_word"], r["_id"], r["_pos"]) for r in index.collect()) == [("be", 1, 1), ("be", 1, 5), ("be", 2, 0), ("not", 1, 3), ("or", 1, 2), ("quick", 2, 1), ("to", 1, 0), ("to", 1, 4)]
    phrases = spark.createDataFrame([("a", ["to", "be"]), ("b", ["be"]), ("c", ["be", "to"]), ("d", [])], "_phrase string, _words array<string>")
    found = {(r["_id"], r["_phrase"], r["_start"], r["_n"]) for r in deco.phrase_places(given, phrases).collect()}
    assert found == {(1, "a", 0, 2), (1, "a", 4, 2), (1, "b", 1, 1), (1, "b", 5, 1), (2, "b", 0, 1)}


def test_rarest_words_seed(spark):
    found = spark.createDataFrame([("p", ["a", "b", "c", "b"])], "_phrase string, _words array<string>")
    counts = spark.createDataFrame([("a", 5), ("b", 2), ("c", 2)], "_word string, _count long")
    assert [tuple(r) for r in deco.seeds(found, counts, 2).orderBy("_rank").collect()] == [("p", 1, "b", 1), ("p", 2, "c", 2)]


@pytest.mark.parametrize("span", [2, 4, 7])
def test_near_places(spark, span):
    pick = random.Random(span)
    docs = [(i, " ".join(pick.choices("abcdefg", k=40))) for i in range(12)] + [(50, None), (51, "a")]
    phrases = [("p", ["a", "b"]), ("q", ["c", "a", "c", "g"]), ("r", ["z", "a"]), ("s", ["e"])]
    want = set()
    for doc, text in docs:
        w = words(text)
        for name, terms in phrases:
            spans = [(s, e) for s in range(len(w)) for e in range(s + 1, min(len(w), s + span) + 1) if set(terms) <= set(w[s:e])]
            want |= {(doc, name, s, e) for s, e in spans if not any((a, b) != (s, e) and s <= a and b <= e for a, b in spans)}
    given = deco.keyed(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    out = deco.near_places(given, spark.createDataFrame(phrases, "_phrase string, _words array<string>"), span)
    assert {(r["_id"], r["_phrase"], r["_start"], r["_end"]) for r in out.collect()} == want and any(w[1] == "q" for w in want) == (span > 2)


def test_words_in_lower_case(spark):
    text = "ÀÉ Straße İI I\u0307 A-B ǅ\u00b5 x_y K9"
    row = spark.createDataFrame([(text,), ("ASCII Only 7",), (None,)], "t string").select(deco.words(F.col("t"))).collect()
    assert [r[0] for r in row] == [words(text), ["ascii", "only", "7"], []]
