"""Alignment of tokenizers against plain Python over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from corpusledger.llm import alignment

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a", " a", "a ", " ", "  a  b ", "\n", "a\n b", "a \nb", "\u2581x", "x \u2581 y", "\ufb01 \xbd \uff46 \xe9 e\u0301\n\tx", "日本語 😀👍🏽 ñ", "a\x00b\r\nc",
       "<s> </s> <|endoftext|> <0x41>", "don't I'll", "a\u00a0 b \u3000 c", "\x1c a \x1d b", "'s 's", "1 2  3\t4"]


def plain(text):
    """(ids of A, ids of B, groups as text, links) by the libraries over the whole text and decoded bytes; None if not alignable."""
    own = alignment.pair(*PATHS)
    if not text:
        return None
    a, b = own.a.encode(f" {text}", add_special_tokens=False).ids, own.b.encode(text)
    parts = [own.bytes_a[i] for i in a], [own.bytes_b[i] for i in b]
    if any(b"".join(p) != f" {text}".encode() for p in parts):
        return None
    ends_a, ends_b = (np.cumsum([len(x) for x in p]).tolist() for p in parts)
    links, i, j, groups, at = [], 0, 0, [], (0, 0)
    while i < len(a):
        links.append((a[i], b[j]))
        x, y = ends_a[i], ends_b[j]
        i, j = i + (x <= y), j + (y <= x)
        if x == y:
            groups.append(f"{','.join(map(str, a[at[0] : i]))}|{','.join(map(str, b[at[1] : j]))}")
            at = i, j
    return a, b, ";".join(groups), links


def wanted(given):
    found = [(doc, plain(text)) for doc, text in given]
    counts = Counter(pair for _, f in found if f for pair in f[3])
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for doc, f in found:
        if f is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, links = f
            sums = sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links)
            out.append((doc, len(a), len(b), groups.count(";") + 1, len(links), *sums, hashlib.sha256(groups.encode()).hexdigest()))
    return out


def texts():
    pick = random.Random(5)
    letters = "ab 's\n\t 12.!é日😀\u00a0\u3000\u0301\u2581 \x85\x1cĀ"
    made = ["".join(pick.choice(letters) for _ in range(pick.randint(1, 14))) for _ in range(300)]
    return [*ODD, *made, "the end of " * 3000, "x" * 5000, None, ""]


@pytest.mark.parametrize("large", [alignment.LARGE, 300, 0])
def test_alignment(spark, large, monkeypatch):
    """Also where few pairs, or none, travel to all tasks and the others are joined."""
    monkeypatch.setattr(alignment, "LARGE", large)
    given = list(enumerate(texts())) + [(3, "again and again"), (3, "again and again"), (None, "no id")]
    docs = spark.createDataFrame([(*g, 1, "p") for g in given], "doc_id long, text string, _row int, a string")
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(alignment.align(docs, *PATHS).collect()) == order(wanted(given))
    empty = alignment.align(docs.filter("false"), *PATHS)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_counts_and_spans(spark):
    given = [(i, t) for i, t in enumerate(ODD)] + [(90, None)]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    counts = Counter(p for _, t in given if (f := plain(t)) for p in f[3])
    assert {(r["a"], r["b"]): r["links"] for r in alignment.pair_counts(alignment.encoded(docs, *PATHS)).collect()} == dict(counts)
    own = alignment.pair(*PATHS)
    for r in alignment.spans(docs, *PATHS).collect():
        text = dict(given)[r["doc_id"]]
        raw = f" {text}".encode()
        if plain(text) is None:
            assert r["groups"] == []
            continue
        assert [g["start"] for g in r["groups"]] == [0, *[g["end"] for g in r["groups"]][:-1]] and r["groups"][-1]["end"] == len(raw)
        for g in r["groups"]:
            assert b"".join(own.bytes_a[i] for i in g["a"]) == b"".join(own.bytes_b[i] for i in g["b"]) == raw[g["start"] : g["end"]]


def test_offsets_are_refined():
    """Characters cut into several tokens, byte-fallback tokens and the space put before the text."""
    ids_a, ends_a, ids_b, ends_b = alignment.pair(*PATHS).encode(" ｆ😀é\n")
    own = alignment.pair(*PATHS)
    assert ends_a.tolist() == np.cumsum(own.lengths_a[ids_a]).tolist() and ends_b.tolist() == np.cumsum(own.lengths_b[ids_b]).tolist()
    assert len(ids_a) > 4 and any(own.b.is_byte(int(i)) for i in ids_b)


def test_memory_is_emptied(monkeypatch):
    own = alignment.Stretches(alignment.pair(*PATHS))
    monkeypatch.setattr(alignment, "MOST_KNOWN", 3)
    assert not own.full() and len(own.numbered(["a b c d e"])[0]) == 5 and own.full()
    assert own.numbered(["x a", None, "\u2581 a", "a"]) == [[0, 1], [], [], [1]] and len(own.numbers) == 3


def test_pairs_are_packed():
    for codes, times in (([], []), ([5, 1 << 32 | 3, 70_000 << 32 | 31_999, 70_000 << 32 | 32_000], [1, 300, 70_000, 2])):
        found = alignment.unpacked(alignment.packed(np.array(codes, np.int64), np.array(times, np.int64)))
        assert found[0].tolist() == codes and found[1].tolist() == times
