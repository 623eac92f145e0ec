"""License scans by fuzzy search for short notices.

A notice is cut at words into parts of PART_CHARS characters at most, which must follow one another. A part allows a bounded
number of edits e. Cut into e + 1 pieces, at least one piece survives any e edits, so a text that holds the part holds a
piece unchanged. One automaton finds all pieces; around each hit a bounded-error regular expression verifies the part and
reports its span. Exact phrases are found in the same word text.
"""

from __future__ import annotations

import functools
from bisect import bisect_left, bisect_right
from itertools import accumulate

import ahocorasick
import regex
from pyspark.sql import DataFrame

from .common import map_rows, settled
from .secret_scan import lower_ascii

WORDS = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Phrase -> label. Fixed values.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Short notices as their words -> label.
NOTICES = {
    "licensed under the apache license version 2 0": "apache",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "mozilla public license version 2 0": "mpl",
    "this work is licensed under a creative commons attribution": "cc-by",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "to the extent possible under law the author has waived all copyright and related rights": "cc0",
    "this work is licensed under a creative commons attribution sharealike": "cc-by-sa",
    "boost software license version 1 0": "bsl",
    "eclipse public license version 2 0": "epl",
    "european union public licence": "eupl",
    "gnu free documentation license": "gfdl",
    "common development and distribution license": "cddl",
    "permission is granted to anyone to use this software for any purpose including commercial applications": "zlib",
}
#: One edit is allowed for every EDIT_CHARS characters of a part, MOST_EDITS at most, as the cost of verifying grows steeply with them.
EDIT_CHARS, MOST_EDITS, PART_CHARS = 12, 3, 60
#: How far the start of a part may lie from where the part before it and a space end.
SLACK = MOST_EDITS


def parts_of(notice: str) -> list[str]:
    """The notice cut at words into the fewest parts of PART_CHARS characters at most, of similar length; a longer word is a part."""
    words, most = notice.split(), -(-len(notice) // -(-len(notice) // PART_CHARS))
    parts = [words[0]]
    for word in words[1:]:
        if len(parts[-1]) + 1 + len(word) <= min(PART_CHARS, most + MOST_EDITS):
            parts[-1] += f" {word}"
        else:
            parts.append(word)
    return parts


def part_pattern(part: str) -> tuple[regex.Pattern, int]:
    """(expression, edits) of one part; of the matches at the leftmost place a better one is taken."""
    edits = min(MOST_EDITS, len(part) // EDIT_CHARS)
    return regex.compile(f"(?e)(?:{regex.escape(part, literal_spaces=True)}){{e<={edits}}}"), edits


@functools.lru_cache(1)
def compiled():
    """(automaton of pieces -> [(part number, offset)], [(pattern, length, edits)] of parts, [(part numbers, label)] of notices)"""
    pieces: dict[str, list[tuple[int, int]]] = {}
    numbers: dict[str, int] = {}
    parts, notices = [], []
    for notice, label in NOTICES.items():
        cut = parts_of(notice)
        for part in cut:
            if part not in numbers:
                numbers[part] = len(parts)
                pattern, edits = part_pattern(part)
                cuts = [round(i * len(part) / (edits + 1)) for i in range(edits + 2)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    pieces.setdefault(part[a:b], []).append((numbers[part], a))
                parts.append((pattern, len(part), edits))
        notices.append(([numbers[p] for p in cut], label))
    out = ahocorasick.Automaton()
    for piece, places in pieces.items():
        out.add_word(piece, (len(piece), places))
    out.make_automaton()
    return out, parts, notices


def chained(found: list[list[tuple[int, int, int]]]) -> list[tuple[int, int, int]]:
    """(start, end, edits) where matches of all parts follow one another; ``found``: each part's matches in order."""
    chains = found[0]
    for matches in found[1:]:
        starts, longer = [m[0] for m in matches], []
        for start, end, edits in chains:
            at = bisect_left(starts, end + 1 - SLACK)
            if at < len(starts) and starts[at] <= end + 1 + SLACK:
                longer.append((start, matches[at][1], edits + matches[at][2]))
        chains = longer
    return chains


def matches_in(pattern: regex.Pattern, line: str, begin: int, end: int) -> list[tuple[int, int, int]]:
    """(start, end, edits) of a part's matches in a stretch, leftmost first and not overlapping; a space at its start is not part of it."""
    return [(m.start() + (line[m.start()] == " "), m.end(), sum(m.fuzzy_counts)) for m in pattern.finditer(line, begin, end)]


def near_places(line: str) -> list[tuple[int, int, int, str]]:
    """(start, end, edits, label) of the notices in a line of words."""
    automaton, parts, notices = compiled()
    windows: dict[int, list[list[int]]] = {}
    for at, (n, places) in automaton.iter(line):
        for k, offset in places:
            begin, _, edits = at - n + 1 - offset, *parts[k][1:]
            windows.setdefault(k, []).append([max(0, begin - edits), min(len(line), begin + parts[k][1] + 2 * edits)])
    found: dict[int, list[tuple[int, int, int]]] = {}
    for k, spans in windows.items():
        spans.sort()
        merged = [spans[0]]
        for span in spans[1:]:
            if span[0] <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], span[1])
            else:
                merged.append(span)
        found[k] = [m for a, b in merged for m in matches_in(parts[k][0], line, a, b)]
    return [(*place, label) for cut, label in notices if all(found.get(k) for k in cut) for place in chained([found[k] for k in cut])]


def find(text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, int]]]:
    """(number of words, exact phrases as (first word, label), notices as (first word, word after, label, edits)).

    Words are counted from 0 over the whole text, with A-Z in lower case. Null and empty texts have no words.
    """
    words = WORDS.findall(lower_ascii(text or ""))
    if not words:
        return 0, [], []
    line = " ".join(words)
    padded = f" {line} "
    exact = []
    for phrase, label in PHRASES.items():
        at = padded.find(f" {phrase} ")
        while at >= 0:
            exact.append((at, label))
            at = padded.find(f" {phrase} ", at + 1)
    near = near_places(line)
    if exact or near:
        starts = list(accumulate((len(w) + 1 for w in words), initial=0))
        word = lambda at: bisect_right(starts, at) - 1
        exact, near = [(word(at), label) for at, label in exact], [(word(a), word(b) + 1, label, edits) for a, b, edits, label in near]
    return len(words), sorted(exact), sorted(near)


def score(exact: list, near: list) -> float:
    """1 with an exact phrase or notice, else 1 - edits / 20 of the best notice, 0 without any."""
    return 1.0 if exact else max((1.0 - n[3] / 20 for n in near), default=0.0)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every phrase and notice of every whole text: id, n_words, licenses (array of struct first_word, end_word, label, edits).

    Null and empty texts have an empty list; an empty table gives an empty one. Repeated rows give repeated rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    lengths = {label: len(p.split()) for p, label in PHRASES.items()}

    def make():
        def work(columns):
            found = [find(t) for t in columns[text_col]]
            rows = [sorted([(w, w + lengths[label], label, 0) for w, label in exact] + near) for _, exact, near in found]
            return [columns[id_col], [n for n, _, _ in found], [[dict(zip(("first_word", "end_word", "label", "edits"), r, strict=True)) for r in x] for x in rows]]

        return work

    return settled(map_rows(docs.select(id_col, text_col), make, f"{id_col} {kind}, n_words long, licenses array<struct<first_word:long,end_word:long,label:string,edits:int>>"), "licenses")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, places and labels of every whole text; same cases as ``scan``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def work(columns):
            out = []
            for text, doc in zip(columns[text_col], columns[id_col], strict=True):
                n, exact, near = find(text)
                base = {label for _, label in exact}
                starts = [w for w, _ in exact]
                out.append((doc, n, len(exact), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x[2] for x in near})), score(exact, near)))
            return [list(c) for c in zip(*out, strict=True)] if out else [[] for _ in range(8)]

        return work

    return settled(map_rows(docs.select(id_col, text_col), make, f"{id_col} {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"), "licenses")
