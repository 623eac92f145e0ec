"""Arrow functions for the rules that built-in expressions cannot state."""

from __future__ import annotations

import difflib
import json
import re
import unicodedata

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf, udtf


def fields(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


TEXT, WHOLE = T.StringType(), T.IntegerType()


#: Rows of a batch that are Python strings at one time. Fixed value.
PORTION = 64


def by_portions(text: pa.Array, function) -> pa.Array:
    """A function of each text, nulls apart; of a batch only a portion is unpacked at a time, however large the batch."""
    out = [pa.array([], pa.string())]
    for at in range(0, len(text), PORTION):
        out.append(pa.array([None if t is None else function(t) for t in text.slice(at, PORTION).to_pylist()], pa.string()))
    return pa.concat_arrays(out)


@arrow_udf(TEXT)
def nfc(text: pa.Array) -> pa.Array:
    """Canonical composition; ASCII texts pass as they are."""
    return by_portions(text, lambda t: t if t.isascii() else unicodedata.normalize("NFC", t))


#: Typography: one character to one character. Fixed values.
ONE_TO_ONE = ("\u2018\u2019\u201c\u201d\u00ab\u00bb\u00a0\u202f\u2028", "''\"\"\"\"  \n")
NESTED = str.maketrans(*ONE_TO_ONE) | {0x2029: "\n\n"}


def normalized_value(value):
    """A JSON value with every string normalized, keys apart."""
    if isinstance(value, str):
        return unicodedata.normalize("NFC", value.replace("\r\n", "\n").replace("\r", "\n").translate(NESTED))
    if isinstance(value, list):
        return [normalized_value(v) for v in value]
    return {k: normalized_value(v) for k, v in value.items()} if isinstance(value, dict) else value


@arrow_udf(TEXT)
def normalized_json(text: pa.Array) -> pa.Array:
    return by_portions(text, lambda t: json.dumps(normalized_value(json.loads(t)), ensure_ascii=False))


@arrow_udf(TEXT)
def fold(text: pa.Array) -> pa.Array:
    """Full case folding, which turns a sharp s into ss; ASCII texts are only put in lower case, a batch at once."""
    text = text.cast(pa.string())
    others = pc.fill_null(pc.invert(pc.string_is_ascii(text)), False)
    lower = pc.ascii_lower(text)
    return pc.replace_with_mask(lower, others, by_portions(text.filter(others), str.casefold)) if pc.any(others).as_py() else lower


def entity_key_of(name: str | None) -> str:
    """The entity key of one name, for folds that run row by row: folded, squeezed, without one leading article."""
    return re.sub(r"^(?:(?:le|la|les|the) |l')", "", " ".join((name or "").casefold().split()).replace("\u2019", "'"))


@arrow_udf(TEXT)
def plain(text: pa.Array) -> pa.Array:
    """Compatibility decomposition without combining marks."""
    return by_portions(text, lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


@pandas_udf(T.DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching characters, by longest matching blocks."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@pandas_udf(fields(a_start=WHOLE, b_start=WHOLE, size=WHOLE, first_difference=WHOLE))
def longest_match(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Longest matching block of two strings and the first place where they differ."""
    out = []
    for x, y in zip(a.fillna(""), b.fillna(""), strict=True):
        block = difflib.SequenceMatcher(None, x, y, autojunk=False).find_longest_match()
        out.append((block.a, block.b, block.size, next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))))
    return pd.DataFrame(out, columns=["a_start", "b_start", "size", "first_difference"])


def find_spans(text: str | None, quote: str | None) -> list[tuple[int, int]]:
    """All places of a quote, overlapping ones included; any run of white space matches any other."""
    words = (quote or "").split()
    if not text or not words:
        return []
    pattern, out = re.compile(r"\s+".join(map(re.escape, words))), []
    found = pattern.search(text)
    while found:
        out.append(found.span())
        found = pattern.search(text, found.start() + 1)
    return out


@pandas_udf(T.ArrayType(fields(start_char=WHOLE, end_char=WHOLE)))
def spans(text: pd.Series, quote: pd.Series) -> pd.Series:
    return pd.Series([[{"start_char": s, "end_char": e} for s, e in find_spans(t, q)] for t, q in zip(text, quote, strict=True)])


#: What ends a sentence, and what may close a speech after it. Fixed values.
SENTENCE_ENDS, CLOSING = ".!?…", "\"»”'"
WHITE = re.compile(r"\s+")


def ends_sentence(text: str, start: int, at: int) -> bool:
    """Whether a sentence that lies behind start ends right before this place, with or without a closing mark."""
    if at - 1 > start and text[at - 1] in CLOSING:
        at -= 1
    return at > start and text[at - 1] in SENTENCE_ENDS


def last_pause(text: str, start: int, limit: int) -> int:
    """Where the last blank line before the limit ends; without one the last sentence, then the last white space, then the limit."""
    blank = sentence = space = start
    for run in WHITE.finditer(text, start, limit):
        first, space = run.span()
        if text.count("\n", first, space) > 1:
            blank = text.rindex("\n", first, space) + 1
        if ends_sentence(text, start, first):
            sentence = space
    if ends_sentence(text, start, limit):
        sentence = limit
    return next((x for x in (blank, sentence, space) if x > start), limit)


@udtf(returnType=fields(piece_no=WHOLE, start_char=WHOLE, piece=TEXT))
class LosslessChunks:
    """Pieces of at most ``most`` characters that together are the text; only the rest after the last cut may be shorter at will."""

    def eval(self, text: str, most: int):
        text, start, number = text or "", 0, 0
        while start < len(text):
            stop = last_pause(text, start, start + most) if len(text) - start > most else len(text)
            yield number, start, text[start:stop]
            start, number = stop, number + 1


#: A word after the white space before it, which starts where that does; an elided article is not part of the word.
LETTERS = r"(?:[A-Za-zÀ-ÖØ-öø-ÿ]++|[^\W\d_])++"  # the letters met most are tried as one set first
WORD = re.compile(rf"(?<!\s)(?P<gap>\s*)(?P<elided>[ldLD][’'](?=[^\W\d_]))?(?P<word>{LETTERS}(?:[-’']{LETTERS})*)")
#: White space over which a word is still seen as following the character before it.
REACH = 63


def words_in(text: str | None):
    """(start, end, word, character before) of every word; start counts an elided article, the character may be ''."""
    for found in WORD.finditer(text or ""):
        after, start = found.end("gap"), found.start()
        before = text[start - 1] if start and after - start <= REACH else ""
        yield after, found.end(), found["word"], before


# Fixed value: phrases of naming, between a name and another that it is also called by.
ALIAS_PHRASE = r"(?:aussi |également )?(?:appelé[e]?|surnommé[e]?|nommé[e]?)|(?:était|est) (?:aussi |également )?(?:appelé[e]?|surnommé[e]?|nommé[e]?)|alias|(?:also )?known as|(?:was |is )(?:also )?(?:called|known as)"
# Fixed value: sentences of naming, which follow a name across a full stop.
NAMING_SENTENCE = r"ceux qui (?:le|la) connaissaient l[’']appelaient|those who knew (?:him|her) called (?:him|her)"
# A proper name, and how many may follow a name before such a phrase.
PROPER, MOST_FOLLOWING = r"[A-ZÀ-ÖØ-Þ][\w’'-]*", 4
FOLLOWING, BLANKS = re.compile(rf"[ \t]+{PROPER}"), re.compile(r"[ \t\u00a0]+")
#: What leads from one name to the next: a phrase after which a quotation mark may stand, or a sentence.
NAMING = re.compile(rf"\s*,?\s*(?:{ALIAS_PHRASE})\s+(?P<mark>[\"«]?\s*)|\s*\.?\s*(?:Mais |But )?(?:{NAMING_SENTENCE})\s+")
WORD_CHAR = re.compile(r"\w")


class NameLinks:
    """Which of a group's names a context shows to be one person's: one automaton over all names, then a small grammar over what
    stands between neighbouring hits. The cost follows the context and its hits, not the pairs of names."""

    def __init__(self, names: list[str]):
        import ahocorasick

        self.spellings: dict[str, set[str]] = {}
        for name in names:
            flat = " ".join(name.split())
            if flat:
                self.spellings.setdefault(flat, set()).add(name)
        self.automaton = ahocorasick.Automaton()
        for flat in self.spellings:
            self.automaton.add_word(flat, flat)
        if self.spellings:
            self.automaton.make_automaton()
        #: name -> shorter names that stand in it as whole words
        self.parts = {y: {x for _, _, x in self.whole_hits(y) if x != y} for y in self.spellings}
        #: single words of letters, the first alone in upper case
        self.single = {n for n in self.spellings if n.isalpha() and n.istitle()}

    def hits(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, name) of every name in the text, wherever it stands."""
        return [(at + 1 - len(n), at + 1, n) for at, n in self.automaton.iter(text)] if self.spellings else []

    def whole_hits(self, text: str) -> list[tuple[int, int, str]]:
        """Those across whose borders no word reaches."""
        return [(a, b, n) for a, b, n in self.hits(text) if not (a and WORD_CHAR.match(text, a - 1)) and not WORD_CHAR.match(text, b)]

    def side_by_side(self, text: str):
        """Single names that stand next to one another as one full name."""
        tied = lambda at: 0 <= at < len(text) and (text[at] in "’'-" or WORD_CHAR.match(text, at))
        starts: dict[int, list[tuple[int, str]]] = {}
        singles = [h for h in self.whole_hits(text) if h[2] in self.single]
        for a, b, n in singles:
            starts.setdefault(a, []).append((b, n))
        for a, b, n in singles:
            gap = BLANKS.match(text, b)
            if gap and not tied(a - 1):
                yield from ((n, other) for end, other in starts.get(gap.end(), ()) if not tied(end))

    def named(self, text: str):
        """Names that a phrase or sentence of naming leads to, from a name that further proper names may follow."""
        starts: dict[int, list[str]] = {}
        for a, b, n in self.hits(text):
            if not WORD_CHAR.match(text, b):
                starts.setdefault(a, []).append(n)
        for _, b, n in self.whole_hits(text):
            ends = [b]
            if n in self.single:
                for _ in range(MOST_FOLLOWING):
                    more = FOLLOWING.match(text, ends[-1])
                    if not more:
                        break
                    ends.append(more.end())
                ends += [e + 1 for e in ends if text[e : e + 1] == "."]
            for end in ends:
                lead = NAMING.match(text, end)
                if lead:
                    mark = lead["mark"] or ""
                    places = {lead.end(), lead.end() - len(mark), lead.end() - len(mark) + len(mark.rstrip())}
                    yield from ((n, other) for at in places for other in starts.get(at, ()))

    def find(self, context: str | None) -> set[tuple[str, str]]:
        """Pairs of names, the smaller first. Null and empty contexts show none."""
        if not context or not self.spellings:
            return set()
        flat = " ".join(context.split())
        found = {*self.side_by_side(context), *self.named(flat), *((x, y) for _, _, y in self.whole_hits(flat) for x in self.parts[y])}
        return {(min(x, y), max(x, y)) for a, b in found if a != b for x in self.spellings[a] for y in self.spellings[b]}


def names_link(a: str, b: str, context: str) -> bool:
    """Whether a context shows two names to be one person's."""
    return (min(a, b), max(a, b)) in NameLinks([a, b]).find(context)
