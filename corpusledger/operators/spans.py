"""Where quotes stand in texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.udfs import find_spans
from .lineage import checkpointed, maybe_in

#: Quotes that travel to every task of a pass over the texts; more of them meet the texts by their words.
MOST_QUOTES = 20_000
#: Quotes that are searched in one copy of a text.
QUOTES_A_COPY = 1000
#: White space, as the search has it. Fixed values.
WHITE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
PLACES = "{0} long, {1} long, start_char int, end_char int, start_line int, end_line int, wording string, leads boolean, closing_start int, n_chars int"


def details(text: str, start: int, end: int) -> tuple:
    """Lines (1-based, of the last character), own wording, whether only white space stands before, the start moved left over
    white space if only white space follows, and the length of the text."""
    lines = text.count("\n", 0, start) + 1
    closing = len(text[:start].rstrip()) if not text[end:].strip() else None
    return start, end, lines, lines + text.count("\n", start, end - 1), text[start:end], not text[:start].strip(), closing, len(text)


def placed(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    names, types = zip(*[x.split() for x in schema.split(", ")], strict=True)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, t in enumerate(types)], names=list(names))


def places(texts: DataFrame, quotes: list, id_col: str, text_col: str, quote_id: str) -> DataFrame:
    """One pass: every place of the given (id, quote) pairs with its details."""
    import ahocorasick

    keyed: dict[str, list[int]] = {}
    for k, (_, quote) in enumerate(quotes):
        if (quote or "").split():
            keyed.setdefault(max(quote.split(), key=len), []).append(k)
    schema = PLACES.format(id_col, quote_id)

    def work(batches):
        automaton = ahocorasick.Automaton()
        for word, at in keyed.items():
            automaton.add_word(word, at)
        automaton.make_automaton()
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hits = {k for _, at in automaton.iter(text) for k in at} if text and keyed else ()
                out += [(doc, quotes[k][0], *details(text, s, e)) for k in sorted(hits) for s, e in find_spans(text, quotes[k][1])]
            yield placed(out, schema)

    return texts.select(F.col(id_col).cast("long"), text_col).mapInArrow(work, schema)


def words(c: Column) -> Column:
    return F.array_remove(F.split(c, WHITE), "")


def places_by_words(texts: DataFrame, quotes: DataFrame, id_col: str, text_col: str, quote_id: str, quote_col: str) -> DataFrame:
    """Every place of quotes of three words or more, however many, with its details.

    A quote's words but the first and last stand in a text as whole words. The one of them that the fewest texts hold, by counts
    over all texts, is the quote's key; texts emit those of their words that a bitmap of the keys knows, and meet quotes by word. What
    met is searched in the text, up to QUOTES_A_COPY quotes in one copy of it. So the texts are read three times for any number of quotes.
    """
    given = quotes.select(F.col(quote_id).alias("_q"), F.col(quote_col).alias("_quote"), words(F.col(quote_col)).alias("_words"))
    inner = given.select("_q", "_quote", F.explode(F.array_distinct(F.expr("slice(_words, 2, size(_words) - 2)"))).alias("_word"))
    rows = texts.select(F.col(id_col).cast("long").alias("_doc"), F.explode(F.array_distinct(words(F.col(text_col)))).alias("_word"))
    counts = maybe_in(rows, "_word", inner.select("_word")).groupBy("_word").agg(F.count(F.lit(1)).alias("_n"))
    # a quote with a word that no text holds has no place
    best = inner.join(counts, "_word", "left").groupBy("_q", "_quote").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_word")).alias("_key"))
    keys = checkpointed(best.filter("_key._n > 0").select("_q", "_quote", F.col("_key._word").alias("_word")).join(given.groupBy("_q", "_quote").agg(F.count(F.lit(1)).alias("_times")), ["_q", "_quote"]))
    met = maybe_in(rows, "_word", keys.select("_word")).distinct().join(keys, "_word").select("_doc", "_q", "_quote", "_times")
    met = checkpointed(met)
    copies = met.groupBy(F.col("_doc").alias("_of")).agg(F.ceil(F.count(F.lit(1)) / QUOTES_A_COPY).alias("_copies"))
    dealt = met.join(copies, F.col("_doc").eqNullSafe(F.col("_of"))).select("_doc", "_q", "_quote", "_times", F.pmod(F.xxhash64("_q", "_quote"), F.col("_copies")).alias("_copy"))
    asked = checkpointed(dealt.groupBy("_doc", "_copy").agg(F.collect_list(F.struct("_q", "_quote", "_times")).alias("_asked")).drop("_copy"))
    own = texts.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    both = own.join(asked, own["_id"].eqNullSafe(asked["_doc"])).select("_id", "_text", "_asked")
    schema = PLACES.format(id_col, quote_id)

    def work(batches):
        for batch in batches:
            out = []
            for doc, text, some in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for q in some:
                    out += [(doc, q["_q"], *details(text, s, e)) for s, e in find_spans(text, q["_quote"])] * q["_times"]
            yield placed(out, schema)

    return both.mapInArrow(work, schema)


def locate(texts: DataFrame, quotes: DataFrame, id_col: str, text_col: str, quote_id: str, quote_col: str) -> DataFrame:
    """Every place of every quote, overlapping ones included, with what the text tells about it (PLACES): offsets from 0, end exclusive.

    Up to MOST_QUOTES quotes go to all tasks: the longest word of each is in one automaton, a text is read once, and only
    quotes whose word it holds are searched. More quotes meet the texts by their words (``places_by_words``); those of one or two words, which
    may stand inside longer words, are dealt into parts of MOST_QUOTES, each a pass. Null and blank quotes or texts have no place.
    Repeated rows of either side give repeated places.
    """
    given = quotes.select(F.col(quote_id).cast("long"), quote_col)
    if given.count() <= MOST_QUOTES:
        return places(texts, [tuple(r) for r in given.collect()], id_col, text_col, quote_id)
    n_words = F.size(words(F.col(quote_col)))
    out, short = places_by_words(texts, given.filter(n_words >= 3), id_col, text_col, quote_id, quote_col), given.filter((n_words > 0) & (n_words < 3))
    parts = -(-short.count() // MOST_QUOTES)
    for part in range(parts):
        some = [tuple(r) for r in short.filter(F.pmod(F.xxhash64(quote_id, quote_col), F.lit(parts)) == part).collect()]
        out = out.unionByName(places(texts, some, id_col, text_col, quote_id))
    return out


def with_lines(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Places with their lines."""
    return spans.select(*keys, "start_char", "end_char", "start_line", "end_line")


def unique(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The places of quotes that stand once only."""
    once = spans.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("start_char").alias("start_char"), F.min("end_char").alias("end_char"))
    return once.filter("_n = 1").drop("_n")


def restored(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The text's own wording of a quote, if all its places agree."""
    return spans.groupBy(*keys).agg(F.min("wording").alias("wording"), F.max("wording").alias("_x")).filter("wording = _x").drop("_x")


def anchored(spans: DataFrame, quotes: DataFrame, keys: list[str], quote_id: str, quote_col: str) -> DataFrame:
    """The quote to keep for each text: itself if it stands there word for word, else the one wording that stands for it: keys, quote.

    A quote that agrees with the text only after normalization is repaired only if all its places read the same.
    """
    met = spans.join(quotes.select(F.col(quote_id).cast("long").alias(quote_id), F.col(quote_col).alias("_q")), quote_id)
    one = met.groupBy(*keys).agg(F.max(F.when(F.col("wording") == F.col("_q"), F.col("_q"))).alias("_same"), F.min("wording").alias("_lo"), F.max("wording").alias("_hi"))
    return one.select(*keys, F.coalesce("_same", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))).alias("quote")).filter("quote IS NOT NULL")


def prefix_span(spans: DataFrame, keys: list[str]) -> DataFrame:
    """First places that nothing but white space precedes."""
    first = spans.groupBy(*keys).agg(F.min(F.struct("start_char", "end_char", "leads")).alias("_s")).select(*keys, "_s.*")
    return first.filter("leads").select(*keys, F.lit(0).alias("start_char"), "end_char")


def suffix_span(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Last places that reach the end, white space aside; the start is moved left over white space."""
    last = spans.groupBy(*keys).agg(F.max(F.struct("start_char", "end_char", "closing_start", "n_chars")).alias("_s")).select(*keys, "_s.*")
    return last.filter("closing_start IS NOT NULL").select(*keys, F.col("closing_start").alias("start_char"), F.col("n_chars").alias("end_char"))
