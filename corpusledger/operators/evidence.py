"""Names, observations and their evidence."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions.udfs import LETTERS, REACH, WORD
from . import intervals

#: Words that often begin a sentence and are not names. Fixed values.
COMMON_STARTS = """the a an he she it they we i his her their its this that these those
there here then when while but and or if in on at to from of with without as
le la les un une des du de il elle ils elles je tu nous vous son sa ses leur leurs
ce cet cette ces c'est l'homme l'autre l'une l'un puis mais et ou dans sur sous
au aux en par pour sans avec quand lorsque chapter chapitre""".split()
#: What may stand before a word that begins a sentence or a speech. Fixed values.
SENTENCE_MARKS, STOPS = ".!?\n\"«—–-", ".!?"
COMMON = frozenset(COMMON_STARTS)
CLASSES, PERSISTENCE = ["explicit", "inferred", "contextual"], ["persistent", "temporary", "uncertain"]


#: Names that go to every task; more are joined.
MOST_NAMES = 200_000


def uses(word: str, before: str) -> tuple[str, bool, bool, bool]:
    """The folded name of a word and whether it is a candidate, one inside a sentence, and seen in lower case."""
    name = word.casefold()
    candidate = word[0].isupper() and name not in COMMON
    return name, candidate, candidate and before != "" and before not in SENTENCE_MARKS, word[0].islower() and before != "" and before not in STOPS


#: As WORD, with the mark before the white space (if it is one that counts), the white space and the word.
MARKED = re.compile(rf"(?:(?<=([{re.escape(SENTENCE_MARKS)}]))|(?<!\s))(\s*)(?:[ldLD][’'](?=[^\W\d_]))?({LETTERS}(?:[-’']{LETTERS})*)")


def marked_words(text: str | None) -> set[tuple[str, str]]:
    """Each different word of a text with what stands before it: a mark, '' where nothing does, else a letter."""
    first = WORD.match(text or "")
    found = set(MARKED.findall(text, first.end()) if first else MARKED.findall(text or ""))
    out = {(word, "" if len(gap) > REACH else mark or "x") for mark, gap, word in found}
    return out | {(first["word"], "")} if first else out


def word_flags(texts: DataFrame, text_col: str) -> DataFrame:
    """name, candidate, interior, lowercase: a row for each different name of a batch, with what any use of it was."""
    names = ["name", "candidate", "interior", "lowercase"]
    schema = S.StructType([S.StructField("name", S.StringType()), *[S.StructField(n, S.BooleanType()) for n in names[1:]]])

    def work(batches):
        for batch in batches:
            seen: dict[str, list[bool]] = {}
            words: set[tuple[str, str]] = set()
            for text in batch.column(0).to_pylist():
                words |= marked_words(text)
            for word, before in words:
                name, *flags = uses(word, before)
                held = seen.setdefault(name, flags)
                if held is not flags:
                    held[:] = [x or y for x, y in zip(held, flags, strict=True)]
            columns = [list(seen), *([f[i] for f in seen.values()] for i in range(3))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), *[pa.bool_()] * 3], strict=True)], names=names)

    return texts.select(text_col).mapInArrow(work, schema)


def word_places(texts: DataFrame, keys: list[str], text_col: str, wanted=None) -> DataFrame:
    """keys, name, start_char, end_char of every word whose name is in ``wanted`` (a broadcast set), or that may be a name at all."""
    rows = texts.select(*keys, text_col)
    schema = S.StructType([*[rows.schema[k] for k in keys], S.StructField("name", S.StringType()), S.StructField("start_char", S.IntegerType()), S.StructField("end_char", S.IntegerType())])

    def batch_of(batch, found):
        columns = list(zip(*found, strict=True)) if found else [()] * 4
        at = pa.array(columns[0], pa.int64())
        arrays = [batch.column(i).take(at) for i in range(len(keys))] + [pa.array(c, t) for c, t in zip(columns[1:], (pa.string(), pa.int32(), pa.int32()), strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    def work(batches):
        names = None if wanted is None else wanted.value
        for batch in batches:
            found = []
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                for match in WORD.finditer(text or ""):
                    name = match[3].casefold()
                    if name in names if names is not None else name not in COMMON:
                        found.append((i, name, match.end(1), match.end()))
                if len(found) > 200_000:
                    yield batch_of(batch, found)
                    found = []
            yield batch_of(batch, found)

    return rows.mapInArrow(work, schema)


def index_names(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """Occurrences of the corpus's names: keys, name, start_char, end_char.

    A name is a capitalized word that is no common starter, unless it is also seen in lower case and never capitalized
    inside a sentence. The first pass sends one row for each different word of a batch to the shuffle. Up to MOST_NAMES
    names then go to all tasks and only their places leave Python; more are joined to the places of all words but starters.
    """
    flags = word_flags(texts, text_col).groupBy("name").agg(F.bool_or("candidate").alias("_c"), F.bool_or("interior").alias("_i"), F.bool_or("lowercase").alias("_l"))
    names = flags.filter(F.col("_c") & (~F.col("_l") | F.col("_i"))).select("name")
    held = names.limit(MOST_NAMES + 1).collect()
    if len(held) <= MOST_NAMES:
        return word_places(texts, keys, text_col, texts.sparkSession.sparkContext.broadcast({r[0] for r in held}))
    return word_places(texts, keys, text_col).join(names, "name", "left_semi").select(*keys, "name", "start_char", "end_char")


def warnings(rows: DataFrame) -> DataFrame:
    """Observations with the rules that they break; no row is dropped."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    rules = [
        (blank("character"), "missing character"),
        (blank("attribute"), "missing attribute"),
        (blank("value"), "missing value"),
        (~F.coalesce(F.col("classification"), F.lit("")).isin(CLASSES), "unknown classification"),
        (~F.coalesce(F.col("persistence"), F.lit("")).isin(PERSISTENCE), "unknown persistence"),
        (F.col("confidence").isNull() | F.isnan("confidence") | ~F.col("confidence").between(0, 1), "confidence out of range"),
        (blank("quotation"), "empty quotation"),
    ]
    return rows.withColumn("warnings", F.array_compact(F.array(*[F.when(test, F.lit(text)) for test, text in rules])))


def review_report(rows: DataFrame, group: list[str], sound) -> DataFrame:
    """Per group how many observations there are, how many a review must see, and how many are sound (a condition) without a warning."""
    warned = F.size("warnings") > 0
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("total"), F.count_if(warned).alias("to_review"), F.count_if(sound & ~warned).alias("corrected"))


def locate_observations(observations: DataFrame, spans: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(located, dropped): each place of an observation once, whatever passage found it first.

    ``spans``: keys, observation_id, passage_no, start_char, end_char. An observation all of whose places an equal one
    before it has taken is dropped as a duplicate; ``observations`` has keys, observation_id and content.
    """
    rows = spans.join(observations.select(*keys, "observation_id", "content"), [*keys, "observation_id"])
    first = rows.groupBy(*keys, "content", "start_char", "end_char").agg(F.min(F.struct("observation_id", "passage_no")).alias("_f"))
    located = first.select(*keys, F.col("_f.observation_id").alias("observation_id"), "start_char", "end_char")
    taken = located.select(*keys, "observation_id").distinct()
    dropped = spans.select(*keys, "observation_id").distinct().join(taken, [*keys, "observation_id"], "left_anti").withColumn("reason", F.lit("duplicate locations"))
    return located, dropped


def apply_verdicts(rows: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Rows with verdict and issue; a verdict counts only if there is exactly one and it is valid just when it names no issue."""
    one = verdicts.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min("verdict").alias("_v"), F.min("issue").alias("_i"))
    joined = rows.join(one, key, "left")
    sound = (F.col("_n") == 1) & ((F.col("_v") == "valid") == (F.coalesce("_i", F.lit("none")) == "none"))
    sound = F.coalesce(sound, F.lit(False))
    return joined.withColumn("verdict", F.when(sound, F.col("_v")).otherwise("uncertain")).withColumn("issue", F.when(sound, F.coalesce("_i", F.lit("none"))).otherwise("unavailable")).drop("_n", "_v", "_i")


def confidence(exact: Column, normalized: Column, warned: Column) -> Column:
    """high for an exact quotation, medium for one that agrees after normalization, low otherwise or with a warning."""
    return F.when(warned, "low").when(exact, "high").when(normalized, "medium").otherwise("low")


def contexts(spans: DataFrame, texts: DataFrame, keys: list[str], text_col: str, around: int = 900) -> DataFrame:
    """Merged context ranges of spans, ``around`` characters to each side."""
    joined = spans.join(texts.select(*keys, F.length(text_col).alias("_n")), keys)
    wide = joined.select(*keys, F.greatest(F.lit(0), F.col("start_char") - around).alias("start_char"), F.least(F.col("_n"), F.col("end_char") + around).alias("end_char"))
    return intervals.merge(wide, keys, "start_char", "end_char", touching=True)


def buckets(classification: Column, persistence: Column) -> Column:
    return F.when(classification == "inferred", "inferred").when(persistence == "temporary", "temporary").when(persistence == "persistent", "stable").otherwise("other")


def drop_targets(rows: DataFrame, targets: DataFrame, keys: list[str], array_col: str) -> DataFrame:
    """Rows whose array lost the elements (1-based numbers) that a review names; an array may become empty."""
    marked = targets.groupBy(*keys).agg(F.collect_set("number").alias("_t"))
    joined = rows.join(marked, keys, "left")
    kept = F.filter(F.transform(F.col(array_col), lambda x, i: F.struct((i + 1).alias("n"), x.alias("x"))), lambda s: ~F.coalesce(F.array_contains(F.col("_t"), s["n"]), F.lit(False)))
    return joined.withColumn(array_col, F.transform(kept, lambda s: s["x"])).drop("_t")


def drop_target_rows(traits: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """``drop_targets`` over one row a trait: traits (keys, number, ...) whose number no review of their keys names."""
    return traits.join(targets.select(*keys, "number").distinct(), [*keys, "number"], "left_anti")


