"""Language ID by a linear-chain conditional random field over the words of a text.

Each word has hashed features: its byte n-grams, its affixes and its entry in a lexicon of words that were frequent in
training. Scores between neighbouring labels are learned with them, on word sequences spliced from runs of different
documents, so that a text may switch language. Forward-backward gives every word of a whole text its posterior; a
document gets the label with the largest mean.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, portions, settled, tidy

#: The classifier's bounded sample: rows in all, rows of a label at least, labels that a field can hold (more are an error),
#: and of a sampled text that is longer than PARTS * PART_CHARS characters, so many parts of so many, spread over all of it.
TRAIN_ROWS, LEAST_ROWS, MOST_LABELS, PARTS, PART_CHARS = 1200, 40, 200, 16, 1250
BUCKETS = 1 << 16
LEXICON, LEXICON_COUNT = 20_000, 3
LENGTH, BATCH, EPOCHS, RATE, DECAY = 48, 64, 3, 0.4, 1e-5
#: Words of a chunk in which texts are run side by side; words whose scores are remembered; numbers that one run or those scores may hold.
CHUNK, MOST_WORDS, MOST_CELLS = 64, 200_000, 16_000_000
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")


def held_out(id_column):
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % 4 == 2


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def has_letter(text: str | None, words: list[str]) -> bool:
    return bool(words) and (any(map(str.isalpha, words)) or any(map(str.isalpha, text)))


def features(word: str, lexicon: frozenset[str]) -> list[int]:
    """Buckets of a word's features, each kind under its own seed."""
    data, hashed = word.encode("utf-8", "surrogatepass"), zlib.crc32
    edged = b"^" + data + b"$"
    n = len(edged)
    out = [hashed(edged[i : i + 2], 2) & (BUCKETS - 1) for i in range(n - 1)]
    out += [hashed(edged[i : i + 3], 3) & (BUCKETS - 1) for i in range(n - 2)]
    out += [hashed(data[:k], 4) & (BUCKETS - 1) for k in (4, 5) if n > k + 2] + [hashed(data[-k:], 5) & (BUCKETS - 1) for k in (4, 5) if n > k + 2]
    if word in lexicon:
        out.append(hashed(data, 6) & (BUCKETS - 1))
    return out


class Field:
    """Weights of a trained field, and the exact marginals of whole texts."""

    def __init__(self, labels: list[str], lexicon: frozenset[str], weights: np.ndarray, moves: np.ndarray):
        self.labels, self.lexicon, self.weights, self.moves = labels, lexicon, weights, moves
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(labels)), np.float32)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """exp of the label scores of each word, the largest 1."""
        if len(self.known) > min(MOST_WORDS, MOST_CELLS // len(self.labels)):
            self.forget()
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            lists = [features(w, self.lexicon) for w in new]
            starts = np.cumsum([0] + [len(x) for x in lists[:-1]])
            sums = np.add.reduceat(self.weights[np.concatenate([np.asarray(x) for x in lists])], starts, axis=0)
            self.scores = np.concatenate([self.scores, np.exp(sums - sums.max(1, keepdims=True)).astype(np.float32)])
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        return self.scores[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]

    def forget(self) -> None:
        """Let go of remembered scores: a worker outlives its task."""
        self.known, self.scores = {}, self.scores[:0].copy()

    def most_words(self) -> int:
        """Words of one run, by what it holds for each of their chunks: a matrix over the labels and the scores."""
        labels = len(self.labels)
        return max(1, MOST_CELLS // (labels * labels + CHUNK * labels)) * CHUNK

    def means(self, texts: list[list[str]]) -> np.ndarray:
        """Mean posterior of every label over the words of each text; no text may be without words.

        Texts are run together up to a bounded number of words; a longer one is run in segments that hand on their messages.
        """
        out, most, held, size = np.zeros((len(texts), len(self.labels))), self.most_words(), [], 0
        for i, text in enumerate(texts):
            if len(text) > most:
                out[i] = self.long_total(text, most) / len(text)
                continue
            if size + len(text) > most:
                out[held] = self.totals([texts[j] for j in held])[0] / np.array([[len(texts[j])] for j in held])
                held, size = [], 0
            held.append(i)
            size += len(text)
        if held:
            out[held] = self.totals([texts[j] for j in held])[0] / np.array([[len(texts[j])] for j in held])
        return out

    def long_total(self, words: list[str], most: int) -> np.ndarray:
        """Summed posteriors of one text: messages from its end first, segment by segment, then the runs from its start."""
        starts = range(0, len(words), most)
        behind = [np.ones((1, len(self.labels)), np.float32)]
        for at in reversed(starts[1:]):
            behind.append(self.totals([words[at : at + most]], np.ones_like(behind[0]), behind[-1], back_only=True)[2])
        total, ahead = 0, None
        for at in starts:
            sums, ahead, _ = self.totals([words[at : at + most]], ahead, behind.pop())
            total = total + sums[0]
        return total

    def totals(self, texts: list[list[str]], into=None, beyond=None, back_only: bool = False) -> tuple:
        """(summed posteriors, message that leaves at the end, message that leaves at the start) of each text.

        ``into`` and ``beyond`` are the messages that reach the first word and the last from outside; without ``into`` texts begin.
        """
        counts = np.array([len(t) for t in texts])
        scores = self.word_scores([w for t in texts for w in t])
        chunks = -(-counts // CHUNK)
        first, k, labels = np.concatenate([[0], np.cumsum(chunks)[:-1]]), int(chunks.sum()), len(self.labels)
        doc = np.repeat(np.arange(len(texts)), chunks)
        place = np.arange(len(scores)) - np.repeat(np.cumsum(counts) - counts, counts)
        row, col = np.repeat(first, counts) + place // CHUNK, place % CHUNK
        x, on = np.ones((CHUNK, k, labels), np.float32), np.zeros((CHUNK, k, 1), bool)
        x[col, row], on[col, row] = scores, True
        moves = np.exp(self.moves - self.moves.max()).astype(np.float32)
        opens = np.zeros((k, 1), bool)
        if into is None:
            opens[first] = True
        # what a chunk does to any message, then the messages that reach each chunk from both sides
        through = np.broadcast_to(np.eye(labels, dtype=np.float32), (k, labels, labels)).copy()
        for t in range(CHUNK):
            moved = through @ moves if t else np.where(opens[:, :, None], through, through @ moves)
            moved = moved * x[t][:, None, :]
            through = np.where(on[t][:, :, None], moved, through)
            through /= through.max((1, 2), keepdims=True)
        ahead, behind = np.full((k, labels), 1 / labels, np.float32), np.ones((k, labels), np.float32)
        if into is not None:
            ahead[first] = into
        if beyond is not None:
            behind[first + chunks - 1] = beyond
        for j in range(1, int(chunks.max())):
            at = first[chunks > j] + j
            message = np.einsum("kl,klm->km", ahead[at - 1], through[at - 1])
            ahead[at] = message / message.sum(1, keepdims=True)
            at = first[chunks > j] + chunks[chunks > j] - 1 - j
            message = np.einsum("klm,km->kl", through[at + 1], behind[at + 1])
            behind[at] = message / message.sum(1, keepdims=True)
        left = np.einsum("klm,km->kl", through[first], behind[first])
        left /= left.sum(1, keepdims=True)
        if back_only:
            return None, None, left
        forward = np.empty_like(x)
        message = ahead
        for t in range(CHUNK):
            moved = (message @ moves if t else np.where(opens, message, message @ moves)) * x[t]
            message = np.where(on[t], moved / moved.sum(1, keepdims=True), message)
            forward[t] = message
        right = message[first + chunks - 1]
        total = np.zeros((k, labels))
        message = behind
        for t in range(CHUNK - 1, -1, -1):
            joint = forward[t] * message
            total += np.where(on[t], joint / joint.sum(1, keepdims=True), 0)
            if t:
                moved = (message * x[t]) @ moves.T
                message = np.where(on[t], moved / moved.sum(1, keepdims=True), message)
        out = np.zeros((len(texts), labels))
        np.add.at(out, doc, total)
        return out, right, left

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words = [words_of(t) for t in texts]
        fit = [i for i, w in enumerate(words) if has_letter(texts[i], w)] if self.labels else []
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if fit:
            means = self.means([words[i] for i in fit])
            for i, m in zip(fit, means, strict=True):
                best = int(m.argmax())
                names[i], scores[i] = self.labels[best], min(1.0, float(m[best]))
        return names, scores


def spliced(rows: list[tuple[list[str], int]], rng) -> list[tuple[list[str], list[int]]]:
    """Sequences of LENGTH words made of runs that follow one another at random."""
    runs = []
    for words, label in rows:
        at = 0
        while at < len(words):
            n = int(rng.integers(8, 2 * LENGTH))
            runs.append((words[at : at + n], label))
            at += n
    words, labels = [], []
    for i in rng.permutation(len(runs)):
        words += runs[i][0]
        labels += [runs[i][1]] * len(runs[i][0])
    return [(words[i : i + LENGTH], labels[i : i + LENGTH]) for i in range(0, len(words) - LENGTH + 1, LENGTH)]


def train(rows: list[tuple[str, str]], seed: int = 7) -> Field:
    """Fit a field to (text, label) rows by adaptive gradient steps on the log likelihood."""
    labels = sorted({label for _, label in rows})
    number = {label: i for i, label in enumerate(labels)}
    texts = [(words_of(t), number[label]) for t, label in rows]
    seen = Counter(w for t, _ in texts for w in t)
    lexicon = frozenset(w for w, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:LEXICON] if n >= LEXICON_COUNT)
    size, rng = len(labels), np.random.default_rng(seed)
    weights, moves = np.zeros((BUCKETS, size)), np.zeros((size, size))
    squares, move_squares = np.full((BUCKETS, size), 1e-3), np.full((size, size), 1e-3)
    if size > 1:
        cached = {w: np.asarray(features(w, lexicon)) for w in seen}
        for _ in range(EPOCHS):
            sequences = spliced(texts, rng)
            for at in range(0, len(sequences), BATCH):
                batch = sequences[at : at + BATCH]
                lists = [cached[w] for words, _ in batch for w in words]
                flat, lengths = np.concatenate(lists), np.array([len(x) for x in lists])
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                scores = np.add.reduceat(weights[flat], starts, axis=0).reshape(len(batch), LENGTH, size)
                truth = np.array([y for _, y in batch])
                emit, pairs = gradients(scores, moves, truth)
                emit = emit.reshape(-1, size)
                touched, place = np.unique(flat, return_inverse=True)
                spread = np.repeat(emit, lengths, axis=0)
                slope = np.stack([np.bincount(place, spread[:, j], len(touched)) for j in range(size)], axis=1)
                g = slope / len(batch) + DECAY * weights[touched]
                squares[touched] += g * g
                weights[touched] -= RATE * g / np.sqrt(squares[touched])
                g = pairs / len(batch)
                move_squares += g * g
                moves -= RATE * g / np.sqrt(move_squares)
    return Field(labels, lexicon, weights.astype(np.float32), moves.astype(np.float32))


def gradients(scores: np.ndarray, moves: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected minus true counts: of labels at every word, of label pairs in all."""
    many, length, size = scores.shape
    x, a = np.exp(scores - scores.max(2, keepdims=True)), np.exp(moves)
    forward, backward = np.empty_like(x), np.ones_like(x)
    forward[:, 0] = x[:, 0] / x[:, 0].sum(1, keepdims=True)
    for t in range(1, length):
        f = (forward[:, t - 1] @ a) * x[:, t]
        forward[:, t] = f / f.sum(1, keepdims=True)
    for t in range(length - 2, -1, -1):
        b = (backward[:, t + 1] * x[:, t + 1]) @ a.T
        backward[:, t] = b / b.sum(1, keepdims=True)
    emit = forward * backward
    emit /= emit.sum(2, keepdims=True)
    pair = forward[:, :-1, :, None] * a * (x * backward)[:, 1:, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    pairs = pair.sum((0, 1))
    np.subtract.at(pairs, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
    emit[np.arange(many)[:, None], np.arange(length), truth] -= 1
    return emit, pairs


def excerpt(text):
    """A text itself, or PARTS parts of one that is longer than those parts together, spread evenly from its start to its end."""
    n, most = F.length(text), PARTS * PART_CHARS
    step = lambda i: F.floor((n - PART_CHARS) * i / (PARTS - 1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.substring(text, step(i) + 1, F.lit(PART_CHARS)))
    return F.when(n <= most, text).otherwise(F.array_join(parts, " "))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """At most TRAIN_ROWS labelled rows (or LEAST_ROWS a label) that are not held out, as even over the labels as can be.

    Every labelled row with a text takes part in the draw, by a hash of its id and text; a label's rows are thinned by that
    hash before they are ranked, so a label that most rows have is not gathered, and the first of each label is drawn
    whatever the thinning does. Of long texts the ``excerpt`` is taken. More than MOST_LABELS labels are an error.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & (F.length(text_col) > 0) & ~held_out(F.col(id_col)))
    lot = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(11)), F.lit(1 << 30))
    rows = rows.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"), lot.alias("_lot"))
    counted = rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n"), F.min("_lot").alias("_least")).limit(MOST_LABELS + 1).collect()
    if len(counted) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} languages are labelled: raise MOST_LABELS or merge some")
    if not counted:
        return []
    quota = max(LEAST_ROWS, TRAIN_ROWS // len(counted))
    limits = F.create_map(*[F.lit(v) for r in counted for v in (r["_lang"], max(r["_least"], int(min(1.0, 4 * quota / r["_n"]) * (1 << 30))))])
    drawn = rows.filter(F.col("_lot") <= F.try_element_at(limits, F.col("_lang"))).withColumn("_text", excerpt(F.col("_text")))
    ranked = drawn.withColumn("_rank", F.row_number().over(Window.partitionBy("_lang").orderBy("_lot", "_id", "_text")))
    return [(r[0], r[1]) for r in ranked.filter(F.col("_rank") <= quota).select("_text", "_lang").orderBy("_lang", "_rank").collect()]


def label(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score of every whole text, by its text alone.

    A null text or one without letters is ``und`` with score 0, as is every text if nothing was learned. Equal means go
    to the smaller label. Repeated rows give repeated rows, an empty table an empty one; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(field)  # buckets x labels, at most 52 MB with 200 labels

    def make():
        own = shared.value

        def work(columns):
            names, scores = own.predict(columns[text_col])
            return [columns[id_col], columns["_held"], names, scores]

        return work

    rows = docs.select(id_col, text_col, held_out(F.col(id_col)).alias("_held"))
    return settled(map_rows(rows, make, f"{id_col} {kind}, held_out boolean, lang_pred string, score double"), "languages")


def keep_known(docs: DataFrame, field: Field, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows whose language is known, with their own columns: not ``und``, and a score of ``least`` at least.

    The default keeps texts that mix two or three languages; what goes has no letters or no language that leads.
    """
    shared, column = docs.sparkSession.sparkContext.broadcast(field), docs.columns.index(text_col)

    def work(batches):
        own = shared.value
        for whole in batches:
            for batch in portions(whole):
                names, scores = own.predict(batch.column(column).to_pylist())
                yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))
        own.forget()

    return settled(docs.mapInArrow(tidy(work), docs.schema), "known-languages")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the sample of labelled rows, then label every row."""
    return label(docs, train(sample(docs, id_col, text_col, lang_col)), id_col, text_col)
