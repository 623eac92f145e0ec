"""Byte-level BPE encoding and decoding.

The merges are compiled into a finite-state transducer that is determinised lazily. After each byte the last token of
the encoding of what has been read is unique: it is the one suffix token whose pair with the token before it survives
the merges. A state therefore holds the token that was last emitted and, for each later position, the last token that
ends there, as far as a coming token can still start at or after it. All tokens that lie on every chain back from those
positions are emitted at once, so the lookahead never exceeds the longest token. States and steps are kept by their
content and thrown away together when there are too many.

Decoding walks an incremental UTF-8 state machine, whose state is the incomplete end of a character.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import REMEMBERED, map_rows, settled

#: Most states kept, and most pieces whose encoding is remembered, before either memory is emptied.
MOST_STATES, MOST_PIECES = 100_000, 200_000
NEVER = 1 << 40
#: Ends of pieces up to this length may be run without new states; longer ones keep to the bounded lookahead.
RARE_BYTES = 64
#: Times that a step is asked for until it is determinised.
ASKED = 4
BYTES = [bytes([b]) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Transducer:
    """Encodes byte strings by ranked merges, as one left-to-right pass."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        #: last three bytes -> length of the longest token that ends so; other ends have tokens of two bytes at most
        self.reach: dict[bytes, int] = {}
        for t in ranks:
            if len(t) > max(2, self.reach.get(t[-3:], 0)):
                self.reach[t[-3:]] = len(t)
        self.openings = {t[:k] for t in ranks for k in range(1, len(t))}
        self.fits = functools.lru_cache(250_000)(self._fits)
        self.splits: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.spines: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self.reset()

    def reset(self) -> None:
        #: content -> number; content is (last emitted token or None, last tokens by position, None where dead)
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: list[dict[int, tuple[int, tuple[int, ...]] | int]] = []
        self.ends: list[tuple[int, ...]] = []
        self._number(None, (), b"")

    def _split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge makes this token; None if the merges don't make it."""
        if token not in self.splits:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                rank, i = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == NEVER:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.splits[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.splits[token]

    def _spine(self, token: int, side: int) -> list[tuple[bytes, int]] | None:
        """What stands at one edge of a token while it is merged: (part, rank of the merge that ends it), in time."""
        if token not in self.spines[side]:
            part, until, out = self.tokens[token], NEVER, []
            while True:
                out.append((part, until))
                if len(part) == 1:
                    break
                split = self._split(part)
                if split is None:
                    out = None
                    break
                until, part = self.ranks[part], split[side]
            self.spines[side][token] = out and out[::-1]
        return self.spines[side][token]

    def _fits(self, left: int, right: int) -> bool:
        """Whether the merges leave exactly these two tokens of the two tokens' bytes.

        They do unless, at some moment, the parts at the border merge before either is merged away from it; of equal
        ranks the left one goes first.
        """
        lefts, rights = self._spine(left, 1), self._spine(right, 0)
        if lefts is None or rights is None:
            return False
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = lefts[i], rights[j]
            across = self.ranks.get(a + b, NEVER)
            if across < a_until and across <= b_until and across < NEVER:
                return False
            if a_until == b_until == NEVER:
                return True
            if a_until <= b_until:
                i += 1
            else:
                j += 1

    def _number(self, last: int | None, ends: tuple, text: bytes) -> int:
        number = self.numbers.get((last, ends))
        if number is None:
            number = self.numbers[last, ends] = len(self.states)
            self.states.append((last, ends, text))
            self.steps.append({})
            tokens, p, out = self.tokens, len(ends), []
            while p:
                out.append(ends[p - 1])
                p -= len(tokens[ends[p - 1]])
            self.ends.append(tuple(out[::-1]))
        return number

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The next state and what is emitted on the way to it."""
        last, ends, text = self.states[state]
        text += BYTES[byte]
        n, ranks, fits = len(text), self.ranks, self.fits
        for start in range(max(0, n - self.reach.get(text[-3:], 2)), n):
            token = ranks.get(text[start:])
            if token is not None:
                before = ends[start - 1] if start else last
                if (start == 0 or before is not None) and (before is None or fits(before, token)):
                    break
        else:
            raise ValueError("the merges do not reach this byte string")
        ends += (token,)
        # a coming token starts where what follows opens some token, or at the end; all chains back from there meet
        openings, tokens = self.openings, self.tokens
        live = {n}
        for p in range(max(0, n - self.longest + 1), n):
            if (p == 0 or ends[p - 1] is not None) and text[p:] in openings:
                live.add(p)
        on = set(live)
        while len(live) > 1:
            p = max(live)
            live.remove(p)
            p -= len(tokens[ends[p - 1]])
            live.add(p)
            on.add(p)
        common = live.pop()
        emitted, p = [], common
        while p:
            emitted.append(ends[p - 1])
            p -= len(tokens[ends[p - 1]])
        kept = tuple([ends[p - 1] if p in on else None for p in range(common + 1, n + 1)])
        number = self._number(ends[common - 1] if common else last, kept, text[common:])
        out = self.steps[state][byte] = (number, tuple(emitted[::-1]))
        return out

    def _finish(self, state: int, rest: bytes) -> list[int]:
        """Tokens from this state to the end of the piece, position by position, with no new state."""
        last, ends, text = self.states[state]
        at, text, ends = len(text), text + rest, list(ends)
        get, fits, reach = self.ranks.get, self.fits, self.reach.get
        for n in range(at + 1, len(text) + 1):
            longest = reach(text[n - 3 : n], 2) if n > 2 else n
            for start in range(n - longest if n > longest else 0, n):
                token = get(text[start:n])
                if token is not None:
                    before = ends[start - 1] if start else last
                    if before is None:
                        if start == 0:
                            break
                    elif fits(before, token):
                        break
            else:
                raise ValueError("the merges do not reach this byte string")
            ends.append(token)
        out, p, tokens = [], len(ends), self.tokens
        while p:
            token = ends[p - 1]
            out.append(token)
            p -= len(tokens[token])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        """Token ids of one piece; an empty piece has none.

        A step is determinised when it is asked for the ASKED-th time; until then the rest of the piece is run on the
        undeterminised machine, as most rare words are met once only.
        """
        if len(self.states) > MOST_STATES:
            self.reset()
        state, steps, out = 0, self.steps, []
        for i, byte in enumerate(data):
            found = steps[state].get(byte)
            if found.__class__ is not tuple:
                asked = (found or 0) + 1
                if asked < ASKED and len(data) - i <= RARE_BYTES:
                    steps[state][byte] = asked
                    return out + self._finish(state, data[i:])
                found = self.step(state, byte)
            state, emitted = found
            if emitted:
                out.extend(emitted)
        out.extend(self.ends[state])
        return out


class Whole(dict):
    """id -> text of the ids that begin and end between characters, filled as they are met; others are not held."""

    def __init__(self, decoder: Decoder):
        self.decoder = decoder

    def __missing__(self, token: int) -> str:
        state, text = self.decoder.advance(b"", self.decoder.tokens[token])
        if state:
            raise KeyError(token)
        self[token] = text
        return text


class Decoder:
    """Ids to text piece by piece: the state is the incomplete character at the end, at most three bytes.

    Bytes that cannot begin or continue a character become U+FFFD, as the strict maximal-subpart rule has it.
    """

    #: lead byte -> (length, range of the second byte)
    LEADS = {
        **{b: (2, 0x80, 0xBF) for b in range(0xC2, 0xE0)},
        **{b: (3, 0x80, 0xBF) for b in range(0xE1, 0xF0)},
        **{b: (4, 0x80, 0xBF) for b in range(0xF1, 0xF4)},
        0xE0: (3, 0xA0, 0xBF),
        0xED: (3, 0x80, 0x9F),
        0xF0: (4, 0x90, 0xBF),
        0xF4: (4, 0x80, 0x8F),
    }

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        #: state -> id -> (state, text)
        self.steps: dict[bytes, dict[int, tuple[bytes, str]]] = {}
        #: the steps from the empty state back to it
        self.whole = Whole(self)

    @classmethod
    def advance(cls, state: bytes, data: bytes) -> tuple[bytes, str]:
        out: list[str] = []
        for byte in data:
            if state:
                length, low, high = cls.LEADS[state[0]]
                if (low if len(state) == 1 else 0x80) <= byte <= (high if len(state) == 1 else 0xBF):
                    state += bytes([byte])
                    if len(state) == length:
                        out.append(state.decode())
                        state = b""
                    continue
                out.append("�")
                state = b""
            if byte < 0x80:
                out.append(chr(byte))
            elif byte in cls.LEADS:
                state = bytes([byte])
            else:
                out.append("�")
        return state, "".join(out)

    def stream(self, ids):
        """Yield the text that each id completes, and at the end what an incomplete character leaves."""
        state = b""
        for i in ids:
            steps = self.steps.setdefault(state, {})
            found = steps.get(i)
            if found is None:
                found = steps[i] = self.advance(state, self.tokens[i])
            state, text = found
            yield text
        if state:
            yield "�"

    def decode(self, ids) -> str:
        try:
            return "".join(map(self.whole.__getitem__, ids))
        except KeyError:  # some character is dealt over ids, or an id is unknown
            return "".join(self.stream(ids))


class Codec:
    """Splits texts by a pattern and encodes each piece; pieces met before are looked up."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.machine = Transducer(self.ranks)
        self.decoder = Decoder(self.machine.tokens)
        self.pieces = regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def _new(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)  # a piece that is a token stays whole, merges or not
        packed = self.known[piece] = array("I", self.machine.encode(data) if whole is None else [whole]).tobytes()
        return packed

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; null counts as empty."""
        if len(self.known) > MOST_PIECES:
            self.known.clear()
        known, new = self.known.get, self._new
        return b"".join([known(p) or new(p) for p in self.pieces.findall(text or "")])

    def decode(self, packed: bytes) -> str:
        return self.decoder.decode(array("I", packed))


def listed(packed: list[bytes]) -> pa.Array:
    """Packed ids of many texts as an Arrow list array."""
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))


@functools.lru_cache(1)
def _codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def codec(path: str, pattern: str) -> Codec:
    """The worker's own codec, which it keeps until another operator's turn."""
    REMEMBERED["bpe"] = _codec.cache_clear
    return _codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text: id, n_tokens, token_ids (array of int).

    Null and empty texts have no tokens. Texts are encoded piece by piece, however long. Repeated rows give repeated
    rows, an empty table an empty one; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def work(columns):
            own = codec(path, pattern)
            packed = [own.encode(t) for t in columns[text_col]]
            return [columns[id_col], [len(p) // 4 for p in packed], listed(packed)]

        return work

    return settled(map_rows(docs.select(id_col, text_col), make, f"{id_col} {kind}, n_tokens long, token_ids array<int>", "bpe"), "tokens")


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """Texts of token ids: id, text. A null list decodes to the empty text; unknown ids raise an error."""
    kind = tokens.schema[id_col].dataType.simpleString()

    def make():
        def work(columns):
            own = codec(path, pattern)
            return [columns[id_col], [own.decoder.decode(x or ()) for x in columns[ids_col]]]

        return work

    return settled(map_rows(tokens.select(id_col, ids_col), make, f"{id_col} {kind}, text string", "bpe"), "tokens")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text: id, n_tokens, ids_sha256, decoded_sha256, and token_ids if asked for.

    Same cases as ``encode``.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def work(columns):
            own = codec(path, pattern)
            packed = [own.encode(t) for t in columns[text_col]]
            out = [
                columns[id_col],
                [len(p) // 4 for p in packed],
                [hashlib.sha256(p).hexdigest() for p in packed],
                [hashlib.sha256(own.decode(p).encode("utf-8", "surrogatepass")).hexdigest() for p in packed],
            ]
            return [*out, listed(packed)] if with_ids else out

        return work

    return settled(map_rows(docs.select(id_col, text_col), make, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids, "bpe"), "tokens")
