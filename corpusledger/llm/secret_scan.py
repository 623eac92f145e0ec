"""Secret scans: a keyword automaton finds where a secret may begin, anchored expressions run only there, and tokens
that carry a checksum must pass it.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
import zlib

import ahocorasick
from pyspark.sql import DataFrame

from .common import map_rows, settled

#: Base kinds, in the order that breaks ties between spans with one start.
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(number: int, width: int = 6) -> str:
    out = ""
    while number:
        number, digit = divmod(number, 62)
        out = ALPHABET[digit] + out
    return out.rjust(width, "0")


def crc_token(text: str) -> bool:
    """Whether the last six of a prefixed token's characters are the base-62 CRC-32 of those before them."""
    body = text.partition("_")[2]
    return base62(zlib.crc32(body[:-6].encode())) == body[-6:]


def web_token(text: str) -> bool:
    """Whether a dotted token's header is base64url JSON that names an algorithm; a header nested too deep to read does not."""
    head = text.partition(".")[0]
    try:
        value = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(value, dict) and "alg" in value


def mod97(text: str) -> bool:
    """The check digits of an international account number."""
    turned = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


#: Added kinds: name -> (keywords in lower case, anchored expression, checksum)
ADDED = {
    "crc": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"), re.compile(r"(?<![A-Za-z0-9_])(?:gh[pousr]|npm)_[A-Za-z0-9]{36}(?![A-Za-z0-9_])"), crc_token),
    "jwt": (("eyj",), re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"), web_token),
    "pem": (("-----begin ",), re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"), None),
    "iban": (("iban",), re.compile(r"(?i:iban):? ?([A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})(?![A-Za-z0-9])"), mod97),
}
KINDS = (*BASE, *ADDED)


@functools.lru_cache(1)
def automaton():
    """Keywords to (length, kinds)."""
    words: dict[str, list[str]] = {}
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        words.setdefault(word, []).append("assign")
    words.setdefault("akia", []).append("access")
    for kind, (keys, _, _) in ADDED.items():
        for word in keys:
            words.setdefault(word, []).append(kind)
    out = ahocorasick.Automaton()
    for word, kinds in words.items():
        out.add_word(word, (len(word), tuple(kinds)))
    out.make_automaton()
    return out


def lower_ascii(text: str) -> str:
    """A-Z in lower case and nothing else changed, so that places keep their numbers."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def find(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, order of the kind, end, kind) of every secret, sorted; places in code points, the end exclusive.

    Spans of one kind do not overlap: the leftmost match is taken, one that then fails its length or checksum is
    dropped, and the search goes on after it. Null has none.
    """
    if not text:
        return []
    found, ended = [], dict.fromkeys(KINDS, 0)
    hits = [(at - n + 1, kinds) for at, (n, kinds) in automaton().iter(lower_ascii(text))]
    for start, kinds in sorted(hits):
        for kind in kinds:
            if start < ended[kind]:
                continue
            if kind == "assign":
                m = ASSIGN.match(text, start)
                good = m and len(m[2]) >= LEAST_ASSIGN
            elif kind == "access":
                m = ACCESS.match(text, start)
                good = m and m.end() - start >= LEAST_ACCESS
            else:
                _, pattern, check = ADDED[kind]
                m = pattern.match(text, start)
                good = m and (check is None or check(m[m.lastindex or 0]))
            if m:
                ended[kind] = m.end()
                if good:
                    found.append((start, KINDS.index(kind), m.end(), kind))
    found += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found)


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every secret of every whole text as rows: id, secret (array of struct kind, start, end).

    Null and empty texts have an empty list; an empty table gives an empty one. Repeated rows give repeated rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def work(columns):
            spans = [[{"kind": k, "start": s, "end": e} for s, _, e, k in find(t)] for t in columns[text_col]]
            return [columns[id_col], spans]

        return work

    return settled(map_rows(docs.select(id_col, text_col), make, f"{id_col} {kind}, secrets array<struct<kind:string,start:long,end:long>>"), "secrets")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of the spans of every whole text; same cases as ``scan``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def work(columns):
            found = [find(t) for t in columns[text_col]]
            counts = [[sum(x[3] == k for x in f) for f in found] for k in BASE]
            base = [hashlib.sha256(joined([x for x in f if x[1] < len(BASE)]).encode()).hexdigest() for f in found]
            return [columns[id_col], *counts, base, [joined(f) for f in found]]

        return work

    return settled(map_rows(docs.select(id_col, text_col), make, f"{id_col} {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"), "secrets")
