"""Small cases of the training-data operators: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusledger.llm import ann, bpe, exact_dedup, langid, license_scan, mixing, ngram_join, secret_scan, sharding, warc
from corpusledger.llm.common import new_folder
from corpusledger.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, _id long, slot string, size int"
WORDS = "red blue green stone river cloud tree house lamp paper glass wind rain sun moon star".split()


def docs(spark, rows):
    """Rows of (doc_id, text[, lang[, source]]) with columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, *["en", "src0"][len(r) - 2 :], 9, "x", 3) for r in rows], DOCS)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


LONG = "long word " * 20_000


def test_exact_dedup(spark):
    given = [(5, "a  b"), (3, "a\tb"), (4, "a b"), (7, None), (6, ""), (8, LONG), (2, LONG), (9, "a b"), (9, "a b")]
    out = rows(exact_dedup.label_copies(docs(spark, given)), "doc_id", "keep_id", "group_size", "kept")
    assert out == sorted([(5, 3, 3, False), (3, 3, 3, True), (4, 3, 3, False), (7, 6, 2, False), (6, 6, 2, True), (8, 2, 2, False), (2, 2, 2, True), (9, 9, 2, True), (9, 9, 2, True)])
    kept = exact_dedup.drop_copies(docs(spark, given))
    assert kept.columns == docs(spark, given).columns
    assert rows(kept, "doc_id") == [(2,), (3,), (6,), (9,), (9,)]
    assert exact_dedup.label_copies(docs(spark, [])).count() == 0 == exact_dedup.drop_copies(docs(spark, [])).count()


@pytest.mark.parametrize(
    "given,kept",
    [
        ([(5, "A"), (3, "B"), (5, "B")], [(3, "B"), (5, "A")]),
        ([(3, "B"), (None, "B"), (None, "C")], [(3, "B"), (None, "C")]),
        ([(None, "B"), (None, "B"), (1, "C"), (1, "C "), (2, None), (3, "")], [(1, "C"), (1, "C "), (2, None), (None, "B"), (None, "B")]),
        ([(1, LONG), (1, "x"), (0, LONG + " ")], [(1, "x"), (0, LONG + " ")]),
    ],
)
def test_copies_go_by_id_and_text(spark, given, kept):
    order = lambda rows: sorted(rows, key=str)
    clashing = docs(spark, given).withColumnsRenamed({"slot": "_hash", "size": "_row"})
    out = exact_dedup.drop_copies(clashing)
    assert out.columns == clashing.columns and order((r["doc_id"], r["text"]) for r in out.collect()) == order(kept)
    labels = exact_dedup.label_copies(clashing).filter("kept")
    assert order(r["doc_id"] for r in labels.collect()) == order(i for i, _ in kept)


def test_large_groups_are_labelled_like_others(spark):
    given = [(i, "same" if i % 3 else f"t {i // 6}") for i in range(60)]
    want = rows(exact_dedup.label_copies(docs(spark, given)), "doc_id", "keep_id", "group_size", "kept")
    first = {}
    for i, t in given:
        first.setdefault(t, i)
    assert want == sorted((i, first[t], sum(t == u for _, u in given), first[t] == i) for i, t in given)
    held = exact_dedup.LARGE
    try:
        exact_dedup.LARGE = 1
        assert rows(exact_dedup.label_copies(docs(spark, given)), "doc_id", "keep_id", "group_size", "kept") == want
    finally:
        exact_dedup.LARGE = held


def test_sharding(spark):
    shards = [f"s{i}" for i in range(7)]
    table = sharding.fill(shards, 1009)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.fill(shards[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 0.1 * 1009
    out = sharding.place(docs(spark, [(1, "a"), (1, "b"), (2, None), (None, "c")]), shards=shards, slots=1009)
    assert out.count() == 4 and out.columns == ["doc_id", "text", "lang", "source", "_id", "size", "slot", "shard"]
    got = {r["doc_id"]: (r["slot"], r["shard"]) for r in out.collect()}
    want = int(hashlib.md5(b"1").hexdigest()[:8], 16) % 1009
    assert got[1] == (want, table[want])
    assert sharding.place(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        sharding.fill(shards, 1000)


def test_shards_are_written_whole(spark, tmp_path):
    sharding.write_shards(docs(spark, [(i, f"t{i}") for i in range(50)]), f"{tmp_path}/out", shards=["a", "b", "c"], slots=1009)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert rows(out, "doc_id") == [(i,) for i in range(50)] and out.select("shard").distinct().count() == 3


def odd_texts():
    pick = random.Random(3)
    kinds = [lambda: pick.randrange(32, 127), lambda: pick.randrange(0xA0, 0x3000), lambda: pick.randrange(0x1F300, 0x1F700), lambda: pick.choice([9, 10, 13, 0x1C, 0x85, 0x2028, 32, 32])]
    out = ["".join(chr(pick.choice(kinds)()) for _ in range(pick.randrange(60))) for _ in range(200)]
    return [*out, "", " " * 300 + "x", "a" * 3000, "the" * 500, "<|endoftext|>", "naïve café 🎉 it's"]


def test_bpe_equals_the_library(spark):
    import tiktoken

    path, pattern = vocabulary()
    own = bpe.Codec(path, pattern)
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})
    for text in odd_texts():
        ids = np.frombuffer(own.encode(text), np.uint32).tolist()
        assert ids == theirs.encode_ordinary(text)
        assert own.decoder.decode(ids) == text
    given = [(1, None), (2, ""), (3, LONG), (4, "ab 🎉"), (4, "ab 🎉")]
    out = {r[0]: r[1:] for r in bpe.round_trip(docs(spark, given), path, pattern, with_ids=True).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert out[1] == out[2] == (0, empty, empty, [])
    assert out[3][3] == theirs.encode_ordinary(LONG) and out[3][2] == hashlib.sha256(LONG.encode()).hexdigest()
    tokens = bpe.encode(docs(spark, given), path, pattern)
    assert rows(bpe.decode(tokens, path, pattern), "doc_id", "text") == [(1, ""), (2, ""), (3, LONG), (4, "ab 🎉"), (4, "ab 🎉")]
    assert bpe.round_trip(docs(spark, []), path, pattern).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id long, token_ids array<int>")
    assert rows(bpe.decode(nothing, path, pattern), "doc_id", "text") == [(1, ""), (2, "")]


def test_bpe_lookahead_is_bounded_and_memory_resets():
    machine = bpe.Transducer({bytes([b]): b for b in range(256)} | {b"ab": 256, b"abab": 257, b"ba": 258})
    kept = bpe.MOST_STATES
    try:
        bpe.MOST_STATES = 3
        for data in (b"abababab", b"ba" * 200, b"babab", b""):
            for _ in range(3):
                parts = [bytes([b]) for b in data]
                while True:
                    ranked = [(machine.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in machine.ranks]
                    if not ranked:
                        break
                    i = min(ranked)[1]
                    parts[i : i + 2] = [parts[i] + parts[i + 1]]
                assert machine.encode(data) == [machine.ranks[p] for p in parts]
        assert all(len(ends) <= machine.longest for _, ends, _ in machine.states)
    finally:
        bpe.MOST_STATES = kept


def test_decoder_is_strict_about_broken_characters():
    tokens = {b: bytes([b]) for b in range(256)}
    for data in (b"\xe2\x82", b"\xe2\x82\xac\xff", b"\xf0\x9f\x8e", b"a\xc0\xafb", b"\xed\xa0\x80", "é🎉".encode()):
        assert bpe.Decoder(tokens).decode(list(data)) == data.decode("utf-8", "replace")


def test_secret_scan(spark):
    body = "A" * 30
    github = "ghp_" + body + secret_scan.base62(zlib.crc32(body.encode()))
    text = f"é password = \"hunter22\" TOKEN:abc token='abcdefg' AKIA{'X' * 16} AKIAX {'0af' * 9} {github} ghp_{'B' * 36} İ token: q1w2e3r4"
    kinds = [k for *_, k in secret_scan.find(text)]
    assert kinds == ["assign", "assign", "access", "hex", "crc", "assign"]
    for start, _, end, kind in secret_scan.find(text):
        assert kind != "crc" or text[start:end] == github
    assert secret_scan.joined(secret_scan.find("x token=abcdef")) == "assign:2:14"
    assert secret_scan.find("IBAN DE89370400440532013000") and not secret_scan.find("IBAN DE88370400440532013000")
    out = rows(secret_scan.digest(docs(spark, [(1, None), (2, ""), (3, "token=abcdef"), (3, "token=abcdef"), (4, LONG + "token=abcdef")])), "doc_id", "n_assign", "spans")
    assert out == [(1, 0, ""), (2, 0, ""), (3, 1, "assign:0:12"), (3, 1, "assign:0:12"), (4, 1, f"assign:{len(LONG)}:{len(LONG) + 12}")]
    assert secret_scan.scan(docs(spark, [])).count() == 0
    assert secret_scan.scan(docs(spark, [(1, "token=abcdef")])).first()["secrets"][0]["end"] == 12


def small_texts():
    """All texts of the small table."""
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"])
    return list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))


def test_base_secrets_of_the_whole_table(spark):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    given, want = small_texts(), []
    for doc, text in given:
        found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text or "") if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
        line = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))
        want.append((doc, *[sum(x[3] == k for x in found) for k in ("assign", "access", "hex")], hashlib.sha256(line.encode()).hexdigest()))
    out = secret_scan.digest(spark.createDataFrame(given, "doc_id long, text string"))
    assert rows(out, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(want)
    assert sum(w[1] for w in want) and sum(w[2] + w[3] for w in want)


def test_base_licenses_of_the_whole_table(spark):
    phrases = {("gnu", "general", "public", "license"): "gpl", ("apache", "license"): "apache", ("cc", "by"): "cc-by", ("mit", "license"): "mit"}
    given, want = small_texts(), []
    for doc, text in given:
        words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        found = [(i, label) for i in range(len(words)) for p, label in phrases.items() if tuple(words[i : i + len(p)]) == p]
        starts = [i for i, _ in found]
        want.append((doc, len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))))
    out = license_scan.digest(spark.createDataFrame(given, "doc_id long, text string"))
    assert sorted(map(tuple, out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()), key=lambda r: r[0]) == sorted(want)
    assert any(w[2] for w in want)
    assert all(set(b.split(",")) <= set(a.split(",")) for a, b in rows(out.filter("base_labels <> ''"), "labels", "base_labels"))


def test_an_edited_notice_before_an_exact_one_is_found():
    edited, exact = "licensd undr the apache license version 2 0", "licensed under the apache license version 2 0"
    for text in (f"x {edited} and {exact} end", f"x {exact} and {edited} end", f"{edited} a {exact} b {edited}"):
        near = [n for n in license_scan.find(text)[2] if n[2] == "apache"]
        assert len(near) == text.count("version 2 0") and min(n[3] for n in near) == 0


def test_notices_agree_with_an_unseeded_search():
    """Every part's expression over the whole line, chained likewise: what the pieces may not lose."""
    pick, seen = random.Random(3), 0
    fillers = "red stone of the license public general gnu under modify terms by software".split()
    for _ in range(300):
        words = []
        for _ in range(pick.randint(1, 4)):
            words += pick.choices(fillers, k=pick.randint(0, 6))
            notice = list(pick.choice(list(license_scan.NOTICES)))
            for _ in range(pick.randint(0, 7)):
                i = pick.randrange(len(notice))
                notice[i : i + pick.randint(0, 1)] = pick.choice(["", "a", "b", " ", "xy"])
            words += "".join(notice).split()
        line, want = " ".join(words), []
        for notice, label in license_scan.NOTICES.items():
            found = [license_scan.matches_in(license_scan.part_pattern(p)[0], line, 0, len(line)) for p in license_scan.parts_of(notice)]
            want += [(*c, label) for c in license_scan.chained(found)] if all(found) else []
        assert sorted(license_scan.near_places(line)) == sorted(want)
        seen += len(want)
    assert seen > 200


def test_parts_of_notices():
    for notice in license_scan.NOTICES:
        parts = license_scan.parts_of(notice)
        assert " ".join(parts) == notice and max(map(len, parts)) <= license_scan.PART_CHARS
    long = "permission is granted to anyone to use this software for any purpose including commercial applications"
    assert license_scan.find(f"x {long.replace('granted', 'grantd').replace('commercial', 'comercial')} y")[2] == [(1, 16, "zlib", 2)]
    assert not license_scan.find(long.replace(" for any", " red green blue for any"))[2]


@pytest.mark.parametrize("text", ["cc by " * 40_000, "general public license " * 10_000, "licensed under the gnu " * 10_000])
def test_license_scan_is_linear(text):
    import time

    began = time.time()
    n, exact, _ = license_scan.find(text)
    assert time.time() - began < 30 and n == len(text.split()) and len(exact) == text.count("cc by")


@pytest.mark.parametrize("header", [b'{"alg":' + b"[" * 100_000, b"[" * 300_000, b"\xff" * 9000, b'{"alg":1' + b"0" * 6000 + b"}", b'{"alg":"HS256"} x'])
def test_hostile_token_headers(header):
    import base64

    text = "x eyJ" + base64.urlsafe_b64encode(header).decode().rstrip("=")[3:] + ".aaaaaaaaaaaa.bbbbbbbb y"
    assert [s for s in secret_scan.find(text) if s[3] == "jwt"] == []


def test_license_scan(spark):
    n, exact, near = license_scan.find("x. Released under the MIT-License, cc by CC BY")
    assert n == 10 and exact == [(4, "mit"), (6, "cc-by"), (8, "cc-by")]
    assert near == [(1, 6, "mit", 0)]
    _, exact, near = license_scan.find("foo relased undr the mit license bar")
    assert near == [(1, 6, "mit", 2)]
    _, exact, near = license_scan.find("This Work is licenced under the GNU Genral Public License, version 3")
    assert not exact and [x[2] for x in near] == ["gpl"]
    out = rows(license_scan.digest(docs(spark, [(1, None), (2, "the é apache license"), (3, LONG + "cc by"), (3, LONG + "cc by")])), "doc_id", "n_words", "n_base", "first_word", "labels", "score")
    assert out == [(1, 0, 0, None, "", 0.0), (2, 4, 1, 2, "apache", 1.0), (3, 40_002, 1, 40_000, "cc-by", 1.0), (3, 40_002, 1, 40_000, "cc-by", 1.0)]
    assert license_scan.scan(docs(spark, [])).count() == 0


def test_fit_is_as_near_as_can_be():
    pick = np.random.default_rng(1)
    for _ in range(200):
        lengths = np.unique(pick.integers(1, 30, 5))
        counts = pick.integers(1, 4, len(lengths))
        budget = int(pick.integers(0, (lengths * counts).sum() + 1))
        reachable = {0}
        for length, n in zip(lengths, counts):
            reachable = {s + length * k for s in reachable for k in range(n + 1)}
        best = max(s for s in reachable if s <= budget)
        taken = mixing.fit(lengths, counts, budget)
        assert (taken <= counts).all() and (taken >= 0).all()
        assert budget - lengths.max() < (taken * lengths).sum() <= best
        whole = mixing.reach(lengths, counts, budget)
        assert (whole * lengths).sum() == best and (whole <= counts).all()


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    goal, free, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            goal |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            goal[s] = float(most * sizes[s])
            left -= goal[s]
        free -= set(over)
    return goal


def test_mixing(spark):
    pick = random.Random(2)
    given = [(i, " ".join(pick.choices(WORDS, k=pick.randrange(40))), "en", pick.choice(["b", "a", None, "é", "empty"])) for i in range(300)]
    given = [(i, None if s == "empty" else t, g, s) for i, t, g, s in given]
    out = mixing.mix(docs(spark, given)).collect()
    again = mixing.mix(docs(spark, given[::-1])).collect()
    assert sorted(out) == sorted(again) and len(out) == 300
    source = {i: s for i, _, _, s in given}
    sizes, taken, goals = defaultdict(int), defaultdict(int), {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        goals[source[r["doc_id"]]] = r["target"]
    want = brute_targets(sizes)
    for s in sizes:
        assert goals[s] == pytest.approx(want[s]) and abs(taken[s] - goals[s]) <= 2
    kept = mixing.RANKED
    try:
        mixing.RANKED = 2
        many = [(i, "a b c", "en", "s" if i % 2 else "t") for i in range(101)]
        got = mixing.mix(docs(spark, many)).collect()
        assert sum(r["taken"] for r in got if r["doc_id"] % 2) == pytest.approx(next(r["target"] for r in got if r["doc_id"] % 2), abs=3)
    finally:
        mixing.RANKED = kept
    assert mixing.mix(docs(spark, [])).count() == 0 == mixing.repeat_taken(docs(spark, [])).count()
    mixed = mixing.repeat_taken(docs(spark, given))
    assert mixed.columns == docs(spark, given).columns
    copies = Counter(r["doc_id"] for r in mixed.select("doc_id").collect())
    assert copies == {r["doc_id"]: r["taken"] // r["size"] for r in out if r["taken"]}


def synthetic_languages(n):
    pick = random.Random(4)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["zu", "ße", "xo"]}
    return [(i, " ".join("".join(pick.choices(parts[k], k=3)) for _ in range(pick.randrange(5, 60))), k) for i in range(n) for k in [pick.choice(sorted(parts))]]


def test_language_id(spark):
    given = synthetic_languages(300)
    hidden = [(i, t, None if i % 5 == 0 else k) for i, t, k in given] + [(1000, None, "aa"), (1001, "12 ½ !", "bb"), (1002, "", None), (1003, given[0][1] + " " + LONG, None)]
    out = {r[0]: r for r in langid.identify(docs(spark, hidden)).collect()}
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in out)
    assert np.mean([out[i]["lang_pred"] == k for i, _, k in given]) > 0.98
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert all(0 <= r["score"] <= 1 for r in out.values())
    none = langid.identify(docs(spark, [(1, "abc", None)])).collect()
    assert none[0]["lang_pred"] == "und"
    assert langid.identify(docs(spark, [])).count() == 0


def test_no_label_is_lost(spark):
    given = [(i, "kalo mi " * 9000, "xx") for i in range(40)] + [(100 + i, "zuße xo zu", "yy") for i in range(40)] + [(200, "pe pi po", "zz")] * 3
    given = [g for g in given if zlib.crc32(str(g[0]).encode()) % 4 != 2]
    drawn = langid.sample(docs(spark, given))
    assert {k for _, k in drawn} == {"xx", "yy", "zz"}
    assert max(len(t) for t, _ in drawn) <= langid.PARTS * (langid.PART_CHARS + 1)
    out = langid.identify(docs(spark, [*given, (907, "kalo mi kalo", None), (908, "zuße xo", None)]))
    found = {r[0]: r["lang_pred"] for r in out.collect()}
    assert found[907] == "xx" and found[908] == "yy"
    kept = langid.MOST_LABELS
    try:
        langid.MOST_LABELS = 2
        with pytest.raises(ValueError):
            langid.sample(docs(spark, given))
    finally:
        langid.MOST_LABELS = kept


def test_an_excerpt_reaches_from_start_to_end(spark):
    text = " ".join(f"w{i}" for i in range(20_000))
    part = docs(spark, [(1, text)]).select(langid.excerpt(F.col("text"))).first()[0]
    assert part.startswith("w0 w1 ") and part.endswith(" w19999") and " w10" in part


def test_held_out_accuracy_on_the_small_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(table).filter("held_out").join(table.filter("lang IS NOT NULL").select("doc_id", "lang"), "doc_id")
    right = [r["lang"] == r["lang_pred"] for r in out.collect() if r["lang_pred"] != "und"]
    assert len(right) > 100 and np.mean(right) >= 0.97


def test_marginals_are_exact_and_follow_switches():
    field = langid.train([(t, k) for _, t, k in synthetic_languages(200)])
    a, b = ("kalomi lomika mikalo " * 40).split(), ("zußexo xozuße ßexozu " * 40).split()
    mixed = a + b
    x, moves = field.word_scores(mixed).astype(float), np.exp(field.moves - field.moves.max()).astype(float)
    ahead, behind = [x[0] / x[0].sum()], [np.ones(2)]
    for i in range(1, len(mixed)):
        m = (ahead[-1] @ moves) * x[i]
        ahead.append(m / m.sum())
        m = moves @ (x[-i] * behind[-1])
        behind.append(m / m.sum())
    p = np.array(ahead) * np.array(behind[::-1])
    p /= p.sum(1, keepdims=True)
    assert np.allclose(field.means([a, mixed, b])[1], p.mean(0), atol=1e-5)
    assert abs(p.mean(0)[0] - 0.5) < 0.05
    kept = langid.MOST_CELLS
    try:
        langid.MOST_CELLS = 400  # runs of three chunks: the mixed text is four segments
        assert field.most_words() == 192
        assert np.allclose(field.means([a, mixed, b, a[:5]])[1], p.mean(0), atol=1e-5)
    finally:
        langid.MOST_CELLS = kept


def brute_components(given, k, num, den):
    sets = {}
    for i, t in given:
        w = (t or "").encode().lower().split()
        sets[i] = set() if not w else {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            shared = len(sets[i] & sets[j])
            if shared and den * shared >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), find(i)) for i in sets)


def near_copies(n):
    pick = random.Random(6)
    base = pick.choices(WORDS, k=120)
    out = [(0, None), (1, ""), (2, "one two"), (3, "One  two"), (4, "one"), (5, " ".join(base))]
    for i in range(6, n):
        w = list(base) if i % 3 else pick.choices(WORDS, k=pick.randrange(1, 90))
        for _ in range(pick.randrange(0, 9)):
            w[pick.randrange(len(w))] = pick.choice(WORDS)
        out.append((i, " ".join(w)))
    return [*out, (n, LONG), (n + 1, LONG + "end")]


@pytest.mark.parametrize("k,num,tile,hot", [(3, 90, 512, 2048), (5, 80, 4, 3), (3, 60, 3, 1000)])
def test_ngram_join_finds_every_link(spark, k, num, tile, hot):
    given = near_copies(120)
    kept = ngram_join.TILE, ngram_join.HOT
    try:
        ngram_join.TILE, ngram_join.HOT = tile, hot
        out = rows(ngram_join.join(docs(spark, given), k, num, 100), "doc_id", "n_shingles", "component_id")
    finally:
        ngram_join.TILE, ngram_join.HOT = kept
    assert out == brute_components(given, k, num, 100)


def test_ngram_join_with_shared_passages(spark):
    """Texts of one passage and little else: its n-grams are in many blocks, and only some of the texts link."""
    pick = random.Random(12)
    passages = [[f"p{j}w{i}" for i in range(80)] for j in range(2)]
    given = []
    for i in range(90):
        own = [f"o{pick.randrange(40)}" for _ in range(pick.choice([2, 5, 30]))]
        given.append((i, " ".join(passages[i % 2] + (own if i % 5 else []))))
    kept = ngram_join.HOT, ngram_join.TILE, ngram_join.HUBS
    try:
        ngram_join.HOT, ngram_join.TILE, ngram_join.HUBS = 8, 16, 2
        for num in (90, 70):
            out = rows(ngram_join.join(docs(spark, given), 3, num, 100), "doc_id", "n_shingles", "component_id")
            assert out == brute_components(given, 3, num, 100)
    finally:
        ngram_join.HOT, ngram_join.TILE, ngram_join.HUBS = kept


def test_ngram_join_edges(spark):
    assert ngram_join.join(docs(spark, [])).count() == 0
    given = [(2, "a b c"), (2, "a b c"), (1, "A B C"), (None, "a b c")]
    out = ngram_join.join(docs(spark, given), 3, 90, 100).collect()
    assert sorted((r[0] or 0, r[1], r[2]) for r in out if r[0]) == [(1, 1, 1), (2, 1, 1), (2, 1, 1)] and len(out) == 4
    assert rows(ngram_join.keep_one(docs(spark, given[:3])), "doc_id") == [(1,)]


def test_count_tree_never_loses_a_pair():
    pick = np.random.default_rng(2)
    sets = [np.unique(pick.integers(0, 300, pick.integers(5, 400)).astype(np.uint64)) for _ in range(150)]
    kept = ngram_join.LOW_LEVELS
    try:
        levels = ngram_join.LOW_LEVELS = ((60, 8), (120, 16), (1 << 62, 64))
        vectors = [ngram_join.unpacked(ngram_join.packed(v), len(s), levels) for s in sets for v in [ngram_join.point(s, levels)]]
        near = {tuple(sorted(p)) for p in ngram_join.candidates(vectors, 50, 100)}
    finally:
        ngram_join.LOW_LEVELS = kept
    want = {(j, i) for i, s in enumerate(sets) for j, t in enumerate(sets[:i]) if ngram_join.linked(s, t, 50, 100)}
    assert want <= near and len(near) < 150 * 149 / 2


VECTORS = "vec_id long, embedding array<float>, _id int, score int"


def vectors(spark, given):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in given], VECTORS)


def test_nearest_neighbours(spark):
    pick = np.random.default_rng(3)
    points = pick.standard_normal((600, 24)).astype(np.float32)
    points[100:160] = points[100]
    given = [(i, points[i].tolist()) for i in range(600)] + [(600, None), (700, [0.0] * 24), (800, [float("nan")] + [1.0] * 23), (900, [None] + [1.0] * 23), (1000, []), (1100, [1.0, 2.0]), (1, points[1].tolist())]
    df = vectors(spark, given)
    out = ann.search(df, df.filter("vec_id % 20 = 0"), k=5).collect()
    found = defaultdict(list)
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 600, 20))
    hits = 0
    exact = points.astype(float)
    for q, got in found.items():
        gaps = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        gaps[q] = np.inf
        best = np.lexsort((np.arange(600), gaps))[:5]
        hits += len(set(best) & {i for i, _ in got})
        assert all(s == pytest.approx(gaps[i], abs=1e-12) for i, s in got)
    assert hits >= 0.9 * 5 * len(found)
    assert [i for i, _ in found[100]] == [101, 102, 103, 104, 105]
    few = vectors(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])])
    assert [tuple(r)[:3] for r in ann.search(few, few).collect()] == [(0, 1, 1), (1, 1, 0)]
    assert ann.search(vectors(spark, []), vectors(spark, [])).count() == 0


def test_recall_with_few_vectors_verified_over_many_blocks(spark):
    pick = np.random.default_rng(9)
    n, k = 8000, 10
    points = pick.standard_normal((n, 48))
    points[: n // 2] = points[pick.integers(n // 2, n, n // 2)] + 0.3 * pick.standard_normal((n // 2, 48))
    df = vectors(spark, [(i, p.tolist()) for i, p in enumerate(points.astype(np.float32))])
    kept = ann.BLOCK, ann.QUERY_BLOCK
    try:
        ann.BLOCK, ann.QUERY_BLOCK = 2000, 100
        out = ann.search(df, df.filter("vec_id % 50 = 0"), k).collect()
    finally:
        ann.BLOCK, ann.QUERY_BLOCK = kept
    exact, hits = points.astype(np.float32).astype(float), 0
    found = defaultdict(set)
    for r in out:
        found[r["query_id"]].add(r["vec_id"])
    for q in range(0, n, 50):
        gaps = ((exact - exact[q]) ** 2).sum(1)
        gaps[q] = np.inf
        hits += len(set(np.argsort(gaps)[:k]) & found[q])
    assert hits >= 0.9 * k * len(found) and len(found) == n // 50
    assert np.mean([r["n_verified"] for r in out]) <= n / 10


PAGES = "page_id long, url string, html string, _key string"


def test_warc_round_trip_and_lookup(spark):
    big = "é" * 600
    given = [(1, "http://www.a.example.com/x?q=1#f", big), (2, "https://a.example.com/x?q=1", big), (3, "http://b.org", "s" * 999), (4, "http://b.org/", "s" * 999), (5, None, None), (6, "http://b.org/", ""), (7, "nonsense", "a\r\n\r\nWARC/1.1\r\n")]
    given += [(100 + i, f"http://c{i % 7}.net/p{i}", f"page {i} " * 200) for i in range(60)] + [(200 + i, "http://hot.org/", f"hot {i}") for i in range(40)] + [(300, "http://z.org", LONG)]
    pages = spark.createDataFrame([(*r, "k") for r in given], PAGES)
    kept = warc.BLOCK_LINES, warc.BLOCK_BYTES, warc.ARCHIVE_BYTES, warc.LARGE
    try:
        warc.BLOCK_LINES, warc.BLOCK_BYTES, warc.ARCHIVE_BYTES, warc.LARGE = 8, 5000, 2000, 1000
        directory = warc.write_archives(pages, new_folder(spark, "warc"), partitions=3)
        out = warc.read_archives(directory).collect()
        held = [r.asDict() for r in directory.collect()]
    finally:
        warc.BLOCK_LINES, warc.BLOCK_BYTES, warc.ARCHIVE_BYTES, warc.LARGE = kept
    assert sorted(r["page_id"] for r in out) == sorted(r[0] for r in given)
    assert max(r["n_lines"] for r in held) == 8 and len({r["archive"] for r in held}) > 3
    by = {r["page_id"]: r for r in out}
    for i, _, html in given:
        body = (html or "").encode()
        assert by[i]["payload_bytes"] == len(body) and by[i]["payload_digest"] == hashlib.sha1(body).hexdigest()
        assert by[i]["payload"] == (None if i == 1 else body)
    assert (by[1]["record_type"], by[1]["refers_to"]) == ("revisit", 2)
    assert all(by[i]["record_type"] == "response" and by[i]["refers_to"] is None for i in by if i != 1)
    captures = warc.Captures(held)
    assert [r["page_id"] for r in captures.find("com,example,a)/x?q=1")] == [1, 2]
    assert [r["page_id"] for r in captures.find("org,b)/")] == [3, 4, 6]
    assert captures.find("zz,absent)/") == []
    asked = ["org,b)/", "net,c3)/p3", "none", "org,b)/", "org,hot)/"]
    assert sorted(r["page_id"] for r in warc.lookup(directory, asked).collect()) == [3, 4, 6, 103, *range(200, 240)]
    every = spark.createDataFrame([(k,) for k in {key for r in held for key in (r["first_key"], r["last_key"])}] + [(None,)], "k string")
    found = warc.lookup(directory, every).collect()
    assert all(by[r["page_id"]]["payload"] == r["payload"] for r in found) and {r["url_key"] for r in found} == {r[0] for r in every.collect() if r[0] is not None}
    assert warc.lookup(directory, []).count() == 0


def test_warc_defines_null_and_repeated_ids(spark):
    big = "y" * 2000
    given = [(1, "http://a.org", "x", "k"), (1, "http://a.org", big, "k"), (None, "http://a.org", "z", "k"), (None, "http://b.org", big, "k"), (None, None, "w" * 1000, "k"), (None, None, "w" * 1000, "k")]
    pages = spark.createDataFrame(given, PAGES)
    out = warc.archive_round_trip(spark, pages)
    want = [(1, 1, "response", None), (1, 2000, "response", None), (None, 1, "response", None), (None, 2000, "revisit", 1), (None, 1000, "response", None), (None, 1000, "response", None)]
    found = [tuple(r) for r in out.select("page_id", "payload_bytes", "record_type", "refers_to").collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    empty = warc.write_archives(spark.createDataFrame([], PAGES), new_folder(spark, "warc"))
    assert warc.read_archives(empty).count() == 0
    assert warc.archive_round_trip(spark, spark.createDataFrame([], PAGES)).count() == 0


def test_portions_are_bounded():
    import pyarrow as pa

    from corpusledger.llm import common

    texts = ["a" * 10] * 7 + ["b" * 1000] + [None, ""] * 5 + ["c" * 60] * 3
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "t": texts})
    kept = common.BATCH_ROWS, common.BATCH_BYTES
    try:
        common.BATCH_ROWS, common.BATCH_BYTES = 6, 100
        parts = list(common.portions(batch))
    finally:
        common.BATCH_ROWS, common.BATCH_BYTES = kept
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts
    assert all(p.num_rows <= 6 and (p.num_rows == 1 or sum(len(x or "") for x in p.column(1).to_pylist()) <= 100) for p in parts)
    assert list(common.portions(batch.slice(0, 0))) == []


def test_the_session_keeps_its_settings(spark):
    before = dict(spark.conf.getAll)
    given = docs(spark, [(i, f"word {i} token=abcdef{i}") for i in range(5)])
    assert secret_scan.digest(given).count() == license_scan.digest(given).count() == ngram_join.join(given).count() == 5
    after = dict(spark.conf.getAll)
    rows_a_batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    assert after.pop(rows_a_batch, "10000") == before.pop(rows_a_batch, "10000") and after == before


def test_whole_tokens_are_decoded_without_the_stream():
    from corpusledger.llm import bpe

    decoder = bpe.Decoder({0: b"a", 1: "é".encode(), 2: b"\xc3", 3: b"\xa9", 4: b"\xff"})
    stream, calls = decoder.stream, []
    decoder.stream = lambda ids: calls.append(1) or stream(ids)
    assert decoder.decode([0, 1, 4, 0]) == "aé\ufffda" and not calls
    assert decoder.decode([0, 2, 3, 2]) == "aé\ufffd" and calls == [1]
    assert decoder.decode([]) == ""


def test_tokens_are_sought_no_further_back_than_one_reaches():
    from corpusledger.llm import bpe

    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257, b"abcd": 258, b"bcd": 259}
    machine = bpe.Transducer(ranks)
    assert machine.reach == {b"abc": 3, b"bcd": 4}
    for _ in range(bpe.ASKED + 1):
        assert machine.encode(b"xabcdbcdab") == [ord("x"), 258, ord("b"), ord("c"), ord("d"), 256]
