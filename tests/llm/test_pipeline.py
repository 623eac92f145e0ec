"""The pipeline against what each stage must do, by brute force on a small table."""

import random

from tests.llm.test_llm import WORDS, brute_components, synthetic_languages


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    pick = random.Random(8)
    given = [(i, t, k, pick.choice(["a", "b"]), len(t)) for i, t, k in synthetic_languages(120)]
    given += [(200 + i, given[i][1], given[i][2], "c", 0) for i in range(20)] + [(300, None, "aa", "a", 0), (301, "12 34", None, None, 5)]
    given += [(400 + i, given[i][1] + " " + pick.choice(WORDS[:1] + [given[i][1].split()[0]]), given[i][2], "b", 0) for i in range(0, 40, 2)]
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, docs, "")
    assert known.columns == docs.columns and {r[0] for r in known.collect()} == {g[0] for g in given} - {300, 301}
    once = stages["exact_dedup"](spark, known, "")
    first = {}
    for i, t in sorted((r["doc_id"], " ".join(r["text"].split())) for r in known.collect()):
        first.setdefault(t, i)
    assert once.columns == docs.columns and sorted(r[0] for r in once.collect()) == sorted(first.values())
    near = stages["ngram_jaccard"](spark, once, "")
    want = {c for _, _, c in brute_components([(r["doc_id"], r["text"]) for r in once.collect()], 5, 80, 100)}
    assert near.columns == docs.columns and {r[0] for r in near.collect()} == want
    mixed = stages["mixing"](spark, near, "")
    assert mixed.columns == docs.columns and {r[0] for r in mixed.collect()} <= want
    tokens = stages["byte_bpe"](spark, mixed, "")
    assert tokens.count() == mixed.count() > 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in mixed.collect()}


def odd_documents(spark, rows):
    """Documents with further columns whose names clash with inner ones."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id string, _doc int, _copy int, _kept string, _row int"
    return spark.createDataFrame([(*r, "i", 1, 2, "k", 3) for r in rows], schema)


def test_stages_take_odd_documents(spark):
    import corpus_pipeline

    text = {i: t for i, t, _ in synthetic_languages(60)}
    given = [(i, t, k, None if i % 7 == 0 else "s", None) for i, t, k in synthetic_languages(60)]
    given += [given[3], given[3], (None, text[4], "aa", "s", 1), (None, None, None, None, None), (70, "", "aa", "s", 0), (3, text[5], "bb", "s", 1)]
    given += [(80, (text[6] + " ") * 3000, "aa", "s", 1), (81, (text[6] + " ") * 3000 + "kami", "aa", "s", 1)]
    docs = odd_documents(spark, given)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, "")
        assert kept.columns == docs.columns, name
        found = kept.collect()
        assert {tuple(r) for r in found} <= {tuple(r) for r in docs.collect()}, name
        if name == "language_id":
            assert {r["doc_id"] for r in found} >= {80, 81, None} and all(r["text"] for r in found)
        if name == "exact_dedup":
            assert sum(r["doc_id"] == 3 for r in found) == 4 and not any(r["doc_id"] is None for r in found)
        if name == "ngram_jaccard":
            assert 81 not in {r["doc_id"] for r in found}
        docs = spark.createDataFrame(found, docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert last.count() == docs.count()


def test_stages_take_an_empty_table(spark):
    import corpus_pipeline

    docs = odd_documents(spark, [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.count() == 0 and "_copy" in docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0
