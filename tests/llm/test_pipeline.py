"""The pipeline's stages on a small corpus, each on what the one before kept."""

import random

import pytest

import corpus_pipeline
from quillspark.llm import queries


def test_stages(spark):
    rng = random.Random(6)
    words = "the and that with this from have which were their".split()
    line = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    shared = line(60)
    rows = [(i, f"{line(30)}\n{line(25)}", "en", f"s{i % 3}") for i in range(60)]
    rows += [(100, rows[0][1], "en", "s1"), (101, "123 456", "en", "s1"), (102, None, None, None), (103, f"{line(40)}\n{shared}", "en", "s0"), (104, f"{line(40)}\n{shared}", "en", "s2"), (7, rows[7][1], "en", "s1")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    a = stages["language_id"](spark, docs, "")
    assert a.columns == docs.columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in a.collect()} == {101, 102}
    b = stages["simhash"](spark, a, "")
    assert b.columns == docs.columns and sorted(r.doc_id for r in b.collect()) == [*range(60), 103, 104]
    c = stages["substring_dedup"](spark, b, "")
    texts = {r.doc_id: r for r in c.collect()}
    assert c.columns == docs.columns and shared in texts[103].text and shared not in texts[104].text
    assert texts[104].n_chars == len(texts[104].text) and texts[5].text == rows[5][1]
    d = stages["mixing"](spark, c, "")
    assert d.columns == docs.columns and 0 < d.count() <= 3 * c.count()
    e = stages["packing"](spark, d, "")
    assert e.count() == d.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), "").count() == 0, name


def test_rows_of_one_id_with_different_texts(spark):
    rng = random.Random(8)
    line = lambda n: " ".join(rng.choice("abcdefgh") * 2 + str(rng.randrange(99)) for _ in range(n))
    a, b, c, d, e, repeated = line(40), line(40), line(40), line(40), line(40), line(20)
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, c), (3, d), (3, d), (None, a)], "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()), key=lambda x: (x[0] or 0, x[1]))
    assert kept == [(None, a), (1, a), (2, b), *sorted([(3, c), (3, d)])]
    other = line(20)
    docs = spark.createDataFrame([(1, repeated), (2, f"{repeated}\nx"), (2, f"{other}\ny")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()) == sorted([(1, repeated), (2, "x"), (2, f"{other}\ny")])


def test_every_operator_has_one_query():
    names = [n.split("_")[0] for n in queries.queries()]
    assert sorted(names) == sorted(f"op{n}" for n in range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", ["language_id", "simhash", "substring_dedup", "mixing", "packing"])
def test_stage_names(name):
    assert name in dict(corpus_pipeline.STAGES)


def test_stages_with_hard_rows(spark):
    """Nulls in any column, empty and very long texts, ties and repeated rows, through every stage."""
    rng = random.Random(10)
    words = "the and that with this from have which were their".split()
    text = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    long, same = text(120_000), text(60)
    rows = [(i, text(60), "en", "s0") for i in range(40)]
    rows += [(50, long, "en", "s1"), (51, same, None, None), (51, same, None, None), (52, same, "en", None), (None, text(40), "en", "s1"), (None, None, None, None), (53, None, "en", "s1"), (54, "", "en", "s0"), (55, "the", "en", "s1"), (56, "the", "en", "s1")]
    docs = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept, wanted = docs, [
        lambda ids: ids == [None, *range(40), 50, 51, 51, 52, 55, 56],
        lambda ids: ids == [None, *range(40), 50, 51, 55],
        lambda ids: ids == [None, *range(40), 50, 51, 55],
        lambda ids: set(ids) <= {None, *range(40), 50, 51, 55} and len(ids) > 0,
        lambda ids: len(ids) > 0,
    ]
    for (name, stage), fine in zip(corpus_pipeline.STAGES, wanted):
        out = stage(spark, kept, "")
        ids = sorted((r.doc_id for r in out.select("doc_id").collect()), key=lambda i: (i is not None, i or 0))
        assert fine(ids), (name, ids)
        if name == "substring_dedup":
            assert {r.doc_id: r.text for r in out.collect()}[50] == long
        kept = out.checkpoint() if name != "packing" and spark.sparkContext.getCheckpointDir() else out


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, name):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, extra int")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
    assert out.count() == 0
    assert name == "packing" or out.columns == docs.columns
