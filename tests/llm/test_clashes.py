"""Columns of the documents that are called like inner ones, letters, mail addresses, keys."""

import pytest

import corpus_pipeline
from changelens.llm import catalog, language, pseudonyms, quality, simhash
from tests.llm.conftest import SF

INNER = ("_done", "done", "row", "_row", "key", "_score", "score", "score_", "found", "told", "first", "id", "text_hash", "label", "turn", "root", "fp", "component_id")


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, "a b c d e f", "en", "x", 11), (2, "a b c d e f", "en", "x", 11), (3, None, None, None, None), (None, "mail bob.smith@example.org today", "en", "y", 32)]
    return spark.createDataFrame([(*r, *[7] * len(INNER)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in INNER))


def test_stages_keep_every_column(spark, clashing):
    for name, stage in corpus_pipeline.STAGES[:3]:
        got = stage(spark, clashing, SF)
        assert got.columns == clashing.columns, name
        assert all(r[c] == 7 for r in got.collect() for c in INNER), name


def test_operators_keep_every_column(spark, clashing):
    done = pseudonyms.pseudonymize(clashing, b"k", found_col="spans")
    assert done.columns == [*clashing.columns, "spans"] and done.count() == 4
    assert simhash.keep_one(clashing).columns == clashing.columns and simhash.keep_one(clashing).count() == 3
    assert quality.score(clashing, quality.train(clashing, clashing.select("doc_id", "label")), score_col="new").columns == [*clashing.columns, "new"]


@pytest.mark.parametrize("text,want", [("½ ² ① Ⅷ", False), ("12 _ ?!", False), ("", False), (None, False), ("1 ß", True), ("ª", True), ("語", True)])
def test_letters(spark, text, want):
    assert language.has_letter(text) == want
    assert bool(spark.createDataFrame([(text,)], "t string").selectExpr("coalesce(t rlike '[\\\\p{L}]', false)").first()[0]) == want


def test_long_local_parts_go_whole():
    names = pseudonyms.Pseudonyms(pseudonyms.Feistel(b"k"))
    long = "abc.def-" * 12 + "x1"
    text, found = names.replace(f"to {long}@example.org, or bob@example.org")
    assert [(kind, b - a) for kind, a, b in found] == [("email", len(long) + 12), ("email", 15)] and long[:20] not in text
    assert names.replace("a" * 200_000)[0] == "a" * 200_000  # read once, not from every place


def test_key_from_the_session(spark, clashing):
    before = [r["text"] for r in catalog.pseudonymized(clashing).orderBy("doc_id").collect()]
    spark.conf.set("spark.changelens.pseudonymKey", "another")
    try:
        assert [r["text"] for r in catalog.pseudonymized(clashing).orderBy("doc_id").collect()] != before
    finally:
        spark.conf.unset("spark.changelens.pseudonymKey")


def test_repeated_ids_give_one_text_each(spark):
    docs = spark.createDataFrame([(i % 10, f"{'good' if i % 2 else 'bad'} text {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, label int")
    assert quality.train(docs, labels, sample=10).score("good text 1") > 0.5
