import sentencepiece
import public_tokenizers
import pytest

import corpus_pipeline
from changelens.llm import catalog, quality
from changelens.llm.pseudonyms import Feistel, Pseudonyms
from changelens.session import materialize
from tests.llm.conftest import SF
from tests.llm.test_simhash import plain_components, plain_fingerprint


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name.replace(" ", "-"))
        out.append(docs)
    return out


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[1:-1])


def test_each_stage_against_its_input(spark, steps):
    rows = [[r.asDict() for r in s.collect()] for s in steps]
    model = catalog.quality_model(spark, steps[0], SF)
    assert sorted(r["doc_id"] for r in rows[1]) == sorted(r["doc_id"] for r in rows[0] if model.score(r["text"]) >= 0.5)
    found = plain_components([(r["doc_id"], plain_fingerprint(r["text"])) for r in rows[1]])
    assert sorted(r["doc_id"] for r in rows[2]) == sorted({c for _, _, c in found})
    names = Pseudonyms(Feistel(catalog.KEY))
    assert {r["doc_id"]: r["text"] for r in rows[3]} == {r["doc_id"]: names.replace(r["text"])[0] for r in rows[2]}
    assert all(r["n_chars"] == len(r["text"]) for s in rows[3:5] for r in s)
    words = lambda rs: sum(len(r["text"].split()) for r in rs)
    assert abs(words(rows[4]) / words(rows[3]) - 1.5) < 0.01
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((r["doc_id"], library.encode(r["text"], add_eos=True)) for r in rows[4])
    assert sorted((r["doc_id"], r["ids"]) for r in rows[5]) == want


def test_odd_rows(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, SF), "odd")
            assert docs.columns == odd.columns
        assert docs.count() == corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()
    assert quality.score(empty, quality.train(empty, empty.selectExpr("doc_id", "1 as label"))).count() == 0
