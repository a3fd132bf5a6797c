import zlib

import numpy as np
import pytest

from changelens.llm import catalog, toxicity
from tests.llm.conftest import SF

RUDE, CALM = ["vile", "rotten", "dreadful"], [f"calm{i}" for i in range(40)]


def corpus(n, seed=0):
    """Texts of many sentences; a toxic one has one or two rude sentences among calm ones."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        said = [" ".join(rng.choice(CALM, size=8)) for _ in range(int(rng.integers(2, 20)))]
        toxic = int(i % 3 == 0)
        spots = sorted(rng.choice(len(said), size=toxic * int(rng.integers(1, 3)), replace=False).tolist())
        for k in spots:
            said[k] += " " + str(rng.choice(RUDE))
        rows.append((i, ". ".join(said) + ".", toxic, spots))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = corpus(1200)
    return toxicity.fit([r[1] for r in rows], [r[2] for r in rows])


def test_gradient():
    rng = np.random.default_rng(1)
    word, sentence, document = rng.integers(0, 6, 60), np.repeat(np.arange(20), 3), np.sort(rng.integers(0, 7, 20))
    y = np.array([1, 0, 1, 0, 0, 1, 0])
    w, base, hidden = rng.uniform(0.1, 1, 6), -1.3, -0.7
    value, (gw, gb, gh) = toxicity.loss((w, base, hidden), (word, sentence, document), y)
    step = 1e-6

    def at(dw=0.0, db=0.0, dh=0.0):
        return toxicity.loss((w + dw, base + db, hidden + dh), (word, sentence, document), y)[0]

    for k in range(6):
        e = np.eye(6)[k] * step
        assert abs((at(e) - at(-e)) / (2 * step) - gw[k]) < 1e-6
    assert abs((at(db=step) - at(db=-step)) / (2 * step) - gb) < 1e-6 and abs((at(dh=step) - at(dh=-step)) / (2 * step) - gh) < 1e-6
    assert value > 0


def test_noisy_or_of_the_sentences(model):
    text = "calm1 vile. calm2 calm3! Rotten calm4\ncalm5"
    each = [-np.expm1(-model.evidence(words)) for _, _, words in toxicity.sentences(text)]
    score, worst, start, end = model.judge(text)
    assert abs(score - (1 - (1 - model.leak) * np.prod([1 - p for p in each]))) < 1e-12 and len(each) == 4
    assert abs(worst - max(each)) < 1e-12 and text[start:end].strip() in ("calm1 vile.", "Rotten calm4")
    assert model.judge(None) == model.judge("") == model.judge(" .. \n")


def test_held_out_texts_and_their_sentences(model):
    for _, text, toxic, spots in corpus(600, seed=9):
        score, worst, start, end = model.judge(text)
        assert (score >= 0.7) == bool(toxic)
        if toxic:
            found = [(a, b) for a, b, words in toxicity.sentences(text) if -np.expm1(-model.evidence(words)) >= 0.5]
            assert found == [list(toxicity.sentences(text))[k][:2] for k in spots] and (start, end) in found
    # long texts without evidence stay clean
    assert model.judge(". ".join(" ".join(CALM) for _ in range(20_000)))[0] < 0.3


def test_query(spark, documents):
    got = {r["doc_id"]: r for r in catalog.op13_toxicity(spark, SF).collect()}
    assert len(got) == len(documents)
    for r in documents:
        own = got[r["doc_id"]]
        assert 0 <= own["score"] <= 1 and own["predicted"] == int(own["score"] >= 0.7) and own["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        # a copy of a text scores as the text does, and the place of its worst sentence is within it
        assert own["worst_end"] is None or 0 <= own["worst_start"] < own["worst_end"] <= len(r["text"])


def test_held_out_documents(spark):
    folder = SF.replace("0.001", "0.1")
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [(r, marks[r["doc_id"]]) for r in catalog.op13_toxicity(spark, folder).where("held_out").collect() if r["doc_id"] in marks]
    hit = sum(r["predicted"] for r, y in rows if y == 1)
    false = sum(r["predicted"] for r, y in rows if y == 0)
    assert hit >= 0.7 * sum(y == 1 for _, y in rows) and false <= 0.01 * sum(y == 0 for _, y in rows)


def test_training_in_spark_equals_the_plain_fit(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows] + [(1000, rows[0][1]), (1001, "x" * 20_000), (1002, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y, _ in rows] + [(1000, 1), (1001, 1), (1002, 0), (5, 7), (None, 1)], "doc_id long, label int")
    got = toxicity.train(docs, labels)
    want = toxicity.fit(*zip(*sorted((t, y) for _, t, y, _ in rows), strict=True))
    assert got.weights.keys() == want.weights.keys() and abs(got.base - want.base) < 1e-6
    few = toxicity.train(docs, labels, sample=60)
    assert few.weights != want.weights


def test_odd_rows(spark, odd, empty, model):
    named = odd.withColumn("score", odd["size"]).withColumn("told", odd["size"]).withColumn("worst", odd["size"]).withColumn("turn", odd["size"]).withColumn("label", odd["size"])
    got = toxicity.score(named, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got) and "told" in got[0].asDict()
    assert toxicity.score(empty, model).collect() == [] and toxicity.offending(odd, model).collect() == []
    labels = odd.select("doc_id", "size").withColumnRenamed("size", "label")
    toxicity.train(named, labels)
    assert toxicity.train(empty, labels).judge("a")[0] == 0 and toxicity.train(named, labels.where("label = 1")).judge("a")[0] > 0.9
    rude = spark.createDataFrame([(1, "calm1. So vile calm2! End"), (None, None)], "doc_id long, text string")
    assert [(r["doc_id"], r["start"], r["end"], r["sentence"]) for r in toxicity.offending(rude, model).collect()] == [(1, 6, 21, " So vile calm2!")]
