import zlib

import numpy as np
from pyspark.sql import functions as F

from changelens.llm import catalog, language, quality

SF = "/root/testdata/sf0.01"
bucket = lambda i, m: zlib.crc32(str(i).encode()) % m


def test_quality_on_rows_not_learned_from(spark):
    got = {r["doc_id"]: r for r in catalog.op3_quality_classifier(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (bucket(i, 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if bucket(r["doc_id"], 3) == 1]
    assert np.mean([a == b for a, b in held]) >= 0.97
    again = {r["doc_id"]: r for r in catalog.op3_quality_classifier(spark, SF).collect()}
    assert got == again


def test_quality_odd_rows(spark, odd, empty):
    labels = odd.select("doc_id", F.when(F.col("doc_id") < 4, 0).when(F.col("doc_id") < 9, 1).alias("label"))
    for rows in (labels, labels.where("label = 1"), labels.where("label = 0"), labels.where("false")):
        model = quality.train(odd, rows)
        got = quality.score(odd, model).collect()
        assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(empty, model).collect() == []


def test_dual_coordinate_descent_solves_the_primal():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(30, 8, replace=False)) for _ in range(200)]
    y = np.array([1 if (r < 10).sum() > 2.5 else -1 for r in rows])
    scale = rng.normal(size=30)
    w, bias = quality.descend(rows, y, scale, cost=0.1, epochs=2000)
    x = np.zeros((200, 31))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / np.linalg.norm(scale[r])
    x[:, 30] = 1
    share = np.where(y > 0, (y > 0).sum(), (y < 0).sum())
    cost = 0.1 * 200 / (2 * share)
    loss = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    best = np.append(w, bias)
    for _ in range(300):
        assert loss(best) <= loss(best + rng.normal(0, 0.02, 31)) + 1e-4


def test_language_on_rows_not_learned_from(spark):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = catalog.op4_language_id(spark, SF).collect()
    assert len(got) == len(docs) and all(r["held_out"] == (bucket(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r["lang_pred"] == docs[r["doc_id"]] for r in got if r["held_out"] and docs[r["doc_id"]]]
    assert np.mean(held) >= 0.98


def test_language_odd_rows(spark, odd, empty):
    net = language.train(odd)
    got = {(r["doc_id"], r["lang_pred"]) for r in language.predict(odd, net).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (None, "und")} <= got and all(lang in ("en", "de", "und") for _, lang in got)
    nothing = language.train(empty)
    assert {r["lang_pred"] for r in language.predict(odd, nothing).collect()} == {"und"}
    assert language.predict(empty, net).collect() == []


def test_gradients_and_quick_forward():
    rng = np.random.default_rng(0)
    net = language.fit(["the cat and the dog"] * 5, ["en"] * 3 + ["de"] * 2, epochs=1)
    x = rng.integers(1, 256, (7, language.WINDOW)).astype(np.uint8)
    assert np.allclose(net.pooled(x)[0], net.largest(x), atol=1e-5)
    assert language.cut(b"").shape == (1, language.WINDOW) and len(language.cut(b"a" * 513)) == 3
