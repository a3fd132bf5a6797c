"""Metric cells and stored postings against comparing everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from changelens.operators import cells as C
from changelens.operators import postings as P
from changelens.operators import search as V
from changelens.session import work_dir
from changelens.sources import views

SF = "/root/testdata/sf0.01"


def brute(rows, queries, k):
    unit = lambda v: np.array(v, float) / np.linalg.norm(v)
    out = {}
    for q, v in queries:
        scores = sorted((-round(float(unit(v) @ unit(r)), 12), key) for key, r in rows)[:k]
        out[q] = [key for _, key in scores]
    return out


def told(df, key="key"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["q"], r["rank"])):
        out.setdefault(r["q"], []).append(r[key])
    return out


@pytest.mark.parametrize("pivots,block", [(1, 7), (12, 10_000), (40, 16)])
def test_cells_equal_all_comparisons(spark, pivots, block):
    rng = np.random.default_rng(pivots)
    centres = rng.normal(size=(9, 12))
    rows = [(i, (centres[i % 9] + 0.2 * rng.normal(size=12)).tolist()) for i in range(400)] + [(1000 + i, centres[0].tolist()) for i in range(30)]
    queries = [(i, (centres[i % 9] + 0.3 * rng.normal(size=12)).tolist()) for i in range(25)] + [(99, centres[0].tolist())]
    odd = [(5000, None), (5001, [0.0] * 12), (5002, [float("nan")] * 12), (5003, [1.0, 2.0])]
    path = work_dir(spark, "cells")
    C.write_cells(spark.createDataFrame(rows + odd, "key long, v array<double>"), path, "key", "v", pivots=pivots, sample=64, block=block)
    asked = spark.createDataFrame(queries + [(200, None), (201, [0.0] * 12), (202, [1.0])], "q long, v array<double>")
    assert told(C.nearest_in_cells(path, asked, "key", "q", "v", 4)) == brute(rows, queries, 4)


def test_cells_leave_most_pairs_out(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16))
    rows = spark.createDataFrame([(i, (centres[i % 60] + 0.05 * rng.normal(size=16)).tolist()) for i in range(3000)], "key long, v array<double>")
    path = work_dir(spark, "cells")
    C.write_cells(rows, path, "key", "v", pivots=60)
    assert C.share_read(path, rows.filter("key % 100 = 0").withColumnRenamed("key", "q"), "key", "q", "v") < 0.1


def test_fewer_rows_than_asked_for(spark):
    path = work_dir(spark, "cells")
    C.write_cells(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "key long, v array<double>"), path, "key", "v")
    asked = spark.createDataFrame([(7, [1.0, 0.1])], "q long, v array<double>")
    assert told(C.nearest_in_cells(path, asked, "key", "q", "v", 5)) == {7: [1, 2]}


@pytest.fixture(scope="module")
def corpus(spark):
    return views.table(spark, SF, "documents").select("doc_id", "text")


def test_postings_written_in_parts_score_like_the_corpus(spark, corpus):
    path, terms = work_dir(spark, "postings"), ["the", "and", "Que", "die", "nowhere"]
    for part in range(3):
        P.write_postings(corpus.filter(F.col("doc_id") % 3 == part), path, "doc_id", "text", 16, 20)
    want = {r["doc_id"]: round(r["bm25"], 9) for r in V.keyword_scores(corpus, terms, "text").filter("bm25 <> 0").collect()}
    got = {r["key"]: round(r["bm25"], 9) for r in P.keyword_matches(spark, path, terms, 16).filter("bm25 <> 0").collect()}
    assert got == want and len(got) > 100
    best = sorted(((-s, d) for d, s in want.items() if s > 0))[:15]
    assert [(r["key"], round(r["bm25"], 9)) for r in P.top_keywords(spark, path, terms, 15, 16).collect()] == [(d, -s) for s, d in best]


def test_a_search_opens_few_blocks_and_reads_its_own_words(spark):
    path = work_dir(spark, "postings")
    rows = spark.range(6000).select("id", F.concat(F.lit("common filler "), F.when(F.col("id") % 1500 == 0, F.repeat(F.lit("rare "), 6)).otherwise(F.concat(F.lit("w"), F.col("id") % 50))).alias("text"))
    P.write_postings(rows, path, "id", "text", 16, 64)
    report = {}
    got = [r["key"] for r in P.top_keywords(spark, path, ["rare", "common"], 4, 16, report).collect()]
    assert got == [0, 1500, 3000, 4500] and report["opened"] < 0.2 * report["blocks"]
    plan = P._blocks(spark, path, ["rare"], 16)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "rare" in plan.split("PushedFilters: ")[1].split("]")[0]


def test_postings_are_whole_over_many_slices_and_repeated_keys(spark, monkeypatch):
    monkeypatch.setattr(P, "SLICE", 50)
    rows = [(f"k{i}", "common " * (i % 4 + 1) + f"word{i % 7} Rare{i}") for i in range(300)] + [("k5", "common common word5 rare5"), (None, "common x"), ("e", ""), ("n", None)]
    path = work_dir(spark, "postings")
    P.write_postings(spark.createDataFrame(rows, "key string, content string"), path, "key", "content", 4, 16)
    want = {}
    for key, text in rows:
        words = (text or "").lower().split()
        for w in set(words):
            want[w, key, len(words)] = want.get((w, key, len(words)), 0) + words.count(w)
    blocks = spark.read.parquet(f"{path}/blocks")
    got = blocks.select("word", F.explode("rows").alias("r")).select("word", "r.key", "r.len", "r.tf").collect()
    assert len(got) == len(want) and {(r.word, r.key, r.len): r.tf for r in got} == want
    told = blocks.select("most", "shortest", "n", "rows").collect()
    assert all(b.most == max(r.tf for r in b.rows) and b.shortest == min(r.len for r in b.rows) and b.n == len(b.rows) for b in told)
    assert tuple(spark.read.parquet(f"{path}/totals").agg(F.sum("n"), F.sum("words")).first()) == (304, sum(len((t or "").split()) for _, t in rows))
