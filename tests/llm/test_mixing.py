import itertools
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from changelens.llm import catalog, mixing
from tests.llm.conftest import SF

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """Shares by weight; what is above a cap is shared again among the others until nothing is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = dict(zip(names, itertools.cycle((3, 1, 2)), strict=False))
    total, done = Fraction(3, 2) * sum(sizes.values()), {}
    while len(done) < len(names):
        free = [n for n in names if n not in done]
        level = (total - sum(done.values())) / sum(weight[n] for n in free)
        above = [n for n in free if level * weight[n] > 2 * sizes[n]]
        done |= {n: Fraction(2 * sizes[n]) for n in above} if above else {n: level * weight[n] for n in free}
    return {n: float(t) for n, t in done.items()}


def check(rows, got):
    size = Counter()
    for r in rows:
        size[r["source"]] += len(WORDS.findall(r["text"] or ""))
    want = plain_targets(dict(size))
    assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted((r["doc_id"], len(WORDS.findall(r["text"] or ""))) for r in rows if r["doc_id"] is not None)
    taken = Counter()
    by_source = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_source.setdefault((r["source_size"], round(r["target"], 6)), 0)
        by_source[r["source_size"], round(r["target"], 6)] += r["taken"]
        taken[r["target"]] += r["taken"]
    assert set(by_source) == {(size[s], round(want[s], 6)) for s in want}
    return by_source


def test_query(spark, documents):
    got = catalog.op5_mixing(spark, SF).collect()
    for (_, target), words in check(documents, got).items():
        assert target <= words < target + 1.001
    assert sorted(map(tuple, got)) == sorted(map(tuple, catalog.op5_mixing(spark, SF).collect()))


@pytest.mark.parametrize("shard_words", [50, 700, 1 << 40])
def test_odd_rows_and_many_shards(spark, odd, shard_words):
    got = mixing.mix(odd, block=4, shard_words=shard_words).collect()
    assert len(got) == odd.count()
    check(odd.collect(), got)


def test_empty(spark, empty):
    assert mixing.mix(empty).collect() == [] and mixing.mixed(empty).collect() == []


def test_shards_hold_disjoint_blocks_and_exact_quotas(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, _ = mixing.numbered(docs, "doc_id", "text", "source", 16, 1, payload=False)
    rows = mixing.materialize(rows, "numbered")
    parts = mixing.dealt(rows, 16, 10_000, 1).collect()
    seen = {}
    for p in parts:
        seen.setdefault(p["skey"], []).append((p["part_from"], p["part_to"]))
    for spans in seen.values():  # every block that is given lies in one shard
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    shards = Counter()
    for p in parts:
        shards[p["shard"]] += p["part_to"] - p["part_from"]
    assert len(shards) > 8 and max(shards.values()) - min(shards.values()) <= 8


def test_splitting_draws_the_hypergeometric_distribution(spark):
    rows = spark.range(20_000).select(((F.xxhash64("id").bitwiseAND(F.lit((1 << 53) - 1)) + 0.5) / float(1 << 53)).alias("u"))
    got = rows.select(mixing.hypergeometric(F.lit(60), F.lit(20), F.lit(25), F.col("u")).alias("k")).groupBy("k").count().collect()
    from math import comb

    for r in got:
        p = comb(20, r["k"]) * comb(40, 25 - r["k"]) / comb(60, 25)
        assert abs(r["count"] / 20_000 - p) < 0.015
    edge = spark.createDataFrame([(5, 5, 3, 3), (5, 0, 3, 0), (0, 0, 0, 0), (7, 7, 7, 7), (10**12, 10**12 - 1, 10**12, 10**12 - 1)], "t long, m long, d long, want long")
    assert all(r["k"] == r["want"] for r in edge.select(mixing.hypergeometric(F.col("t"), F.col("m"), F.col("d"), F.lit(0.37)).alias("k"), "want").collect())


def test_mixed_documents(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    whole = {r["doc_id"]: r for r in documents}
    times, cut, words = Counter(), set(), Counter()
    for r in out.collect():
        times[r["doc_id"]] += 1
        words[r["doc_id"]] += len(WORDS.findall(r["text"]))
        if r["text"] != whole[r["doc_id"]]["text"]:
            assert whole[r["doc_id"]]["text"].startswith(r["text"])
            cut.add(r["doc_id"])
    assert max(times.values()) <= 2 and len(cut) <= len({r["source"] for r in documents})
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect() if r["taken"]} == dict(words)


def test_mixed_odd_rows(spark, odd):
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and out.count() > 0
