"""Version order and the interval join against plain comparisons."""

import random
import re

import pytest
from pyspark.sql import functions as F

from changelens.operators import deps as E

#: Ascending; those of one entry are equal.
ORDER = [["0", "0.0"], ["0.1-alpha"], ["0.1-beta.2"], ["0.1-beta.11"], ["0.1"], ["0.9.9"], ["1.0.dev1"], ["1.0a1"], ["1.0b1"], ["1.0-rc1", "v1.0.0-rc.1", "1rc1"], ["1.0-xyz"], ["1", "1.0", "v1.0.0", "=1.0+build.7"],
         ["1.0.post1"], ["1.0.1"], ["1.2"], ["1.10"], ["2.0.0-rc1"], ["2.0.0"], ["20240101123456"], ["20240101123456789012345678"]]


def test_order(spark):
    rows = spark.createDataFrame([(i, v) for i, same in enumerate(ORDER) for v in same] + [(-1, "latest"), (-1, None), (-1, "")], "place int, version string").withColumn("key", E.version_key(F.col("version")))
    assert rows.filter("(key IS NULL) <> (place < 0)").count() == 0
    pairs = rows.filter("place >= 0").alias("a").crossJoin(rows.filter("place >= 0").alias("b"))
    wrong = pairs.filter("(a.key < b.key) <> (a.place < b.place) OR (a.key = b.key) <> (a.place = b.place)").select("a.version", "b.version").collect()
    assert wrong == []


def test_named_cases(spark):
    uses = spark.createDataFrame([("PyPI", "p", v) for v in ("1.0", "20240101123456", "2.0.0-rc1", "latest")], "ecosystem string, name string, version string")
    ranges = spark.createDataFrame([("PyPI", "p", "A", "1.0.0", "2.0.0"), ("PyPI", "p", "B", "3.0", None), ("PyPI", "p", "C", "2.0.0", None), ("PyPI", "p", "D", "9", "3"), ("PyPI", "p", "E", "x", None), ("PyPI", "p", "F", "0", "y")],
                                   "ecosystem string, name string, id string, introduced string, fixed string")
    got = {(r.version, r.id) for r in E.affected_dependencies(uses, ranges).collect()}
    assert got == {("1.0", "A"), ("2.0.0-rc1", "A"), ("20240101123456", "B"), ("20240101123456", "C")}


@pytest.mark.parametrize("seed", [1, 2])
def test_intervals_equal_all_comparisons(spark, seed):
    rng = random.Random(seed)
    number = lambda: f"{rng.randrange(6)}.{rng.randrange(30)}.{rng.randrange(3)}"
    versions = [("PyPI", f"p{i % 3}", number(), i) for i in range(500)]
    ranges = [("PyPI", f"p{i % 3}", f"R{i}", number(), number() if i % 4 else None) for i in range(120)]
    key = lambda v: [int(x) for x in re.findall(r"\d+", v)]
    want = sorted((i, r[2]) for _, name, v, i in versions for r in ranges if r[1] == name and key(r[3]) <= key(v) and (r[4] is None or key(v) < key(r[4])))
    uses = spark.createDataFrame(versions, "ecosystem string, name string, version string, i int")
    found = E.affected_dependencies(uses, spark.createDataFrame(ranges, "ecosystem string, name string, id string, introduced string, fixed string"))
    assert sorted((r.i, r.id) for r in found.collect()) == want
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_sketched_quantiles_have_bounded_ranks(spark):
    from changelens.streaming import alerts as A

    log = spark.range(60_000).select(F.timestamp_seconds(F.col("id") % 60 * 5).alias("ts"), F.lit("/a").alias("endpoint"), ((F.col("id") * 7919) % 60_000).cast("double").alias("latency"))
    row = A.latency_sketches(log, "ts", "latency", "5 minutes", "30 seconds").filter("ends_at = timestamp_seconds(300)").first()
    for got, q in zip(row[2:], (0.5, 0.95, 0.99), strict=True):
        assert abs(got / 60_000 - q) < 3 * 1.66 / 400  # three times the bound of 99%
