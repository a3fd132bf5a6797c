"""Alarms on streams: transitions in the order of event times, timers without rows, state that ends."""

import pytest
from pyspark.sql import functions as F

from changelens.session import work_dir
from changelens.streaming import alarms as M
from changelens.streaming import alerts as A


def told(spark, batches, build, schema):
    """Transitions after each batch, one file a batch: {(state, pending second, second)} of the keys that are not null."""
    path, out = work_dir(spark, "in"), work_dir(spark, "out")
    transitions = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path + "/n=*"))
    checkpoint, seen = work_dir(spark, "state"), []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/n={i}")
        M.start(transitions, out, checkpoint).awaitTermination()
        got = spark.read.schema(transitions.schema).parquet(out).filter("k IS NOT NULL").select("k", "state", F.unix_seconds("pending_from").alias("p"), F.unix_seconds("at").alias("a")).collect()
        seen.append(sorted(((r.k, r.state, r.p, r.a) for r in got), key=lambda r: (r[0], r[3], r[1])))
    return seen


def stamped(rows):
    return rows.withColumn("ts", F.timestamp_seconds("s")).withWatermark("ts", "0 seconds")


def test_a_gauge_fires_without_a_new_row_and_resolves_at_the_next(spark):
    build = lambda s: M.watch(stamped(s), 300, lambda part, _: part is not None and part > 5, ["k"], None, "ts")
    seen = told(spark, [[("a", 0, 9.0, None), ("b", 10, 1.0, None)], [(None, 400, 0.0, None)], [("a", 500, 2.0, None)], [(None, 900, 0.0, None)]], build, "k string, s long, part double, whole double")
    assert ("a", "firing", 0, 300) in seen[1]  # only another key's row has moved the time
    assert [r[1] for r in seen[3]] == ["pending", "firing", "resolved"] and seen[3][-1] == ("a", "resolved", 0, 500)


def test_rows_of_a_batch_in_any_order(spark):
    rows = [("a", t, 9.0, None) for t in (60, 0, 90, 30, 120)] + [("a", 240, 9.0, None), ("a", 150, 0.0, None)]
    build = lambda s: M.watch(stamped(s), 100, lambda part, _: part is not None and part > 5, ["k"], 30, "ts")
    seen = told(spark, [rows, [(None, 1000, 0.0, None)]], build, "k string, s long, part double, whole double")
    assert seen[1] == [("a", "pending", 0, 0), ("a", "firing", 0, 100), ("a", "resolved", 0, 120), ("a", "inactive", 240, 240), ("a", "pending", 240, 240)]


@pytest.mark.parametrize("gap", [None, 4])
def test_a_missing_evaluation_ends_a_rate(spark, gap):
    rows = [("a", 30 * i, 9.0, None) for i in range(11) if i != gap]
    build = lambda s: M.watch(stamped(s), 300, lambda part, _: part is not None and part > 5, ["k"], 30, "ts")
    seen = told(spark, [rows[:6], rows[6:], [(None, 5000, 0.0, None)]], build, "k string, s long, part double, whole double")
    batch = A.sustained(spark.createDataFrame(rows, "k string, s long, part double, whole double").withColumn("ends_at", F.timestamp_seconds("s")), F.lit(True), 300, keys=["k"]).count()
    assert sum(r[1] == "firing" for r in seen[2]) == batch == (0 if gap else 1)
    assert sum(r[1] in ("resolved", "inactive") for r in seen[2]) == (2 if gap else 1)


def test_state_ends_with_the_condition(spark):
    path, out = work_dir(spark, "in"), work_dir(spark, "out")
    for i, rows in enumerate([[(k, 0, 9.0, None) for k in range(50)], [(k, 60, 0.0, None) for k in range(50)], [(-1, 4000, 0.0, None)], [(-1, 8000, 0.0, None)]]):
        spark.createDataFrame(rows, "k long, s long, part double, whole double").coalesce(1).write.parquet(f"{path}/n={i}")
    stream = spark.readStream.schema("k long, s long, part double, whole double").option("maxFilesPerTrigger", 1).parquet(path + "/n=*")
    run = M.start(M.watch(stamped(stream), 300, lambda part, _: part is not None and part > 5, ["k"], 30, "ts"), out, work_dir(spark, "state"))
    run.awaitTermination()
    metrics = run.lastProgress["stateOperators"][0]
    assert metrics["numRowsTotal"] <= 4, metrics  # of fifty keys nothing is left; the last row still waits
