"""Streams give the batch result; replays change nothing."""

import pytest
from pyspark.sql import functions as F

from changelens.plans import stream_queries as Q
from changelens.session import work_dir
from changelens.sources import views as V
from changelens.streaming import alerts as A
from changelens.streaming import events as E
from changelens.streaming import state as S

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_folds_merge_in_any_grouping(spark):
    accepted = E.gate(Q._events(spark, SF))[0]
    parts = [E.fold(accepted.filter(F.col("seq") % 3 == i)) for i in range(3)]
    merged = E.merge_folds(parts[2].unionByName(parts[0]).unionByName(parts[1]).unionByName(parts[0]))
    assert rows(merged.select(sorted(merged.columns))) == rows(E.fold(accepted).select(sorted(merged.columns)))


def test_replay_leaves_the_table_unchanged(spark):
    folds = E.fold(E.gate(Q._events(spark, SF))[0])
    once = E.upsert(Q.stored_prs(spark, SF), folds)
    assert rows(E.upsert(once, folds)) == rows(once)


def test_absent_keys_keep_and_null_values_replace(spark):
    base = spark.createDataFrame([("r", 1, "old", "me", "main", "h", None, None, "text", 5, 5, 5, "completed", 0.4, 10)],
                                 "repo_full_name string, pr_number int, title string, author string, base_branch string, head_branch string, diff_url string, html_url string, body string, "
                                 "files_changed int, additions int, deletions int, status string, risk_score double, applied_seq bigint")
    head = '"event_type":"pull_request","repo_full_name":"r","pr_number":1'
    messages = spark.createDataFrame([
        (11, '{%s,"action":"opened","body":null,"files_changed":null}' % head), (12, '{%s,"action":"opened","pr_title":"new"}' % head), (9, '{%s,"action":"synchronize"}' % head)],
        "seq bigint, value string").withColumn("ts", F.current_timestamp())
    row = E.upsert(base, E.fold(E.gate(E.parse(messages))[0])).first()
    assert (row.title, row.author, row.body, row.files_changed, row.additions) == ("new", "me", None, 0, 5)
    # the synchronize event is older than what the row already holds
    assert (row.status, row.risk_score, row.applied_seq) == ("completed", 0.4, 12)


def test_scan_stream_matches_batch(spark):
    path, schema = Q._message_files(spark, SF)
    changes = V.changes(spark, SF).withColumn("pr_number", F.col("pr_number").cast("int"))
    out = work_dir(spark, "scan")
    E.scan_stream(E.read_messages(spark, path, schema, 100), changes, Q._secrets, out, work_dir(spark, "scan-state"), ["pr_number"]).awaitTermination()
    batch = Q.QUERIES["t3_incremental_scan"](spark, SF).withColumn("pr_number", F.col("pr_number").cast("int"))
    assert rows(spark.read.parquet(out).select("pr_number", "rule_id", "findings")) == rows(batch.select("pr_number", "rule_id", "findings"))


def test_progress_stream_in_update_mode(spark):
    feed = Q.feed(spark, SF)
    path = work_dir(spark, "feed")
    for i in range(3):  # the feed delivers in order, so one file is written after the other
        feed.filter(F.floor(F.col("seq") / 340) == i).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(path)
    run = E.progress_stream(stream).writeStream.format("memory").queryName("progress_feed").outputMode("update").option("checkpointLocation", work_dir(spark, "feed-state")).trigger(availableNow=True).start()
    run.awaitTermination()
    # the last update of each key is the state of the feed
    updates = sorted(map(tuple, spark.table("progress_feed").select("pr_id", "steps", "findings", "complete", "last_seq").collect()), key=lambda r: r[-1])
    final = {row[0]: row for row in updates}
    assert sorted(final.values(), key=repr) == rows(E.progress(feed))


def test_late_rows_are_dropped(spark):
    path = work_dir(spark, "late")
    for i, at in enumerate(["2024-01-01 10:00:00", "2024-01-01 12:00:00", "2024-01-01 12:10:00", "2024-01-01 10:00:10", "2024-01-01 14:00:00"]):
        spark.sql(f"SELECT TIMESTAMP '{at}' AS ts, 500 AS status_code").coalesce(1).write.mode("append").parquet(f"{path}/n={i}")
    out = work_dir(spark, "late-out")
    stream = spark.readStream.schema("ts timestamp, status_code int, n int").option("maxFilesPerTrigger", 1).parquet(path)
    hourly = A.hourly(stream, "ts")
    hourly.writeStream.format("parquet").option("path", out).option("checkpointLocation", work_dir(spark, "late-state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    counts = {str(r.ends_at): r.n for r in spark.read.schema(hourly.schema).parquet(out).collect()}
    assert counts["2024-01-01 11:00:00"] == 1


@pytest.mark.parametrize("gap,want", [(None, 1), (4, 0)])
def test_sustained_needs_an_unbroken_run(spark, gap, want):
    times = [i * 30 for i in range(11) if i != gap]
    evaluated = spark.createDataFrame([(t,) for t in times], "s bigint").select(F.timestamp_seconds("s").alias("ends_at"), F.lit(0.9).alias("ratio"))
    assert A.sustained(evaluated, F.col("ratio") > 0.5, 300).count() == want


def test_quantile_beyond_the_last_bound(spark):
    df = spark.createDataFrame([(0, 0, 10)], "b0 int, b1 int, total int")
    assert df.select(A.histogram_quantile(0.95, ["b0", "b1", "total"], [1.0, 2.0])).first()[0] == 2.0


def test_a_gauge_keeps_its_value_without_new_rows(spark):
    rows = spark.createDataFrame([("q", 0, 60), ("q", 1980, 10), ("r", 0, 60)], "queue string, s bigint, waiting int").withColumn("ends_at", F.timestamp_seconds("s"))
    until = F.timestamp_seconds(F.lit(600))
    assert [(r.queue, r.firing_to.timestamp()) for r in A.lasting(rows, F.col("waiting") > 50, 900, ["queue"], until=until).collect()] == [("q", 1980.0)]
    assert A.lasting(rows, F.col("waiting") > 50, 600, ["queue"], until=until).count() == 2


def test_latency_beyond_the_threshold_can_be_told(spark):
    log = spark.range(100).select(F.timestamp_seconds(F.col("id") * 10).alias("ts"), F.lit("/a").alias("endpoint"), F.lit(45.0).alias("latency"))
    assert A.latency_quantiles(log, "ts", "latency").filter("p95 <= 30").count() == 0
    assert A.latency_alert(log, "ts", "latency").count() == 1


@pytest.mark.parametrize("q", [0.5, 0.95])
def test_bucket_quantiles_are_near_the_exact_ones(spark, q):
    log = spark.range(5000).select(F.timestamp_seconds(F.lit(0)).alias("ts"), F.lit("/a").alias("endpoint"), F.exp(F.col("id") % 1000 / 150).alias("latency"))
    exact = log.select(F.percentile("latency", q)).first()[0]
    got = A.latency_quantiles(log, "ts", "latency", "30 seconds", quantiles=(q,)).first()[2]
    bounds = [0.0, *A.ALERT_BOUNDS]
    low = max(b for b in bounds if b <= exact)
    assert low <= got <= min(b for b in bounds if b > exact)


def test_incremental_scan_reads_only_the_folders_of_its_keys(spark):
    stored = work_dir(spark, "changes")
    E.write_changes(V.changes(spark, SF).withColumn("pr_number", F.col("pr_number").cast("int")), stored, ["pr_number"], 16)
    found = E.incremental_scan(Q._events(spark, SF).filter("seq < 3"), spark.read.parquet(stored), lambda c: c.select("pr_number"), ["pr_number"], 16)
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()


def test_published_records_come_back(spark):
    path = work_dir(spark, "topic")
    records = spark.createDataFrame([("a:1", "{}"), ("b:2", "[]")], "key string, value string")
    E.publish(records, "parquet", path=path)
    assert sorted((bytes(r.key).decode(), bytes(r.value).decode()) for r in spark.read.parquet(path).collect()) == [("a:1", "{}"), ("b:2", "[]")]


def _message_rows(spark):
    """Messages of two pull requests, of which one comes twice and two are not for the table."""
    head = '"event_type":"pull_request","repo_full_name":"r","pr_number"'
    rows = [(1, '{%s:1,"action":"opened","pr_title":"a","body":null,"additions":null}' % head), (2, '{%s:1,"action":"synchronize","pr_author":"me"}' % head),
            (2, '{%s:1,"action":"synchronize","pr_author":"me"}' % head), (3, '{%s:2,"action":"opened","html_url":"u","deletions":4}' % head),
            (4, '{%s:2,"action":"closed","pr_title":"b"}' % head), (5, "no json"), (6, None)]
    return spark.createDataFrame(rows, "seq bigint, value string").withColumns({"ts": F.timestamp_seconds(F.lit(0)), "key": F.lit("k")})


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_fold_keeps_which_keys_each_event_has(spark):
    found = {r.pr_number: r for r in E.fold(E.gate(E.parse(E.deduplicate(_message_rows(spark))))[0]).collect()}
    one, two = found[1], found[2]
    assert len(found) == 2 and (one.first_seq, one.last_seq, one.sync_seq, two.first_seq, two.last_seq, two.sync_seq) == (1, 2, 2, 3, 3, None)
    assert (one.title, one.title_seq, one.author, one.author_seq, one.body, one.body_seq, one.additions, one.additions_seq) == ("a", 1, "me", 2, None, 1, None, 1)
    assert (two.html_url, two.html_url_seq, two.deletions, two.deletions_seq, two.title_seq, two.body_seq) == ("u", 3, 4, 3, None, None)


@pytest.mark.parametrize("step", ["deduplicate", "fold"])
def test_rows_of_a_file_are_spread_before_they_are_sorted(spark, step):
    path = work_dir(spark, "one-file")
    _message_rows(spark).coalesce(1).write.parquet(path)
    messages = spark.read.parquet(path)
    plan = _plan(E.deduplicate(messages) if step == "deduplicate" else E.fold(E.gate(E.parse(messages))[0]))
    # the plan is a chain, the scan last
    assert "Sort [" in plan and plan.rindex("Sort [") < plan.rindex("Exchange hashpartitioning(seq")
    assert "present" not in plan.partition("Exchange hashpartitioning(seq")[0]


@pytest.mark.parametrize("run", ["folds", "table"])
def test_a_batch_is_parsed_after_its_messages_are_spread(spark, monkeypatch, run):
    path, plans, fold = work_dir(spark, "messages"), [], E.fold

    def seen(events):
        plans.append(_plan(fold(events)))
        return fold(events)

    monkeypatch.setattr(E, "fold", seen)
    messages = _message_rows(spark)
    messages.coalesce(1).write.parquet(path)
    stream = E.read_messages(spark, path, messages.schema)
    prs = spark.createDataFrame([("r", 3, *[None] * 7, 1, 1, 1, "completed", 0.4, 9)], "repo_full_name string, pr_number int, " + S.BASE[7:-1]).select(Q.stored_prs(spark, SF).columns)
    if run == "folds":
        folds = work_dir(spark, "folds")
        E.upsert_stream(stream, folds, work_dir(spark, "upsert")).awaitTermination()
        got = E.current_prs(prs, folds)
    else:
        table = S.Table(spark, work_dir(spark, "pr-state"), 4).create(prs)
        S.stream_into(table, stream, work_dir(spark, "pr-stream")).awaitTermination()
        got = table.current()
    assert rows(got.select("pr_number", "title", "author", "deletions", "applied_seq")) == [(1, "a", "me", 0, 2), (2, "PR #2", "unknown", 4, 3), (3, None, None, 1, 9)]
    # one shuffle by the number, of unparsed messages
    assert len(plans) == 1 and plans[0].count("Exchange hashpartitioning(seq") == 1
    assert plans[0].rindex("from_json") < plans[0].index("Exchange hashpartitioning(seq")
