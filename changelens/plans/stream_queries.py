"""Registered queries: events and alerts; the ``*_stream`` ones run a real stream to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from changelens.operators import scan
from changelens.plans.mining import CTES
from changelens.plans import scanning  # noqa: F401  (defines the finding CTEs)
from changelens.plans.sqlbase import query
from changelens.session import work_dir
from changelens.sources import views as V
from changelens.streaming import alarms as M
from changelens.streaming import alerts as A
from changelens.streaming import events as E
from changelens.streaming import state as S

QUERIES, ORACLES = {}, {}
_ACCEPTED = "event_type = 'pull_request' AND action IN ('opened', 'synchronize', 'reopened') AND coalesce(pr_number, 0) <> 0"


def _events(spark, sf):
    return E.parse(V.event_messages(spark, sf))


def _at(df, *names):
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


def _message_files(spark, sf):
    """Messages written as several files, the second half delivered twice."""
    path = work_dir(spark, "messages")
    messages = V.event_messages(spark, sf)
    messages.unionByName(messages.filter("seq % 2 = 0")).repartitionByRange(4, "seq").write.parquet(path)
    return path, messages.schema


# --------------------------------------------------------------------------- gate, replay
QUERIES["t1_event_gate"] = lambda spark, sf: E.gate(_events(spark, sf))[1].groupBy("disposition", "event_type", "action").agg(F.count("*").alias("events"))
ORACLES["t1_event_gate"] = query(f"""
SELECT CASE WHEN event_type = 'pull_request' AND action IN ('opened', 'synchronize', 'reopened') THEN 'invalid'
  WHEN event_type = 'pull_request' AND action = 'closed' THEN 'ignored_closed' ELSE 'ignored' END AS disposition, event_type, action, count(*) AS events
FROM pr_events WHERE NOT ({_ACCEPTED}) GROUP BY ALL""")


def _gate_stream(spark, sf):
    path, schema = _message_files(spark, sf)
    out = work_dir(spark, "accepted")
    accepted = E.deduplicate(E.gate(E.parse(E.read_messages(spark, path, schema)))[0]).drop("present")
    run = accepted.writeStream.format("parquet").option("path", out).option("checkpointLocation", work_dir(spark, "gate")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(accepted.schema).parquet(out).groupBy("action").agg(F.count("*").alias("events"), F.countDistinct("seq").alias("ids"))


QUERIES["s1_t4_event_source_replay_stream"] = _gate_stream
ORACLES["s1_t4_event_source_replay_stream"] = query(f"SELECT action, count(*) AS events, count(*) AS ids FROM pr_events WHERE {_ACCEPTED} GROUP BY action")
QUERIES["t4_replay_safety"] = lambda spark, sf: E.deduplicate(
    E.gate(_events(spark, sf).unionByName(_events(spark, sf).filter("seq % 2 = 0")))[0]).groupBy("repo_full_name").agg(F.count("*").alias("events"))
ORACLES["t4_replay_safety"] = query(f"SELECT repo_full_name, count(*) AS events FROM pr_events WHERE {_ACCEPTED} GROUP BY 1")


# --------------------------------------------------------------------------- upsert
def stored_prs(spark, sf):
    """Pull requests stored before the events, one per customer."""
    c = F.col("c_custkey")
    text = lambda v: F.lit(v).cast("string")
    return V.table(spark, sf, "customer").select(
        F.concat(F.lit("org/repo"), (c % 5).cast("string")).alias("repo_full_name"), c.cast("int").alias("pr_number"),
        F.concat(F.lit("Old "), c.cast("string")).alias("title"), F.lit("someone").alias("author"), F.lit("dev").alias("base_branch"), F.lit("old").alias("head_branch"),
        text(None).alias("diff_url"), text(None).alias("html_url"), F.lit("text").alias("body"), F.lit(3).alias("files_changed"), F.lit(7).alias("additions"),
        F.lit(1).alias("deletions"), F.lit("completed").alias("status"), F.lit(0.5).alias("risk_score"), (c * 40).cast("bigint").alias("applied_seq"))


def _shown(prs):
    return prs.select(
        "repo_full_name", F.col("pr_number").cast("bigint"), "title", "author", "base_branch", "head_branch", "body", "status",
        *[F.col(c).cast("bigint") for c in ("files_changed", "additions", "deletions", "applied_seq")], F.coalesce("risk_score", F.lit(-1.0)).alias("risk_score"))


QUERIES["t2_pr_upsert"] = lambda spark, sf: _shown(E.upsert(stored_prs(spark, sf), E.fold(E.gate(_events(spark, sf))[0])))


def _upsert_stream(spark, sf):
    path, schema = _message_files(spark, sf)
    folds = work_dir(spark, "folds")
    E.upsert_stream(E.read_messages(spark, path, schema, 1), folds, work_dir(spark, "upsert")).awaitTermination()
    return _shown(E.current_prs(stored_prs(spark, sf), folds))


QUERIES["t2_pr_upsert_stream"] = _upsert_stream


def _last(column, key="seq"):
    return f"CASE WHEN max(seq) FILTER ({column} IS NOT NULL AND seq > applied) IS NOT NULL THEN arg_max({column}, seq) FILTER ({column} IS NOT NULL AND seq > applied)"


_MERGED = f"""
SELECT repo_full_name, pr_number, {_last("pr_title")} WHEN any_value(old) THEN 'Old ' || pr_number ELSE 'PR #' || pr_number END AS title,
  {_last("pr_author")} WHEN any_value(old) THEN 'someone' ELSE 'unknown' END AS author,
  CASE WHEN max(seq) FILTER (seq > applied) IS NOT NULL THEN 'main' WHEN any_value(old) THEN 'dev' ELSE 'main' END AS base_branch,
  {_last("head_branch")} WHEN any_value(old) THEN 'old' ELSE 'unknown' END AS head_branch,
  CASE WHEN any_value(old) AND count(*) FILTER (seq % 7 = 0 AND seq > applied) = 0 THEN 'text' END AS body,
  CASE WHEN any_value(old) AND count(*) FILTER (action = 'synchronize' AND seq > applied) = 0 THEN 'completed' ELSE 'pending' END AS status,
  coalesce({_last("files_changed")} WHEN any_value(old) THEN 3 ELSE 0 END, 0)::BIGINT AS files_changed,
  coalesce({_last("additions")} WHEN any_value(old) THEN 7 ELSE 0 END, 0)::BIGINT AS additions,
  coalesce({_last("deletions")} WHEN any_value(old) THEN 1 ELSE 0 END, 0)::BIGINT AS deletions,
  greatest(any_value(applied), coalesce(max(seq), -1))::BIGINT AS applied_seq,
  CASE WHEN any_value(old) AND count(*) FILTER (action = 'synchronize' AND seq > applied) = 0 THEN 0.5::DOUBLE ELSE -1.0::DOUBLE END AS risk_score
FROM (SELECT coalesce(e.repo_full_name, o.repo_full_name) AS repo_full_name, coalesce(e.pr_number, o.pr_number) AS pr_number, e.* EXCLUDE (repo_full_name, pr_number),
    o.pr_number IS NOT NULL AS old, coalesce(o.applied_seq, -1) AS applied
  FROM (SELECT * FROM pr_events WHERE {_ACCEPTED}) e
  FULL JOIN (SELECT 'org/repo' || (c_custkey % 5) AS repo_full_name, c_custkey AS pr_number, c_custkey * 40 AS applied_seq FROM customer) o
    ON e.repo_full_name = o.repo_full_name AND e.pr_number = o.pr_number)
GROUP BY 1, 2"""
def _compacted(spark, sf):
    """The same through two snapshots written on the way."""
    path, schema = _message_files(spark, sf)
    folds = work_dir(spark, "folds")
    E.upsert_stream(E.read_messages(spark, path, schema, 1), folds, work_dir(spark, "upsert")).awaitTermination()
    first = E.compact(stored_prs(spark, sf), folds, -1, 0, work_dir(spark, "snapshot"))
    second = E.compact(first, folds, 0, 2, work_dir(spark, "snapshot"))
    return _shown(E.current_prs(second, folds, 2))


QUERIES["t2_compaction"] = _compacted


def _state_table(spark, sf):
    """Quarters of the events, the last one first and one of them twice, into the bucketed table."""
    events = E.gate(_events(spark, sf))[0]
    table = S.Table(spark, work_dir(spark, "pr-state"), 16).create(stored_prs(spark, sf))
    for part in (3, 1, 2, 1, 0):
        table.apply(E.fold(events.filter(F.col("seq") % 4 == part)))
    return _shown(table.current())


QUERIES["t2_state_table"] = _state_table


def _state_stream(spark, sf):
    path, schema = _message_files(spark, sf)
    table = S.Table(spark, work_dir(spark, "pr-state"), 16).create(stored_prs(spark, sf))
    S.stream_into(table, E.read_messages(spark, path, schema, 1), work_dir(spark, "pr-stream")).awaitTermination()
    return _shown(table.current())


QUERIES["t2_state_table_stream"] = _state_stream
ORACLES["t2_state_table"] = ORACLES["t2_state_table_stream"] = query(_MERGED)
ORACLES["t2_pr_upsert"] = ORACLES["t2_pr_upsert_stream"] = ORACLES["t2_compaction"] = query(_MERGED)


def kafka_records(spark, sf):
    """The messages with the columns that Kafka's source gives."""
    m = V.event_messages(spark, sf)
    return m.select(F.col("key").cast("binary"), F.col("value").cast("binary"), F.lit("pr-events").alias("topic"), (F.col("seq") % 4).cast("int").alias("partition"),
                    F.col("seq").alias("offset"), F.col("ts").alias("timestamp"))


QUERIES["s1_kafka_columns"] = lambda spark, sf: E.gate(E.parse(E.from_kafka(kafka_records(spark, sf))))[0].select(
    "seq", "action", F.col("pr_number").cast("bigint"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
ORACLES["s1_kafka_columns"] = query(f"""
SELECT (seq % 4) * 1099511627776 + seq AS seq, action, pr_number, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM pr_events WHERE {_ACCEPTED}""")


# --------------------------------------------------------------------------- incremental scan, progress
def _secrets(changes):
    return scan.scan_changes(changes.select("pr_number", "diff"), ["secrets", "quick_static"]).groupBy("pr_number", "rule_id").agg(F.count("*").alias("findings"))


QUERIES["t3_incremental_scan"] = lambda spark, sf: E.incremental_scan(
    _events(spark, sf), V.changes(spark, sf).withColumn("pr_number", F.col("pr_number").cast("int")), _secrets, ["pr_number"]).withColumn("pr_number", F.col("pr_number").cast("bigint"))
ORACLES["t3_incremental_scan"] = query(f"""
SELECT pr_id::BIGINT AS pr_number, rule_id, count(*) AS findings FROM (SELECT * FROM f_secrets UNION ALL SELECT * FROM f_quick_static)
WHERE pr_id::BIGINT IN (SELECT pr_number FROM pr_events WHERE {_ACCEPTED}) GROUP BY ALL""")


def _scan_stream(spark, sf):
    """Batches of one file each, half of the events delivered again in a later one; changes stored in buckets."""
    path, messages = work_dir(spark, "messages"), V.event_messages(spark, sf)
    messages.repartitionByRange(2, "seq").write.parquet(path)
    messages.filter("seq % 2 = 0").coalesce(1).write.mode("append").parquet(path)
    stored, out = work_dir(spark, "changes"), work_dir(spark, "scan")
    numbered = V.changes(spark, sf).withColumn("pr_number", F.col("pr_number").cast("int"))
    E.write_changes(numbered, stored, ["pr_number"], 16)
    lines = lambda changes: scan.scan_changes(changes.select("pr_number", "diff"), ["secrets", "quick_static"]).select("pr_number", "rule_id", "diff_line")
    E.scan_stream(E.read_messages(spark, path, messages.schema, 1), spark.read.parquet(stored), lines, out, work_dir(spark, "scan-state"), ["pr_number"], buckets=16).awaitTermination()
    return spark.read.parquet(out).groupBy(F.col("pr_number").cast("bigint").alias("pr_number"), "rule_id").agg(F.count("*").alias("findings"))


QUERIES["t3_incremental_scan_stream"] = _scan_stream
ORACLES["t3_incremental_scan_stream"] = ORACLES["t3_incremental_scan"]


def feed(spark, sf):
    kind = F.when(F.col("event_type") == "click", "agent_progress").when(F.col("event_type") == "view", "finding_created").when(
        F.col("event_type") == "purchase", "review_complete").otherwise("ping")
    return V.table(spark, sf, "events").select((F.col("event_id") % 701).alias("pr_id"), kind.alias("type"), F.col("event_id").alias("seq"), "ts")


QUERIES["t5_progress_feed"] = lambda spark, sf: E.progress(feed(spark, sf))
ORACLES["t5_progress_feed"] = query("""
SELECT pr_id, count(*) FILTER (event_type = 'click') AS steps, count(*) FILTER (event_type = 'view') AS findings, bool_or(event_type = 'purchase') AS complete, max(event_id) AS last_seq
FROM (SELECT *, event_id % 701 AS pr_id, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY event_id % 701) AS closed FROM events)
WHERE closed IS NULL OR event_id <= closed GROUP BY 1""")


# --------------------------------------------------------------------------- windows
def _windows(source, sums, n, seconds, keys="", having=""):
    """Sums over n steps of the given seconds ending at every step."""
    keyed = f", {keys}" if keys else ""
    return f"""
SELECT ends_at{keyed}, {', '.join(f'sum({s})::BIGINT AS {s}' for s in sums)} FROM (
  SELECT b + to_seconds(k * {seconds}) AS ends_at{keyed}, {', '.join(sums)} FROM (
    SELECT time_bucket(INTERVAL '{seconds} seconds', ts) AS b{keyed}, {', '.join(f'{e} AS {s}' for s, e in sums.items())} FROM {source} GROUP BY ALL), range(1, {n + 1}) r(k))
GROUP BY ALL {having}"""


_AT = "strftime(ends_at, '%Y-%m-%d %H:%M:%S') AS ends_at"
CTES["t6"] = _windows("request_log", {"part": "count(*) FILTER (status_code >= 500)", "whole": "count(*)"}, 10, 30)
QUERIES["t6_server_error_ratio"] = lambda spark, sf: _at(A.ratio(V.request_log(spark, sf), "ts", F.col("status_code") >= 500, "5 minutes"), "ends_at").withColumn("ratio", F.round("ratio", 6))
ORACLES["t6_server_error_ratio"] = query(f"SELECT {_AT}, part, whole, round(part / whole, 6) AS ratio FROM t6")
QUERIES["w8_sustained_errors"] = lambda spark, sf: _at(A.sustained(
    A.ratio(V.request_log(spark, sf), "ts", F.col("status_code") >= 500, "5 minutes"), F.col("ratio") > 0.05, 300), "pending_from", "firing_from", "firing_to")
ORACLES["w8_sustained_errors"] = query("""
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS pending_from, strftime(s + INTERVAL 300 SECONDS, '%Y-%m-%d %H:%M:%S') AS firing_from, strftime(e, '%Y-%m-%d %H:%M:%S') AS firing_to
FROM (SELECT min(ends_at) AS s, max(ends_at) AS e FROM (SELECT ends_at, sum(fresh) OVER (ORDER BY ends_at) AS run FROM (
    SELECT ends_at, CASE WHEN ends_at - lag(ends_at) OVER (ORDER BY ends_at) = INTERVAL 30 SECONDS THEN 0 ELSE 1 END AS fresh FROM t6 WHERE part / whole > 0.05)) GROUP BY run)
WHERE e - s >= INTERVAL 300 SECONDS""")


def _error_stream(spark, sf):
    """The error ratio as a stream; requests long after the others move the watermark past all windows of interest and open none that is shown."""
    path, out = work_dir(spark, "requests"), work_dir(spark, "ratios")
    log = V.request_log(spark, sf)
    log.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    for days in (1, 2):
        log.agg(F.max("ts").alias("ts")).select(
            *[(F.col("ts") + F.expr(f"INTERVAL {days} DAYS")).alias(c) if c == "ts" else F.lit(None).cast(log.schema[c].dataType).alias(c) for c in log.columns]).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 4).parquet(path)
    ratios = A.ratio(stream, "ts", F.col("status_code") >= 500, "5 minutes", of=F.col("status_code").isNotNull())
    ratios.writeStream.format("parquet").option("path", out).option("checkpointLocation", work_dir(spark, "ratio")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    # a window that holds closing requests alone counts none
    return _at(spark.read.schema(ratios.schema).parquet(out).filter("whole > 0"), "ends_at").withColumn("ratio", F.round("ratio", 6))


QUERIES["t6_server_error_ratio_stream"] = _error_stream
ORACLES["t6_server_error_ratio_stream"] = ORACLES["t6_server_error_ratio"]

QUERIES["t7_runaway_reviews"] = lambda spark, sf: _at(A.runaway(
    V.run_facts(spark, sf), "started_at", "findings_count", "pr_id", "1 day", "1 hour", 4), "ends_at")
CTES["run_ts"] = "SELECT *, started_at AS ts FROM run_facts"
ORACLES["t7_runaway_reviews"] = query(f"SELECT {_AT}, pr_id, steps FROM ({_windows('run_ts', {'steps': 'sum(findings_count)'}, 24, 3600, 'pr_id')}) WHERE steps > 4")
QUERIES["t8_latency_quantiles"] = lambda spark, sf: _at(A.latency_quantiles(V.request_log(spark, sf), "ts", "latency", "6 hours", "1 hour"), "ends_at").withColumns(
    {p: F.round(p, 6) for p in ("p50", "p95", "p99")})


def _quantile_sql(q):
    parts = []
    for i, b in enumerate(A.ALERT_BOUNDS):
        low, under = (repr(A.ALERT_BOUNDS[i - 1]), f"b{i - 1}") if i else ("0.0", "0")
        parts.append(f"WHEN b{i} >= total * {q}::DOUBLE THEN {low}::DOUBLE + ({b}::DOUBLE - {low}::DOUBLE) * coalesce((total * {q}::DOUBLE - {under}) / nullif(b{i} - {under}, 0), 0)")
    return f"round(CASE {' '.join(parts)} ELSE {A.ALERT_BOUNDS[-1]}::DOUBLE END, 6)"


ORACLES["t8_latency_quantiles"] = query(f"""
SELECT {_AT}, endpoint, {_quantile_sql(0.5)} AS p50, {_quantile_sql(0.95)} AS p95, {_quantile_sql(0.99)} AS p99
FROM ({_windows('request_log', {f'b{i}': f'count(*) FILTER (latency <= {b})' for i, b in enumerate(A.ALERT_BOUNDS)} | {'total': 'count(*)'}, 6, 3600, 'endpoint')})""")
QUERIES["t8_latency_sketches"] = lambda spark, sf: _at(A.latency_sketches(V.request_log(spark, sf), "ts", "latency", "6 hours", "1 hour"), "ends_at")
ORACLES["t8_latency_sketches"] = query(f"""
SELECT {_AT}, endpoint, quantile_disc(latency, 0.5) AS p50, quantile_disc(latency, 0.95) AS p95, quantile_disc(latency, 0.99) AS p99
FROM (SELECT date_trunc('hour', ts) + to_hours(k) AS ends_at, endpoint, latency FROM request_log, range(1, 7) r(k)) GROUP BY 1, 2""")
QUERIES["t9_backlog"] = lambda spark, sf: _at(A.backlog(
    V.table(spark, sf, "events"), "ts", F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", -1).otherwise(0)), "ends_at")
ORACLES["t9_backlog"] = query(f"""
SELECT {_AT}, waiting FROM (SELECT b + INTERVAL 30 SECONDS AS ends_at, sum(c) OVER (ORDER BY b)::BIGINT AS waiting
  FROM (SELECT time_bucket(INTERVAL '30 seconds', ts) AS b, sum(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END) AS c FROM events GROUP BY 1))""")
QUERIES["t10_task_failure_ratio"] = lambda spark, sf: _at(A.ratio(
    V.run_facts(spark, sf), "started_at", F.col("status") == "failed", "10 minutes", of=F.col("status").isin("failed", "completed")).filter("whole > 0"), "ends_at").withColumn("ratio", F.round("ratio", 6))
ORACLES["t10_task_failure_ratio"] = query(f"""
SELECT {_AT}, part, whole, round(part / whole, 6) AS ratio FROM ({_windows('run_ts', {'part': "count(*) FILTER (status = 'failed')", 'whole': "count(*) FILTER (status IN ('failed', 'completed'))"}, 20, 30)})
WHERE whole > 0""")
QUERIES["t11_false_positive_ratio"] = lambda spark, sf: _at(A.ratio(
    V.finding_facts(spark, sf), "created_at", F.col("false_positive"), "7 days", "1 day"), "ends_at").withColumn("ratio", F.round("ratio", 6))
CTES["finding_ts"] = "SELECT *, created_at AS ts FROM finding_facts"
ORACLES["t11_false_positive_ratio"] = query(f"""
SELECT {_AT}, part, whole, round(part / whole, 6) AS ratio FROM ({_windows('finding_ts', {'part': 'count(*) FILTER (false_positive)', 'whole': 'count(*)'}, 7, 86400)})""")
QUERIES["t12_hourly_rates"] = lambda spark, sf: _at(A.hourly(V.run_facts(spark, sf), "started_at", ["agent_type"]), "ends_at")
ORACLES["t12_hourly_rates"] = query(f"""
SELECT strftime(date_trunc('hour', started_at) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS ends_at, agent_type, count(*) AS n FROM run_facts GROUP BY ALL""")
QUERIES["t13_mean_durations"] = lambda spark, sf: _at(A.mean_by_window(
    V.run_facts(spark, sf).withColumn("hundredths", F.round(F.col("duration_seconds") * 100).cast("bigint")),  # whole numbers add up exactly in any order
    "started_at", "hundredths", "6 hours", "1 hour", ["agent_type"]), "ends_at").filter("mean IS NOT NULL")
ORACLES["t13_mean_durations"] = query(f"""
SELECT {_AT}, agent_type, sum(s)::BIGINT / sum(n)::BIGINT AS mean FROM (
  SELECT b + to_hours(k) AS ends_at, agent_type, s, n FROM (SELECT date_trunc('hour', started_at) AS b, agent_type, sum(round(duration_seconds * 100)::BIGINT) AS s, count(duration_seconds) AS n FROM run_facts GROUP BY ALL),
    range(1, 7) r(k)) GROUP BY ALL HAVING sum(n) > 0""")


def gauges(spark, sf):
    e = V.table(spark, sf, "events")
    return e.filter("event_type IN ('click', 'view')").select("ts", F.when(F.col("event_type") == "click", "active").otherwise("total").alias("series"), "value")


QUERIES["t13_utilisation"] = lambda spark, sf: _at(A.gauge_ratio(gauges(spark, sf), "ts", "series", "value", "active", "total", "6 hours").filter(
    "part IS NOT NULL AND whole IS NOT NULL"), "ends_at").withColumn("ratio", F.round("ratio", 6))
ORACLES["t13_utilisation"] = query(f"""
SELECT strftime(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOURS, '%Y-%m-%d %H:%M:%S') AS ends_at, arg_max(value, ts) FILTER (event_type = 'click') AS part,
  arg_max(value, ts) FILTER (event_type = 'view') AS whole, round(arg_max(value, ts) FILTER (event_type = 'click') / arg_max(value, ts) FILTER (event_type = 'view'), 6) AS ratio
FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01')
HAVING count(*) FILTER (event_type = 'click') > 0 AND count(*) FILTER (event_type = 'view') > 0""")


# --------------------------------------------------------------------------- alerts
# The test events lie minutes to hours apart.  Their times, not the alerts' windows, are pressed together, so that windows hold rows.
_START, _PRESS = 1_704_067_200_000_000, 400  # microseconds of 2024-01-01


def pressed(rows, time):
    """Times 400 times as close to the start of 2024, to the microsecond."""
    return rows.withColumn(time, F.timestamp_micros(_START + F.floor((F.unix_micros(time) - _START) / _PRESS)))


def _press_sql(time="ts"):
    return f"make_timestamp({_START} + floor((epoch_us({time}) - {_START}) / {_PRESS})::BIGINT)"


CTES["pressed_log"] = f"SELECT * REPLACE ({_press_sql()} AS ts) FROM request_log"
CTES["pressed_runs"] = f"SELECT * EXCLUDE (started_at), {_press_sql('started_at')} AS ts FROM run_facts"
CTES["pressed_findings"] = f"SELECT * EXCLUDE (created_at), {_press_sql('created_at')} AS ts FROM finding_facts"
CTES["pressed_events"] = f"SELECT * REPLACE ({_press_sql()} AS ts) FROM events"
_FIRED = ("pending_from", "firing_from", "firing_to")


def _fired(alerts):
    return alerts.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in _FIRED})


def _times(seconds):
    stamp = "'%Y-%m-%d %H:%M:%S.%f'"
    return f"strftime(s, {stamp}) AS pending_from, strftime(s + to_seconds({seconds}), {stamp}) AS firing_from, strftime(e, {stamp}) AS firing_to"


def _every_step_sql(rows, condition, seconds, key=None):
    """Alerts whose condition holds at each evaluation of a stretch, evaluations being 30 seconds apart."""
    named, over = (f"{key}, ", f"PARTITION BY {key} ORDER BY ends_at") if key else ("", "ORDER BY ends_at")
    return query(f"""
SELECT {named}{_times(seconds)} FROM (SELECT {named}min(ends_at) AS s, max(ends_at) AS e FROM (SELECT *, sum(fresh) OVER ({over}) AS run FROM (
    SELECT *, CASE WHEN ends_at - lag(ends_at) OVER ({over}) = INTERVAL 30 SECONDS THEN 0 ELSE 1 END AS fresh FROM ({rows}) WHERE {condition})) GROUP BY {named}run)
WHERE e - s >= to_seconds({seconds})""")


def _gauge_sql(rows, condition, seconds, until, key=None):
    """Alerts on gauges: a stretch goes from a row that holds after one that does not, to the next that does not."""
    named, over = (f"{key}, ", f"PARTITION BY {key} ORDER BY ends_at") if key else ("", "ORDER BY ends_at")
    same = f"AND n.{key} = b.{key}" if key else ""
    return query(f"""
SELECT * FROM (WITH states AS MATERIALIZED (SELECT *, coalesce({condition}, false) AS ok FROM ({rows})),
  begun AS (SELECT * FROM (SELECT *, lag(ok, 1, false) OVER ({over}) AS before FROM states) WHERE ok AND NOT before)
SELECT {named}{_times(seconds)} FROM (SELECT {'b.' + named if named else ''}b.ends_at AS s, coalesce((SELECT min(n.ends_at) FROM states n WHERE NOT n.ok AND n.ends_at > b.ends_at {same}),
    greatest(b.ends_at, {until})) AS e FROM begun b) WHERE e - s >= to_seconds({seconds}))""")


def _until(spark):
    return F.lit("2024-01-01 03:00:00").cast("timestamp")


_UNTIL = "TIMESTAMP '2024-01-01 03:00:00'"
QUERIES["t6_error_alert"] = lambda spark, sf: _fired(A.error_alert(pressed(V.request_log(spark, sf), "ts"), "ts", F.col("status_code") >= 500))
ORACLES["t6_error_alert"] = _every_step_sql(_windows("pressed_log", {"part": "count(*) FILTER (status_code >= 500)", "whole": "count(*)"}, 10, 30), "part / whole > 0.05", 300)
QUERIES["t7_loop_alert"] = lambda spark, sf: _fired(A.loop_alert(
    pressed(V.run_facts(spark, sf), "started_at").withColumn("pr_id", F.col("run_id") % 7), "started_at", "findings_count", "pr_id"))
CTES["looping_runs"] = "SELECT ts, run_id % 7 AS pr_id, findings_count FROM pressed_runs"
ORACLES["t7_loop_alert"] = _every_step_sql(_windows("looping_runs", {"steps": "sum(findings_count)"}, 20, 30, "pr_id"), "steps > 15", 120, "pr_id")
QUERIES["t8_latency_alert"] = lambda spark, sf: _fired(A.latency_alert(pressed(V.request_log(spark, sf), "ts").withColumn("latency", F.col("latency") * 5), "ts", "latency"))
CTES["slow_log"] = "SELECT ts, endpoint, latency * 5 AS latency FROM pressed_log"
CTES["slow_windows"] = _windows("slow_log", {f"b{i}": f"count(*) FILTER (latency <= {b})" for i, b in enumerate(A.ALERT_BOUNDS)} | {"total": "count(*)"}, 10, 30, "endpoint")
ORACLES["t8_latency_alert"] = _every_step_sql(f"SELECT ends_at, endpoint, {_quantile_sql(0.95)} AS p95 FROM slow_windows", "p95 > 30", 300, "endpoint")


def _queue(arrived, done):
    return F.when(F.col("event_type") == arrived[0], arrived[1]).when(F.col("event_type") == done[0], -done[1]).otherwise(0)


def _queue_sql(arrived, done, key=""):
    keyed = f", {key}" if key else ""
    over = f"PARTITION BY {key} ORDER BY b" if key else "ORDER BY b"
    return f"""SELECT b + INTERVAL 30 SECONDS AS ends_at{keyed}, sum(c) OVER ({over}) AS waiting FROM (SELECT time_bucket(INTERVAL '30 seconds', ts) AS b{keyed},
    sum(CASE event_type WHEN '{arrived[0]}' THEN {arrived[1]} WHEN '{done[0]}' THEN -{done[1]} ELSE 0 END) AS c FROM queue_events GROUP BY ALL)"""


CTES["queue_events"] = "SELECT ts, event_type, user_id % 4 AS partition_no FROM pressed_events"
QUERIES["t9_backlog_alert"] = lambda spark, sf: _fired(A.backlog_alert(
    pressed(V.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts"), "ts", _queue(("click", 5), ("view", 5)), until=_until(spark)))
ORACLES["t9_backlog_alert"] = _gauge_sql(_queue_sql(("click", 5), ("view", 5)), "waiting > 50", 900, _UNTIL)
QUERIES["t9_lag_alert"] = lambda spark, sf: _fired(A.lag_alert(
    pressed(V.table(spark, sf, "events").withColumns({"ts": F.col("ts").cast("timestamp"), "partition_no": F.col("user_id") % 4}), "ts"), "ts", _queue(("signup", 12), ("purchase", 10)),
    ["partition_no"], _until(spark)))
ORACLES["t9_lag_alert"] = _gauge_sql(_queue_sql(("signup", 12), ("purchase", 10), "partition_no"), "waiting > 100", 600, _UNTIL, "partition_no")
QUERIES["t10_failure_alert"] = lambda spark, sf: _fired(A.failure_alert(
    pressed(V.run_facts(spark, sf), "started_at"), "started_at", F.col("status") == "failed", F.col("status").isin("failed", "completed")))
ORACLES["t10_failure_alert"] = _every_step_sql(_windows("pressed_runs", {
    "part": "count(*) FILTER (status = 'failed')", "whole": "count(*) FILTER (status IN ('failed', 'completed'))"}, 20, 30), "whole > 0 AND part / whole > 0.1", 600)
QUERIES["t11_false_positive_alert"] = lambda spark, sf: _fired(A.false_positive_alert(
    pressed(V.finding_facts(spark, sf).withColumn("created_at", F.col("created_at").cast("timestamp")), "created_at"),
    "created_at", F.col("false_positive") | ((F.col("severity") == "medium") & (F.hour("created_at") % 5 == 0))))  # every fifth hour is a bad one
ORACLES["t11_false_positive_alert"] = _every_step_sql(_windows(
    "pressed_findings", {"part": "count(*) FILTER (false_positive OR severity = 'medium' AND hour(ts) % 5 = 0)", "whole": "count(*)"}, 120, 30), "part / whole > 0.3", 1800)


def _gauge_samples(spark, sf):
    e = V.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return pressed(e, "ts").select("ts", (F.col("user_id") % 3).alias("pod"), F.when(F.col("event_type") == "click", "used").otherwise("limit").alias("series"),
                                   F.when(F.col("event_type") == "click", F.floor(F.unix_seconds("ts") / 600) % 4 + 3 + F.col("value") % 1).otherwise(F.lit(6.0)).alias("value"))


CTES["gauge_samples"] = """
SELECT ts, user_id % 3 AS pod, CASE WHEN event_type = 'click' THEN (epoch_us(ts) // 600000000) % 4 + 3 + value % 1 END AS used, CASE WHEN event_type <> 'click' THEN 6.0::DOUBLE END AS capacity FROM pressed_events"""
CTES["gauge_states"] = """
SELECT pod, ts AS ends_at, last_value(used IGNORE NULLS) OVER w AS part, last_value(capacity IGNORE NULLS) OVER w AS whole
FROM (SELECT pod, ts, max(used) AS used, max(capacity) AS capacity FROM gauge_samples GROUP BY ALL) WINDOW w AS (PARTITION BY pod ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def _pairs(spark, sf):
    return A.gauge_pairs(_gauge_samples(spark, sf), "ts", "series", "value", "used", "limit", ["pod"])


QUERIES["t13_pool_alert"] = lambda spark, sf: _fired(A.pool_alert(_pairs(spark, sf), ["pod"], _until(spark)))
ORACLES["t13_pool_alert"] = _gauge_sql("SELECT * FROM gauge_states", "whole - part < 2", 300, _UNTIL, "pod")
QUERIES["t13_memory_alert"] = lambda spark, sf: _fired(A.memory_alert(_pairs(spark, sf), ["pod"], _until(spark)))
ORACLES["t13_memory_alert"] = _gauge_sql("SELECT * FROM gauge_states", "part / whole > 0.85", 300, _UNTIL, "pod")


# --------------------------------------------------------------------------- the same alerts told by streams
def _alarm(spark, rows, time, build, until, keys=(), mark=None):
    """Periods of an alarm over rows that arrive as files by time; rows long after the others move the watermark past every time of interest."""
    path, out = work_dir(spark, "alarm-rows"), work_dir(spark, "alarms")
    rows.repartitionByRange(6, time).write.parquet(path)
    for days in (1, 2):
        late = {time: F.col(time) + F.expr(f"INTERVAL {days} DAYS")}
        rows.agg(F.max(time).alias(time)).select(*[late[c].alias(c) if c in late else F.lit((mark or {}).get(c)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(path)
    transitions = build(stream)
    M.start(transitions, out, work_dir(spark, "alarm-state")).awaitTermination()
    return _fired(M.periods(spark.read.schema(transitions.schema).parquet(out), until, keys))


QUERIES["t6_error_alarm_stream"] = lambda spark, sf: _alarm(
    spark, pressed(V.request_log(spark, sf), "ts").select("ts", "status_code"), "ts",
    lambda s: M.error_alarm(s, "ts", F.col("status_code") >= 500, F.col("status_code").isNotNull()), None)
ORACLES["t6_error_alarm_stream"] = ORACLES["t6_error_alert"]
QUERIES["t7_loop_alarm_stream"] = lambda spark, sf: _alarm(
    spark, pressed(V.run_facts(spark, sf), "started_at").select("started_at", (F.col("run_id") % 7).alias("pr_id"), "findings_count"), "started_at",
    lambda s: M.loop_alarm(s, "started_at", "findings_count", "pr_id"), None, ["pr_id"])
ORACLES["t7_loop_alarm_stream"] = ORACLES["t7_loop_alert"]
QUERIES["t13_memory_alarm_stream"] = lambda spark, sf: _alarm(
    spark, _gauge_samples(spark, sf), "ts", lambda s: M.memory_alarm(s, "ts", "series", "value", "used", "limit", ["pod"]), _until(spark), ["pod"], {"series": "used", "pod": -1})
ORACLES["t13_memory_alarm_stream"] = ORACLES["t13_memory_alert"]
QUERIES["t13_pool_alarm_stream"] = lambda spark, sf: _alarm(
    spark, _gauge_samples(spark, sf), "ts", lambda s: M.pool_alarm(s, "ts", "series", "value", "used", "limit", ["pod"]), _until(spark), ["pod"], {"series": "used", "pod": -1})
ORACLES["t13_pool_alarm_stream"] = ORACLES["t13_pool_alert"]
QUERIES["t12_findings_per_hour"] = lambda spark, sf: _at(A.hourly(V.finding_facts(spark, sf), "created_at", ["severity"]), "ends_at")
ORACLES["t12_findings_per_hour"] = query("""
SELECT strftime(date_trunc('hour', created_at::TIMESTAMP) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS ends_at, severity, count(*) AS n FROM finding_facts GROUP BY ALL""")
