"""Registered queries: listings and dashboard aggregates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from changelens.functions.text import duration_text, severity_rank
from changelens.operators import findings as G
from changelens.operators import metrics as A
from changelens.operators import rollups as R
from changelens.plans.sqlbase import query
from changelens.session import work_dir
from changelens.sources import views as V

QUERIES, ORACLES = {}, {}
AS_OF = datetime(1998, 6, 15)
RUNS_AS_OF = datetime(2024, 1, 25)
_UNTIL, _RUNS = "TIMESTAMP '1998-06-15'", "started_at >= TIMESTAMP '2024-01-18' AND started_at < TIMESTAMP '2024-01-25'"
_SINCE7, _SINCE30, _SINCE90 = "TIMESTAMP '1998-06-08'", "TIMESTAMP '1998-05-16'", "TIMESTAMP '1998-03-17'"
_TIME = "yyyy-MM-dd HH:mm:ss"


def _at(column):
    return F.date_format(column, _TIME).alias(column)


_SQL_AT = "strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"

QUERIES["f1_list_prs"] = lambda spark, sf: A.listing(
    V.pr_facts(spark, sf), "created_at", "pr_id", 50, 10, status="completed").select("pr_id", "repo_full_name", "status", _at("created_at"))
ORACLES["f1_list_prs"] = query(f"""
SELECT pr_id, repo_full_name, status, {_SQL_AT.format(c="created_at")} FROM (SELECT * FROM pr_facts WHERE status = 'completed' ORDER BY created_at DESC, pr_id LIMIT 50 OFFSET 10)""")
QUERIES["f2_point_lookup"] = lambda spark, sf: A.by_id(V.finding_facts(spark, sf), "pr_id", 7).select("finding_id", "severity", "title")
ORACLES["f2_point_lookup"] = query("SELECT finding_id, severity, title FROM finding_facts WHERE pr_id = 7")
QUERIES["f3_list_findings"] = lambda spark, sf: A.listing(
    V.finding_facts(spark, sf), "created_at", "finding_id", 500, severity="critical", category="security", agent_type=None,
    false_positive=False).select("finding_id", _at("created_at"))
ORACLES["f3_list_findings"] = query(f"""
SELECT finding_id, {_SQL_AT.format(c="created_at")} FROM (SELECT * FROM finding_facts WHERE severity = 'critical' AND category = 'security' AND NOT false_positive
  ORDER BY created_at DESC, finding_id LIMIT 500)""")
QUERIES["f4_findings_of_change"] = lambda spark, sf: A.listing(
    V.finding_facts(spark, sf), "created_at", "finding_id", pr_id=11).select("finding_id", "severity", _at("created_at"))
ORACLES["f4_findings_of_change"] = query(f"SELECT finding_id, severity, {_SQL_AT.format(c='created_at')} FROM finding_facts WHERE pr_id = 11")
QUERIES["f5_list_agent_runs"] = lambda spark, sf: A.listing(
    V.run_facts(spark, sf), "started_at", "run_id", 200, agent_type="security_audit", status="completed").select("run_id", _at("started_at"))
ORACLES["f5_list_agent_runs"] = query(f"""
SELECT run_id, {_SQL_AT.format(c="started_at")} FROM (SELECT * FROM run_facts WHERE agent_type = 'security_audit' AND status = 'completed' ORDER BY started_at DESC, run_id LIMIT 200)""")
QUERIES["f6_run_timeline"] = lambda spark, sf: A.listing(
    V.run_facts(spark, sf), "started_at", "run_id", ascending=True, pr_id=3).select(
    "run_id", "agent_type", duration_text(F.col("duration_seconds")).alias("duration"), _at("started_at"))
ORACLES["f6_run_timeline"] = query(f"""
SELECT run_id, agent_type, CASE WHEN duration_seconds IS NULL THEN '--' WHEN duration_seconds < 60 THEN printf('%.1f', duration_seconds) || 's'
  ELSE floor(duration_seconds / 60)::BIGINT || 'm ' || round(duration_seconds - 60 * floor(duration_seconds / 60), 0)::BIGINT || 's' END AS duration,
  {_SQL_AT.format(c="started_at")} FROM run_facts WHERE pr_id = 3""")
QUERIES["f7_pending_queue"] = lambda spark, sf: A.listing(
    V.pr_facts(spark, sf), "created_at", "pr_id", 50, ascending=True, status="pending").select("pr_id", _at("created_at"))
ORACLES["f7_pending_queue"] = query(f"""
SELECT pr_id, {_SQL_AT.format(c="created_at")} FROM (SELECT * FROM pr_facts WHERE status = 'pending' ORDER BY created_at, pr_id LIMIT 50)""")
QUERIES["f8_in_flight_split"] = lambda spark, sf: A.in_flight(V.pr_facts(spark, sf))
ORACLES["f8_in_flight_split"] = query("""
SELECT CASE WHEN status = 'reviewing' THEN 'reviewing' ELSE 'waiting' END AS bucket, count(*) AS prs FROM pr_facts
WHERE status IN ('reviewing', 'pending', 'queued') GROUP BY 1""")

QUERIES["a1_a2_a3_summary"] = lambda spark, sf: A.summary(
    V.pr_facts(spark, sf), V.finding_facts(spark, sf), V.run_facts(spark, sf), AS_OF, runs_as_of=RUNS_AS_OF).withColumn(
    "period_days", F.col("period_days").cast("bigint"))
ORACLES["a1_a2_a3_summary"] = query(f"""
SELECT 7::BIGINT AS period_days, (SELECT count(*) FROM pr_facts WHERE created_at >= {_SINCE7} AND created_at < {_UNTIL}) AS total_prs_reviewed,
  (SELECT count(*) FROM finding_facts WHERE created_at >= {_SINCE7} AND created_at < {_UNTIL}) AS total_findings,
  (SELECT round(coalesce(count(*) FILTER (false_positive) / nullif(count(*), 0), 0), 3) FROM finding_facts WHERE created_at >= {_SINCE7} AND created_at < {_UNTIL}) AS false_positive_rate,
  (SELECT round(coalesce(avg(duration_seconds), 0), 1) FROM run_facts WHERE {_RUNS}) AS avg_review_duration_seconds""")
QUERIES["a2_false_positive_rate"] = lambda spark, sf: A.recent(V.finding_facts(spark, sf), "created_at", AS_OF, 30).groupBy("agent_type").agg(
    A.rate(F.count_if("false_positive"), F.count("*"), 3).alias("false_positive_rate"))
ORACLES["a2_false_positive_rate"] = query(f"""
SELECT agent_type, round(count(*) FILTER (false_positive) / count(*), 3) AS false_positive_rate FROM finding_facts WHERE created_at >= {_SINCE30} AND created_at < {_UNTIL} GROUP BY 1""")
QUERIES["a3_mean_review_duration"] = lambda spark, sf: A.recent(V.run_facts(spark, sf), "started_at", RUNS_AS_OF, 7).agg(
    F.round(F.coalesce(F.avg("duration_seconds"), F.lit(0.0)), 1).alias("avg_review_duration_seconds"))
ORACLES["a3_mean_review_duration"] = query(f"""
SELECT round(coalesce(avg(duration_seconds), 0), 1) AS avg_review_duration_seconds FROM run_facts WHERE {_RUNS}""")
QUERIES["a4_severity_category_breakdown"] = lambda spark, sf: A.breakdown(V.finding_facts(spark, sf), AS_OF)
ORACLES["a4_severity_category_breakdown"] = query(f"""
SELECT 'severity' AS dimension, severity AS value, count(*) AS findings FROM finding_facts WHERE created_at >= {_SINCE7} AND created_at < {_UNTIL} GROUP BY severity
UNION ALL SELECT 'category', category, count(*) FROM finding_facts WHERE created_at >= {_SINCE7} AND created_at < {_UNTIL} GROUP BY category""")
_TREND = f"""
SELECT strftime(date_trunc('day', created_at), '%Y-%m-%d') AS date, severity, count(*) AS count FROM finding_facts WHERE created_at >= {_SINCE30} AND created_at < {_UNTIL} GROUP BY ALL"""
QUERIES["a5_daily_trend"] = lambda spark, sf: A.daily_trend(V.finding_facts(spark, sf), AS_OF)
ORACLES["a5_daily_trend"] = query(_TREND)
QUERIES["a6_trend_pivot"] = lambda spark, sf: A.trend_pivot(A.daily_trend(V.finding_facts(spark, sf), AS_OF))
ORACLES["a6_trend_pivot"] = query(f"""
SELECT date, {', '.join(f"coalesce(sum(count) FILTER (severity = '{s}'), 0)::BIGINT AS {s}" for s in ('critical', 'high', 'medium', 'low', 'info'))}
FROM ({_TREND}) GROUP BY date""")
QUERIES["a7_top_repositories"] = lambda spark, sf: A.top_repositories(V.pr_facts(spark, sf), V.finding_facts(spark, sf), AS_OF)
ORACLES["a7_top_repositories"] = query(f"""
SELECT repo_full_name AS repo, count(*) AS finding_count FROM finding_facts f JOIN pr_facts p USING (pr_id) WHERE f.created_at >= {_SINCE30} AND f.created_at < {_UNTIL}
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
QUERIES["j1_findings_with_prs"] = lambda spark, sf: V.finding_facts(spark, sf).join(
    V.pr_facts(spark, sf).select("pr_id", "repo_full_name", "status"), "pr_id").groupBy("status", "severity").agg(
    F.count("*").alias("findings"), F.countDistinct("repo_full_name").alias("repos"))
ORACLES["j1_findings_with_prs"] = query("""
SELECT p.status, f.severity, count(*) AS findings, count(DISTINCT repo_full_name) AS repos FROM finding_facts f JOIN pr_facts p USING (pr_id) GROUP BY ALL""")
QUERIES["a8_agent_performance"] = lambda spark, sf: A.agent_performance(V.run_facts(spark, sf), RUNS_AS_OF)
ORACLES["a8_agent_performance"] = query(f"""
SELECT agent_type, count(*) AS run_count, round(coalesce(avg(duration_seconds), 0), 1) AS avg_duration_seconds,
  coalesce(sum(tokens_used), 0)::BIGINT AS total_tokens_used, round(coalesce(avg(findings_count), 0), 1) AS avg_findings_per_run
FROM run_facts WHERE {_RUNS} GROUP BY agent_type""")
QUERIES["a9_severity_by_change"] = lambda spark, sf: A.severity_by_change(V.finding_facts(spark, sf))
ORACLES["a9_severity_by_change"] = query("SELECT pr_id, severity, count(*) AS findings FROM finding_facts GROUP BY ALL")
QUERIES["a10_reviewed_false_positive_rate"] = lambda spark, sf: A.reviewed_false_positive_rate(
    V.finding_facts(spark, sf), AS_OF, 90).withColumn("period_days", F.col("period_days").cast("bigint"))
ORACLES["a10_reviewed_false_positive_rate"] = query(f"""
SELECT count(*) AS total_reviewed, count(*) FILTER (false_positive) AS false_positives, round(coalesce(count(*) FILTER (false_positive) / nullif(count(*), 0), 0), 4) AS false_positive_rate,
  90::BIGINT AS period_days FROM finding_facts WHERE created_at >= {_SINCE90} AND created_at < {_UNTIL} AND human_feedback IS NOT NULL""")
QUERIES["a14_request_counts"] = lambda spark, sf: A.request_counts(V.request_log(spark, sf)).withColumn("status_code", F.col("status_code").cast("bigint"))
ORACLES["a14_request_counts"] = query("SELECT method, endpoint, status_code::BIGINT AS status_code, count(*) AS requests FROM request_log GROUP BY ALL")
QUERIES["a14_latency_histogram"] = lambda spark, sf: A.latency_histogram(V.request_log(spark, sf), "method", "endpoint").withColumn(
    "le", F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string")))
ORACLES["a14_latency_histogram"] = query(f"""
SELECT method, endpoint, CASE WHEN b = 'Infinity'::DOUBLE THEN '+Inf' ELSE b::VARCHAR END AS le, count(*) FILTER (latency <= b) AS requests
FROM request_log, (SELECT unnest([{', '.join(str(b) for b in A.LATENCY_BOUNDS)}]::DOUBLE[] || ['Infinity'::DOUBLE]) AS b) GROUP BY method, endpoint, b""")
QUERIES["a15_finding_counts"] = lambda spark, sf: A.finding_counts(V.finding_facts(spark, sf))
ORACLES["a15_finding_counts"] = query("SELECT severity, category, count(*) AS findings FROM finding_facts GROUP BY ALL")
QUERIES["x14_duration_text"] = lambda spark, sf: V.run_facts(spark, sf).groupBy(duration_text(F.col("duration_seconds")).alias("duration")).agg(F.count("*").alias("runs"))
ORACLES["x14_duration_text"] = query("""
SELECT CASE WHEN duration_seconds IS NULL THEN '--' WHEN duration_seconds < 60 THEN printf('%.1f', round(duration_seconds, 1)) || 's'
  ELSE floor(duration_seconds / 60)::BIGINT || 'm ' || round(duration_seconds - 60 * floor(duration_seconds / 60), 0)::BIGINT || 's' END AS duration, count(*) AS runs
FROM run_facts GROUP BY 1""")
QUERIES["x15_severity_rank"] = lambda spark, sf: V.finding_facts(spark, sf).groupBy("pr_id").agg(
    F.min(severity_rank(F.col("severity"))).cast("bigint").alias("worst"))
ORACLES["x15_severity_rank"] = query("""
SELECT pr_id, min(list_position(['critical', 'high', 'medium', 'low', 'info'], severity))::BIGINT AS worst FROM finding_facts GROUP BY pr_id""")


# --------------------------------------------------------------------------- the same from maintained sums
def kept_sums(spark, sf):
    """Sums of the findings after three batches: some come with the wrong flag and get feedback, some come twice under another id and go."""
    facts = V.finding_facts(spark, sf).join(V.pr_facts(spark, sf).select("pr_id", "repo_full_name"), "pr_id", "left")
    path, fid = work_dir(spark, "finding-sums"), F.crc32(F.col("finding_id").cast("binary"))
    wrong = facts.filter(fid % 5 == 0).withColumns({"false_positive": ~F.col("false_positive"), "human_feedback": F.lit(None).cast("string")})
    extra = facts.filter(fid % 4 == 1).withColumns({"finding_id": F.concat("finding_id", F.lit("-again")), "severity": F.lit("low")})
    R.apply_batch(R.FINDINGS, path, 0, R.FINDINGS.sums(facts.filter(fid % 5 != 0)), R.FINDINGS.sums(extra))
    R.apply_batch(R.FINDINGS, path, 1, R.FINDINGS.sums(wrong))
    feedback = facts.filter(fid % 5 == 0).select("finding_id", "false_positive", "human_feedback", F.lit(1).alias("seq"))
    for _ in range(2):  # run again after a failure
        R.apply_batch(R.FINDINGS, path, 2, R.FINDINGS.changed(wrong, G.apply_feedback(wrong, feedback, "finding_id", [F.desc("seq")])), R.FINDINGS.sums(extra, -1))
    return R.read(spark, R.FINDINGS, path)


QUERIES["a4_breakdown_from_sums"] = lambda spark, sf: R.breakdown(kept_sums(spark, sf), AS_OF)
ORACLES["a4_breakdown_from_sums"] = ORACLES["a4_severity_category_breakdown"]
QUERIES["a5_trend_from_sums"] = lambda spark, sf: R.daily_trend(kept_sums(spark, sf), AS_OF)
ORACLES["a5_trend_from_sums"] = ORACLES["a5_daily_trend"]
QUERIES["a7_repositories_from_sums"] = lambda spark, sf: R.top_repositories(kept_sums(spark, sf), AS_OF)
ORACLES["a7_repositories_from_sums"] = ORACLES["a7_top_repositories"]
QUERIES["a10_reviewed_rate_from_sums"] = lambda spark, sf: R.reviewed_false_positive_rate(kept_sums(spark, sf), AS_OF, 90).withColumn("period_days", F.col("period_days").cast("bigint"))
ORACLES["a10_reviewed_rate_from_sums"] = ORACLES["a10_reviewed_false_positive_rate"]


def run_sums(spark, sf):
    """Sums of the runs: first all as begun, then those that have ended as they ended."""
    runs, path = V.run_facts(spark, sf), work_dir(spark, "run-sums")
    begun = runs.filter("run_id % 3 = 0").withColumns({"status": F.lit("running"), "duration_seconds": F.lit(None).cast("double"), "tokens_used": F.lit(0), "findings_count": F.lit(0)})
    R.apply_batch(R.RUNS, path, 0, R.RUNS.sums(runs.filter("run_id % 3 <> 0")), R.RUNS.sums(begun))
    R.apply_batch(R.RUNS, path, 1, R.RUNS.changed(begun, runs.filter("run_id % 3 = 0")))
    return R.read(spark, R.RUNS, path)


QUERIES["a8_performance_from_sums"] = lambda spark, sf: R.agent_performance(run_sums(spark, sf), RUNS_AS_OF)
ORACLES["a8_performance_from_sums"] = ORACLES["a8_agent_performance"]
