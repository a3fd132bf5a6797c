"""Listings and dashboard aggregates over the stored tables.

Nothing reads the clock: every time-filtered function takes ``as_of`` and
counts rows from ``days`` before it up to, but not including, it.  Lists are
ordered with the id as last key, so equal times cannot reorder pages.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.functions.text import SEVERITIES

# Default latency bounds (seconds) of a request histogram.
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


def recent(rows: DataFrame, time: str, as_of: datetime, days: int) -> DataFrame:
    # the literals take the column's type, zoned or not, so the filter reaches the file scan
    first, end = (F.lit(t).cast(rows.schema[time].dataType) for t in (as_of - timedelta(days=days), as_of))
    return rows.filter((F.col(time) >= first) & (F.col(time) < end))


def listing(rows: DataFrame, time: str, key: str, limit: int | None = None, offset: int = 0, ascending: bool = False, **equals) -> DataFrame:
    """Filtered page of a table, newest first (F1, F3–F7); a filter given as None does not apply, nor does a limit of None."""
    for name, value in equals.items():
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    order = F.col(time).asc() if ascending else F.col(time).desc()
    rows = rows.orderBy(order, key)
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def by_id(rows: DataFrame, key: str, value) -> DataFrame:
    """Point lookup (F2)."""
    return rows.filter(F.col(key) == value)


def in_flight(prs: DataFrame) -> DataFrame:
    """Pull requests under review against those waiting (F8)."""
    bucket = F.when(F.col("status") == "reviewing", "reviewing").when(F.col("status").isin("pending", "queued"), "waiting")
    return prs.withColumn("bucket", bucket).filter(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count("*").alias("prs"))


def rate(part: Column, whole: Column, digits: int) -> Column:
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), digits)


def summary(prs: DataFrame, findings: DataFrame, runs: DataFrame, as_of: datetime, days: int = 7,
            runs_as_of: datetime | None = None) -> DataFrame:
    """The dashboard's headline numbers (A1, A2, A3): one aggregate per table; ``runs_as_of`` where the runs' clock is another."""
    p = recent(prs, "created_at", as_of, days).agg(F.count("*").alias("n"))
    f = recent(findings, "created_at", as_of, days).agg(
        F.count("*").alias("n"), rate(F.count_if("false_positive"), F.count("*"), 3).alias("fp"))
    r = recent(runs, "started_at", runs_as_of or as_of, days).agg(F.round(F.coalesce(F.avg("duration_seconds"), F.lit(0.0)), 1).alias("d"))
    one, found = prs.sparkSession.range(1), f.select(F.struct("n", "fp")).scalar()
    return one.select(
        F.lit(days).alias("period_days"), p.select("n").scalar().alias("total_prs_reviewed"), found["n"].alias("total_findings"),
        found["fp"].alias("false_positive_rate"), r.select("d").scalar().alias("avg_review_duration_seconds"))


def breakdown(findings: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Counts by severity and by category from one pass over the findings (A4)."""
    pairs = F.explode(F.array(
        F.struct(F.lit("severity").alias("dimension"), F.col("severity").alias("value")),
        F.struct(F.lit("category").alias("dimension"), F.col("category").alias("value"))))
    # counted by the pair first: the rows are not doubled, only the few groups are
    grouped = recent(findings, "created_at", as_of, days).groupBy("severity", "category").agg(F.count("*").alias("n"))
    return grouped.select(pairs.alias("d"), "n").groupBy("d.dimension", "d.value").agg(F.sum("n").alias("findings"))


def daily_trend(findings: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Findings per day and severity (A5)."""
    day = F.date_format(F.date_trunc("day", F.col("created_at")), "yyyy-MM-dd")
    return recent(findings, "created_at", as_of, days).groupBy(day.alias("date"), "severity").agg(F.count("*").alias("count")).orderBy("date", "severity")


def trend_pivot(trend: DataFrame) -> DataFrame:
    """Trend with one column per severity."""
    return trend.groupBy("date").pivot("severity", list(SEVERITIES)).agg(F.sum("count")).na.fill(0)


def top_repositories(prs: DataFrame, findings: DataFrame, as_of: datetime, days: int = 30, limit: int = 10) -> DataFrame:
    """Repositories with most findings.

    Findings are counted per pull request before the join, so the join moves
    one row per pull request and a busy repository is no hot key.
    """
    per_pr = recent(findings, "created_at", as_of, days).groupBy("pr_id").agg(F.count("*").alias("n"))
    counted = per_pr.join(prs.select("pr_id", F.col("repo_full_name").alias("repo")), "pr_id")
    return counted.groupBy("repo").agg(F.sum("n").alias("finding_count")).orderBy(F.desc("finding_count"), "repo").limit(limit)


def agent_performance(runs: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Runs, durations, tokens and findings per agent."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 1)
    return recent(runs, "started_at", as_of, days).groupBy("agent_type").agg(
        F.count("*").alias("run_count"), mean("duration_seconds").alias("avg_duration_seconds"),
        F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("total_tokens_used"), mean("findings_count").alias("avg_findings_per_run"))


def severity_by_change(findings: DataFrame) -> DataFrame:
    """Severity counts of each pull request."""
    return findings.groupBy("pr_id", "severity").agg(F.count("*").alias("findings"))


def reviewed_false_positive_rate(findings: DataFrame, as_of: datetime, days: int = 30, pr_id=None) -> DataFrame:
    """False positives among findings with human feedback (A10)."""
    rows = recent(findings, "created_at", as_of, days).filter(F.col("human_feedback").isNotNull())
    if pr_id is not None:
        rows = rows.filter(F.col("pr_id") == pr_id)
    wrong = F.count_if("false_positive")
    return rows.agg(
        F.count("*").alias("total_reviewed"), wrong.alias("false_positives"), rate(wrong, F.count("*"), 4).alias("false_positive_rate"),
        F.lit(days).alias("period_days"))


def request_counts(log: DataFrame) -> DataFrame:
    """Requests by method, endpoint and status."""
    return log.groupBy("method", "endpoint", "status_code").agg(F.count("*").alias("requests"))


def latency_histogram(log: DataFrame, *keys: str, bounds=LATENCY_BOUNDS) -> DataFrame:
    """Cumulative request counts at each latency bound (A14), one pass and one row per bound."""
    edges = [*bounds, float("inf")]
    counts = log.groupBy(*keys).agg(*[F.count_if(F.col("latency") <= b).alias(f"b{i}") for i, b in enumerate(edges)])
    return counts.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("requests")) for i, b in enumerate(edges)])))


def finding_counts(findings: DataFrame) -> DataFrame:
    """Findings by severity and category."""
    return findings.groupBy("severity", "category").agg(F.count("*").alias("findings"))
