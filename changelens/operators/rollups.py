"""Dashboards from maintained sums with retraction.

A roll-up holds sums of measures by day and a few dimensions.  Every batch adds signed sums: new rows count up, deleted rows down, changed rows down as they
were and up as they are.  Sums of sums in any grouping are the sums over the facts that are left, so a dashboard reads a few rows for each day and never the facts.
A batch is one folder named by its number and overwritten when it is run again, so it counts once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.operators.metrics import rate


@dataclass(frozen=True)
class Cube:
    """``time``: the column whose day counts; ``dims``: columns that are kept; ``measures``: whole-number columns that are summed, names to expressions in SQL."""

    time: str
    dims: Sequence[str]
    measures: Mapping[str, str]

    def sums(self, rows: DataFrame, sign: int = 1) -> DataFrame:
        """(day, dims, measures) of rows, counted up or (sign -1) down."""
        day = F.date_trunc("day", F.col(self.time)).cast("date").alias("day")
        counted = rows.groupBy(day, *self.dims).agg(*[F.sum(F.expr(e).cast("bigint")).alias(n) for n, e in self.measures.items()])
        return counted.select("day", *self.dims, *[(F.coalesce(F.col(n), F.lit(0)) * sign).alias(n) for n in self.measures])

    def total(self, deltas: DataFrame) -> DataFrame:
        """Deltas added up; groups of which nothing is left are gone."""
        added = deltas.groupBy("day", *self.dims).agg(*[F.sum(n).alias(n) for n in self.measures])
        return added.filter(F.greatest(*[F.abs(n) for n in self.measures], F.lit(0)) > 0)

    def changed(self, before: DataFrame, after: DataFrame) -> DataFrame:
        """Deltas of rows that were ``before`` and are ``after``."""
        return self.total(self.sums(before, -1).unionByName(self.sums(after)))


#: Findings with their repository; what the dashboards of findings show.
FINDINGS = Cube("created_at", ("repo_full_name", "agent_type", "severity", "category"), {
    "findings": "1", "false_positives": "if(false_positive, 1, 0)", "reviewed": "if(human_feedback is not null, 1, 0)",
    "reviewed_false_positives": "if(human_feedback is not null and false_positive, 1, 0)"})
#: Runs of agents; durations in hundredths of a second, which add up exactly.
RUNS = Cube("started_at", ("agent_type", "status"), {
    "runs": "1", "timed": "if(duration_seconds is not null, 1, 0)", "hundredths": "cast(round(duration_seconds * 100) as bigint)", "tokens": "tokens_used", "found": "findings_count"})


def apply_batch(cube: Cube, path: str, batch: int, *deltas: DataFrame) -> None:
    """Write the deltas of a batch; the same batch again replaces them."""
    added = deltas[0]
    for more in deltas[1:]:
        added = added.unionByName(more)
    cube.total(added).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def _schema(cube: Cube) -> str:
    return "day date, " + ", ".join(f"`{d}` string" for d in cube.dims) + ", " + ", ".join(f"{m} bigint" for m in cube.measures) + ", batch bigint"


def read(spark: SparkSession, cube: Cube, path: str) -> DataFrame:
    """The sums as of the last batch."""
    return cube.total(spark.read.schema(_schema(cube)).parquet(path).drop("batch"))


def compact(spark: SparkSession, cube: Cube, path: str, upto: int, out: str) -> None:
    """Write the batches up to ``upto`` as one, and later ones as they are, to a new folder."""
    stored = spark.read.schema(_schema(cube)).parquet(path)
    cube.total(stored.filter(F.col("batch") <= upto).drop("batch")).write.mode("overwrite").parquet(f"{out}/batch={upto}")
    stored.filter(F.col("batch") > upto).write.mode("append").partitionBy("batch").parquet(out)


def _days(sums: DataFrame, as_of: datetime, days: int) -> DataFrame:
    if (as_of.hour, as_of.minute, as_of.second, as_of.microsecond) != (0, 0, 0, 0):
        raise ValueError("sums by day answer for whole days: as_of must be midnight")
    return sums.filter((F.col("day") >= F.lit((as_of - timedelta(days=days)).date())) & (F.col("day") < F.lit(as_of.date())))


def daily_trend(sums: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """``metrics.daily_trend`` from sums of findings (A5)."""
    by_day = _days(sums, as_of, days).groupBy(F.date_format("day", "yyyy-MM-dd").alias("date"), "severity").agg(F.sum("findings").alias("count"))
    return by_day.filter(F.col("count") > 0).orderBy("date", "severity")


def breakdown(sums: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """``metrics.breakdown`` from sums of findings (A4)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("severity", "category")]))
    told = _days(sums, as_of, days).select(pairs.alias("d"), "findings").groupBy("d.dimension", "d.value").agg(F.sum("findings").alias("findings"))
    return told.filter(F.col("findings") > 0)


def top_repositories(sums: DataFrame, as_of: datetime, days: int = 30, limit: int = 10) -> DataFrame:
    """``metrics.top_repositories`` from sums of findings."""
    told = _days(sums, as_of, days).filter("repo_full_name IS NOT NULL").groupBy(F.col("repo_full_name").alias("repo")).agg(F.sum("findings").alias("finding_count"))
    return told.filter("finding_count > 0").orderBy(F.desc("finding_count"), "repo").limit(limit)


def reviewed_false_positive_rate(sums: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """``metrics.reviewed_false_positive_rate`` from sums of findings (A10)."""
    whole: Column = F.coalesce(F.sum("reviewed"), F.lit(0))
    wrong: Column = F.coalesce(F.sum("reviewed_false_positives"), F.lit(0))
    return _days(sums, as_of, days).agg(whole.alias("total_reviewed"), wrong.alias("false_positives"), rate(wrong, whole, 4).alias("false_positive_rate"), F.lit(days).alias("period_days"))


def agent_performance(sums: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """``metrics.agent_performance`` from sums of runs."""
    told = _days(sums, as_of, days).groupBy("agent_type").agg(*[F.sum(m).alias(m) for m in RUNS.measures]).filter("runs > 0")
    return told.select(
        "agent_type", F.col("runs").alias("run_count"), F.round(F.coalesce(F.try_divide("hundredths", F.col("timed") * 100), F.lit(0.0)), 1).alias("avg_duration_seconds"),
        F.col("tokens").alias("total_tokens_used"), F.round(F.col("found") / F.col("runs"), 1).alias("avg_findings_per_run"))
