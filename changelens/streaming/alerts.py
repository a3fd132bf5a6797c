"""Windowed rates, ratios and quantiles, and conditions that last.

Rows are first added up per evaluation step; only those small sums are spread
over the overlapping windows.  A row then counts once per key and step instead
of once per window.  The same functions run on streams in append mode, where
rows later than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.operators.metrics import LATENCY_BOUNDS

STEP = "30 seconds"
# ---------------------------------------------------------------------------
# Thresholds of the alerts and how long (seconds) they must hold.
# ---------------------------------------------------------------------------
ERROR_RATIO, ERROR_FOR = 0.05, 300
LOOP_STEPS, LOOP_FOR = 15, 120
LATENCY_P95, LATENCY_FOR = 30, 300
BACKLOG, BACKLOG_FOR = 50, 900
LAG, LAG_FOR = 100, 600
FAILURE_RATIO, FAILURE_FOR = 0.1, 600
POOL_LEFT, POOL_FOR = 2, 300
FALSE_POSITIVE_RATIO, FALSE_POSITIVE_FOR = 0.3, 1800
MEMORY_RATIO, MEMORY_FOR = 0.85, 300
# Bounds that go on beyond the latency alert's threshold, so that its quantile can be told from it.
ALERT_BOUNDS = (*LATENCY_BOUNDS, 15.0, 20.0, 30.0, 45.0, 60.0, 90.0, 120.0, 180.0, 300.0, 600.0, 1200.0)


def windowed(rows: DataFrame, time: str, sums: dict[str, Column], window: str, step: str = STEP, keys: Sequence[str] = (), watermark: str = "10 minutes") -> DataFrame:
    """Sums over windows of the given length ending at every step."""
    if rows.isStreaming:
        rows = rows.withWatermark(time, watermark)
    steps = rows.groupBy(F.window(time, step).alias("_step"), *keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    sliding = F.window(F.window_time("_step"), window, step)
    return steps.groupBy(sliding.alias("_w"), *keys).agg(*[F.sum(n).alias(n) for n in sums]).select(
        F.col("_w.end").alias("ends_at"), *keys, *sums)


def _flag(test: Column) -> Column:
    return F.when(test, 1).otherwise(0)


def ratio(rows: DataFrame, time: str, part: Column, window: str, step: str = STEP, keys: Sequence[str] = (), of: Column | None = None) -> DataFrame:
    """Share of rows for which ``part`` holds among those of ``of``."""
    whole = F.lit(True) if of is None else of
    sums = windowed(rows, time, {"part": _flag(part & whole), "whole": _flag(whole)}, window, step, keys)
    return sums.withColumn("ratio", F.try_divide("part", "whole"))


def runaway(runs: DataFrame, time: str, steps: str, key: str, window: str = "10 minutes", step: str = STEP, limit: int = LOOP_STEPS) -> DataFrame:
    """Keys with more than ``limit`` steps within the window."""
    return windowed(runs, time, {"steps": F.col(steps)}, window, step, [key]).filter(F.col("steps") > limit)


def histogram_quantile(q: float, counts: Sequence[str], bounds: Sequence[float]) -> Column:
    """Quantile from cumulative bucket counts by linear interpolation; the last count is the total."""
    total = F.col(counts[-1])
    rank = total * q
    out = F.when(total == 0, F.lit(None))
    for i, bound in enumerate(bounds):
        low = F.lit(0.0 if i == 0 else float(bounds[i - 1]))
        under = F.lit(0) if i == 0 else F.col(counts[i - 1])
        out = out.when(F.col(counts[i]) >= rank, low + (bound - low) * F.coalesce(F.try_divide(rank - under, F.col(counts[i]) - under), F.lit(0.0)))
    # beyond the last bound nothing is known, so the bound itself is given
    return out.otherwise(float(bounds[-1]))


def latency_quantiles(log: DataFrame, time: str, latency: str, window: str = "5 minutes", step: str = STEP, keys: Sequence[str] = ("endpoint",),
                      quantiles: Sequence[float] = (0.5, 0.95, 0.99), bounds: Sequence[float] = ALERT_BOUNDS) -> DataFrame:
    """Latency quantiles per window and endpoint from bucket counts (T8); the error is at most the width of the bucket."""
    counts = {f"b{i}": _flag(F.col(latency) <= b) for i, b in enumerate(bounds)} | {"total": F.lit(1)}
    sums = windowed(log, time, counts, window, step, keys)
    return sums.select("ends_at", *keys, *[histogram_quantile(q, list(counts), bounds).alias(f"p{round(q * 100)}") for q in quantiles])


def latency_sketches(log: DataFrame, time: str, latency: str, window: str = "5 minutes", step: str = STEP, keys: Sequence[str] = ("endpoint",),
                     quantiles: Sequence[float] = (0.5, 0.95, 0.99), size: int = 400, watermark: str = "10 minutes") -> DataFrame:
    """Latency quantiles per window and endpoint from mergeable KLL sketches (T8): values that occurred, at every height, with a bounded error of rank.

    Each row goes into one sketch, that of its step; a window merges its steps' sketches, some kilobytes each however many rows they stand for.  With ``size`` k a
    quantile's rank is off by less than 1.66 / k for single quantiles with 99% confidence (0.42% at 400), and exact up to k rows a window.  Null latencies do not count.
    """
    known = log.filter(F.col(latency).isNotNull())
    if known.isStreaming:
        known = known.withWatermark(time, watermark)
    steps = known.groupBy(F.window(time, step).alias("_step"), *keys).agg(F.kll_sketch_agg_double(F.col(latency).cast("double"), size).alias("_sketch"))
    sliding = F.window(F.window_time("_step"), window, step)
    merged = steps.groupBy(sliding.alias("_w"), *keys).agg(F.kll_merge_agg_double("_sketch", size).alias("_sketch"))
    at = F.kll_sketch_get_quantile_double("_sketch", F.array(*[F.lit(float(q)) for q in quantiles]))
    told = merged.select(F.col("_w.end").alias("ends_at"), *keys, at.alias("_at"))
    return told.select("ends_at", *keys, *[F.col("_at")[i].alias(f"p{round(q * 100)}") for i, q in enumerate(quantiles)])


def backlog(rows: DataFrame, time: str, change: Column, step: str = STEP, keys: Sequence[str] = ()) -> DataFrame:
    """Running total of arrivals minus completions at every step.

    Only one row per key and step reaches the running sum.
    """
    steps = rows.groupBy(F.window(time, step).alias("_step"), *keys).agg(F.sum(change).alias("_change"))
    total = F.sum("_change").over(Window.partitionBy(*keys).orderBy("_step").rowsBetween(Window.unboundedPreceding, 0))
    return steps.select(F.col("_step.end").alias("ends_at"), *keys, total.alias("waiting"))


def hourly(rows: DataFrame, time: str, keys: Sequence[str] = (), watermark: str = "10 minutes") -> DataFrame:
    """Rows per hour."""
    if rows.isStreaming:
        rows = rows.withWatermark(time, watermark)
    return rows.groupBy(F.window(time, "1 hour").alias("_w"), *keys).agg(F.count("*").alias("n")).select(F.col("_w.end").alias("ends_at"), *keys, "n")


def mean_by_window(rows: DataFrame, time: str, value: str, window: str, step: str = STEP, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of a value over windows."""
    sums = windowed(rows, time, {"_sum": F.col(value), "_n": _flag(F.col(value).isNotNull())}, window, step, keys)
    return sums.select("ends_at", *keys, F.try_divide("_sum", "_n").alias("mean"))


def gauge_ratio(samples: DataFrame, time: str, series: str, value: str, part: str, whole: str, window: str, keys: Sequence[str] = ()) -> DataFrame:
    """Last sample of one gauge over the last of another, per window."""
    last = lambda name: F.max_by(value, F.when(F.col(series) == name, F.col(time)))
    return samples.groupBy(F.window(time, window).alias("_w"), *keys).agg(last(part).alias("part"), last(whole).alias("whole")).select(
        F.col("_w.end").alias("ends_at"), *keys, "part", "whole", F.try_divide("part", "whole").alias("ratio"))


def lasting(rows: DataFrame, condition: Column, seconds: int, keys: Sequence[str] = (), time: str = "ends_at", until: Column | None = None) -> DataFrame:
    """Times of at least ``seconds`` during which a condition on a gauge held.

    A gauge keeps its value up to the key's next row, so each row is an interval and no row is needed for
    every evaluation.  The last row of a key holds until ``until``, the time of the evaluation.
    """
    order = Window.partitionBy(*keys).orderBy(time)
    end = F.coalesce(F.lead(time).over(order), F.col(time) if until is None else F.greatest(F.col(time), until))
    held = rows.withColumns({"_ok": F.coalesce(condition, F.lit(False)), "_end": end})
    # rows of one unbroken time have the same number of failing rows before them
    runs = held.withColumn("_run", F.count_if(~F.col("_ok")).over(order)).filter("_ok").groupBy(*keys, "_run").agg(
        F.min(time).alias("_from"), F.max("_end").alias("_to"))
    lasted = runs.filter(F.unix_micros("_to") - F.unix_micros("_from") >= seconds * 1_000_000)
    return lasted.select(
        *keys, F.col("_from").alias("pending_from"), F.timestamp_micros(F.unix_micros("_from") + seconds * 1_000_000).alias("firing_from"), F.col("_to").alias("firing_to"))


def gauge_pairs(samples: DataFrame, time: str, series: str, value: str, part: str, whole: str, keys: Sequence[str] = ()) -> DataFrame:
    """The last known values of two gauges at every time that one of them was sampled."""
    at = samples.filter(F.col(series).isin(part, whole)).groupBy(*keys, F.col(time).alias("ends_at")).agg(
        *[F.max(F.when(F.col(series) == name, F.col(value))).alias(column) for name, column in ((part, "part"), (whole, "whole"))])
    known = Window.partitionBy(*keys).orderBy("ends_at").rowsBetween(Window.unboundedPreceding, 0)
    return at.withColumns({c: F.last(c, ignorenulls=True).over(known) for c in ("part", "whole")})


def error_alert(log: DataFrame, time: str, failed: Column, keys: Sequence[str] = ()) -> DataFrame:
    """More than 5% of the requests of five minutes failed, for five minutes."""
    return sustained(ratio(log, time, failed, "5 minutes", keys=keys), F.col("ratio") > ERROR_RATIO, ERROR_FOR, keys=keys)


def loop_alert(runs: DataFrame, time: str, steps: str, key: str) -> DataFrame:
    """More than 15 steps for one key within ten minutes, for two minutes."""
    return sustained(runaway(runs, time, steps, key), F.lit(True), LOOP_FOR, keys=[key])


def latency_alert(log: DataFrame, time: str, latency: str, keys: Sequence[str] = ("endpoint",)) -> DataFrame:
    """The 95th percentile of five minutes above 30 seconds, for five minutes."""
    return sustained(latency_quantiles(log, time, latency, keys=keys, quantiles=(0.95,)), F.col("p95") > LATENCY_P95, LATENCY_FOR, keys=keys)


def backlog_alert(rows: DataFrame, time: str, change: Column, keys: Sequence[str] = (), until: Column | None = None) -> DataFrame:
    """More than 50 waiting, for 15 minutes, whether or not anything arrives meanwhile."""
    return lasting(backlog(rows, time, change, keys=keys), F.col("waiting") > BACKLOG, BACKLOG_FOR, keys, until=until)


def lag_alert(rows: DataFrame, time: str, change: Column, keys: Sequence[str] = (), until: Column | None = None) -> DataFrame:
    """A consumer more than 100 messages behind, for ten minutes."""
    return lasting(backlog(rows, time, change, keys=keys), F.col("waiting") > LAG, LAG_FOR, keys, until=until)


def failure_alert(runs: DataFrame, time: str, failed: Column, ended: Column) -> DataFrame:
    """More than 10% of the tasks ended within ten minutes failed, for ten minutes."""
    return sustained(ratio(runs, time, failed, "10 minutes", of=ended), F.col("ratio") > FAILURE_RATIO, FAILURE_FOR)


def false_positive_alert(findings: DataFrame, time: str, wrong: Column) -> DataFrame:
    """More than 30% of the findings of an hour are false positives, for half an hour."""
    return sustained(ratio(findings, time, wrong, "1 hour"), F.col("ratio") > FALSE_POSITIVE_RATIO, FALSE_POSITIVE_FOR)


def pool_alert(pairs: DataFrame, keys: Sequence[str] = (), until: Column | None = None) -> DataFrame:
    """Size less available connections below two, for five minutes (T13); ``part`` is what is available, ``whole`` the size."""
    return lasting(pairs, F.col("whole") - F.col("part") < POOL_LEFT, POOL_FOR, keys, until=until)


def memory_alert(pairs: DataFrame, keys: Sequence[str] = (), until: Column | None = None) -> DataFrame:
    """Memory above 85% of its limit, for five minutes."""
    return lasting(pairs, F.try_divide("part", "whole") > MEMORY_RATIO, MEMORY_FOR, keys, until=until)


def sustained(evaluated: DataFrame, condition: Column, lasting: int, step: int = 30, keys: Sequence[str] = ()) -> DataFrame:
    """Times during which a condition held at every step for ``lasting`` seconds.

    Evaluations are numbered within their key; time minus number is constant
    exactly on unbroken runs.  A missing evaluation breaks a run, as a rate
    over no rows is no value; for gauges, which keep theirs, see ``lasting``.
    """
    true = evaluated.filter(condition).withColumn("_t", F.unix_timestamp("ends_at"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_t"))
    runs = true.withColumn("_run", F.col("_t") - number * step).groupBy(*keys, "_run").agg(F.min("_t").alias("from_s"), F.max("_t").alias("to_s"))
    firing = runs.filter(F.col("to_s") - F.col("from_s") >= lasting)
    return firing.select(
        *keys, F.timestamp_seconds("from_s").alias("pending_from"), F.timestamp_seconds(F.col("from_s") + lasting).alias("firing_from"),
        F.timestamp_seconds("to_s").alias("firing_to"))
