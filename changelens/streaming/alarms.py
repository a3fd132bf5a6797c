"""Alerts that run on the stream itself: pending, firing, resolved.

One state machine per key.  Rows wait in the state until the watermark has passed them, so they are taken in the order of their times whatever the order of arrival.
Timers on event time do the rest: one when a condition has held long enough, so that an alert fires although no row comes, and one when an evaluation stays out,
which ends the run of a rate.  A key whose condition does not hold and that waits for no row keeps no state, but for the last known values of a gauge.

The transitions are the batch results of ``alerts.sustained`` and ``alerts.lasting``, told while they happen; ``periods`` puts them together again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from changelens.streaming import alerts as A

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NAN = float("nan")
ROW, CHUNK = np.dtype([("at", "<i8"), ("part", "<f8"), ("whole", "<f8")]), 16_384  # a row that waits, and how many are packed together
PENDING, FIRING, RESOLVED, INACTIVE = "pending", "firing", "resolved", "inactive"


class Alarm(StatefulProcessor):
    """Transitions of one key.

    ``seconds``: how long the condition must hold.  ``step``: seconds between the evaluations of a rate, whose run ends where one is missing; None for
    a gauge, which keeps its value until the next row.  ``condition`` of (part, whole); a gauge carries the last known value of each.
    """

    def __init__(self, keys: Sequence[str], seconds: int, step: int | None, condition: Callable[[float | None, float | None], bool]) -> None:
        self.keys, self.seconds, self.step, self.condition = list(keys), seconds * 1_000_000, step and step * 1_000_000, condition

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # rows that the watermark has not passed, in packed chunks under their first and last times: a batch costs a call for each chunk and not some for each row
        self.waiting = handle.getMapState("waiting", "first long, last long", "rows binary")
        self.run = handle.getValueState("run", "begun long, last long, fired boolean")
        self.known = handle.getValueState("known", "part double, whole double")

    def _timer(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def _wait(self, rows: np.ndarray) -> None:
        for start in range(0, len(rows), CHUNK):
            chunk = rows[start:start + CHUNK]
            place, packed = (int(chunk["at"].min()), int(chunk["at"].max())), chunk.tobytes()
            if self.waiting.containsKey(place):
                packed = self.waiting.getValue(place)[0] + packed
            self.waiting.updateValue(place, (packed,))

    def _due(self, now: int) -> np.ndarray | None:
        """Takes the rows up to ``now`` from those that wait, in order of their times; None if there is none."""
        places = [tuple(place) for place in self.waiting.keys()]
        reached = [place for place in places if place[0] <= now]
        if not reached:
            return None
        chunks = []
        for place in reached:
            chunks.append(np.frombuffer(self.waiting.getValue(place)[0], ROW))
            self.waiting.removeKey(place)
        rows = np.concatenate(chunks)
        del chunks
        rows = rows[np.argsort(rows["at"], kind="stable")]
        due = int(np.searchsorted(rows["at"], now, side="right"))
        self._wait(rows[due:])
        first = [place[0] for place in places if place[0] > now] + rows["at"][due:due + 1].tolist()
        if first:
            self._timer(min(first))
        rows = rows[:due]
        # of several samples of one time the largest; unknown values are NaN
        starts = np.flatnonzero(np.concatenate(([True], rows["at"][1:] != rows["at"][:-1])))
        if len(starts) == len(rows):
            return rows
        merged = rows[starts]
        for name in ("part", "whole"):
            merged[name] = np.fmax.reduceat(rows[name], starts)
        return merged

    def _holds(self, rows: np.ndarray) -> np.ndarray:
        ok = np.zeros(len(rows), dtype=bool)
        for start in range(0, len(rows), CHUNK):
            chunk = rows[start:start + CHUNK]
            ok[start:start + CHUNK] = [bool(self.condition(part if part == part else None, whole if whole == whole else None)) for part, whole in zip(chunk["part"].tolist(), chunk["whole"].tolist(), strict=True)]
        return ok

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for frame in rows:
            given = np.empty(len(frame), ROW)
            given["at"], given["part"], given["whole"] = frame["at"].astype("int64"), frame["part"].astype(float), frame["whole"].astype(float)
            self._wait(given)
            if len(given):
                first = min(int(given["at"].min()), first if first is not None else int(given["at"].min()))
        if first is not None:
            self._timer(first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        told: list[tuple[str, int, int]] = []
        run = list(self.run.get()) if self.run.exists() else None
        due = self._due(now)
        if due is not None:
            run = self._gauge(run, due, told) if self.step is None else self._rate(run, due, told)
        run = self._pass(run, now, told)
        if run is None:
            self.run.clear()
        else:
            self.run.update(tuple(run))
            if self.step is not None:
                self._timer(run[1] + self.step + 1000)
            elif not run[2]:
                self._timer(run[0] + self.seconds)
        if told:
            yield pd.DataFrame([(*key, state, begun, at) for state, begun, at in told], columns=[*self.keys, "state", "pending_us", "at_us"])

    def _gauge(self, run: list | None, rows: np.ndarray, told: list) -> list | None:
        """Rows of a gauge: each carries the last known values, and only those where the condition begins or ends to hold tell something."""
        known = list(self.known.get()) if self.known.exists() else [None, None]
        rows = rows.copy()
        for i, name in enumerate(("part", "whole")):
            last = np.maximum.accumulate(np.where(np.isnan(rows[name]), -1, np.arange(len(rows))))
            rows[name] = np.where(last >= 0, rows[name][last], NAN if known[i] is None else known[i])
        known = [float(v) if v == v else None for v in (rows["part"][-1], rows["whole"][-1])]
        if known != [None, None]:
            self.known.update(tuple(known))
        ok = self._holds(rows)
        before = np.concatenate(([run is not None], ok[:-1]))
        for at, begins in zip(rows["at"][ok != before].tolist(), ok[ok != before].tolist(), strict=True):
            run = self._pass(run, at, told)
            if begins:
                run = [at, at, False]
                told.append((PENDING, at, at))
            else:
                run = self._end(run, at, told)
        if run is not None:
            run[1] = int(rows["at"][-1])
        return run

    def _rate(self, run: list | None, rows: np.ndarray, told: list) -> list | None:
        """Evaluations of a rate, one after the other."""
        for at, ok in zip(rows["at"].tolist(), self._holds(rows).tolist(), strict=True):
            run = self._pass(run, at, told)
            if ok:
                if run is None:
                    run = [at, at, False]
                    told.append((PENDING, at, at))
                run[1] = at
                if not run[2] and at - run[0] >= self.seconds:
                    run[2] = True
                    told.append((FIRING, run[0], run[0] + self.seconds))
            elif run is not None:
                # a rate holds up to its last evaluation
                run = self._end(run, run[1], told)
        return run

    def _pass(self, run: list | None, now: int, told: list) -> list | None:
        """What time alone does up to ``now``."""
        if run is None:
            return None
        if self.step is not None:
            late = now > run[1] + self.step
            return self._end(run, run[1], told) if late else run
        if not run[2] and now - run[0] >= self.seconds:
            run[2] = True
            told.append((FIRING, run[0], run[0] + self.seconds))
        return run

    def _end(self, run: list, at: int, told: list) -> None:
        told.append((RESOLVED if run[2] else INACTIVE, run[0], at))

    def close(self) -> None:
        pass


def watch(rows: DataFrame, seconds: int, condition: Callable[[float | None, float | None], bool], keys: Sequence[str] = (), step: int | None = 30, time: str = "ends_at",
          part: str = "part", whole: str = "whole") -> DataFrame:
    """(keys, state, pending_from, at): the transitions of a condition on a stream with a watermark; see ``Alarm``."""
    names = list(keys) or ["_all"]
    shaped = rows.select(*[F.lit(0).alias("_all")] * (not keys), *keys, F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col(part).cast("double").alias("part"), F.col(whole).cast("double").alias("whole"))
    kinds = {f.name: f.dataType.simpleString() for f in shaped.schema.fields}
    out = shaped.groupBy(*names).transformWithStateInPandas(
        Alarm(names, seconds, step, condition), ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", state string, pending_us bigint, at_us bigint", "append", "eventTime")
    return out.select(*keys, "state", F.timestamp_micros("pending_us").alias("pending_from"), F.timestamp_micros("at_us").alias("at"))


def start(transitions: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write the transitions as files; the state lies in RocksDB, which these timers need."""
    spark: SparkSession = transitions.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:  # a query takes the settings of the moment it starts
        writer = transitions.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        spark.conf.set(name, before)


def periods(transitions: DataFrame, until: Column | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, pending_from, firing_from, firing_to) of written transitions, as the batch alerts give; an open alert goes on to ``until`` (null without it)."""
    by = [*keys, "pending_from"]
    at = lambda state: F.min(F.when(F.col("state") == state, F.col("at")))
    told = transitions.groupBy(*by).agg(at(FIRING).alias("firing_from"), at(RESOLVED).alias("firing_to")).filter("firing_from IS NOT NULL")
    if until is None:
        return told
    return told.withColumn("firing_to", F.coalesce("firing_to", F.greatest(F.col("pending_from"), until))).filter(F.col("firing_from") <= F.col("firing_to"))


def error_alarm(log: DataFrame, time: str, failed: Column, of: Column | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """``alerts.error_alert`` on a stream."""
    return watch(A.ratio(log, time, failed, "5 minutes", keys=keys, of=of), A.ERROR_FOR, _above(A.ERROR_RATIO), keys)


def failure_alarm(runs: DataFrame, time: str, failed: Column, ended: Column) -> DataFrame:
    """``alerts.failure_alert`` on a stream."""
    return watch(A.ratio(runs, time, failed, "10 minutes", of=ended), A.FAILURE_FOR, _above(A.FAILURE_RATIO))


def false_positive_alarm(findings: DataFrame, time: str, wrong: Column, of: Column | None = None) -> DataFrame:
    """``alerts.false_positive_alert`` on a stream."""
    return watch(A.ratio(findings, time, wrong, "1 hour", of=of), A.FALSE_POSITIVE_FOR, _above(A.FALSE_POSITIVE_RATIO))


def loop_alarm(runs: DataFrame, time: str, steps: str, key: str) -> DataFrame:
    """``alerts.loop_alert`` on a stream."""
    sums = A.windowed(runs, time, {"part": F.col(steps)}, "10 minutes", keys=[key]).withColumn("whole", F.lit(None).cast("double"))
    return watch(sums, A.LOOP_FOR, lambda part, _: part is not None and part > A.LOOP_STEPS, [key])


def memory_alarm(samples: DataFrame, time: str, series: str, value: str, part: str, whole: str, keys: Sequence[str], watermark: str = "10 minutes") -> DataFrame:
    """``alerts.memory_alert`` on a stream of samples of two gauges."""
    return watch(_gauges(samples, time, series, value, part, whole, watermark), A.MEMORY_FOR, _above(A.MEMORY_RATIO), keys, None, time)


def pool_alarm(samples: DataFrame, time: str, series: str, value: str, part: str, whole: str, keys: Sequence[str], watermark: str = "10 minutes") -> DataFrame:
    """``alerts.pool_alert`` on a stream of samples of two gauges."""
    few = lambda left, size: left is not None and size is not None and size - left < A.POOL_LEFT
    return watch(_gauges(samples, time, series, value, part, whole, watermark), A.POOL_FOR, few, keys, None, time)


def _gauges(samples: DataFrame, time: str, series: str, value: str, part: str, whole: str, watermark: str) -> DataFrame:
    one = lambda name: F.when(F.col(series) == name, F.col(value))
    known = samples.withWatermark(time, watermark) if samples.isStreaming else samples
    return known.filter(F.col(series).isin(part, whole)).withColumns({"part": one(part), "whole": one(whole)})


def _above(limit: float) -> Callable[[float | None, float | None], bool]:
    return lambda part, whole: bool(whole) and part is not None and part / whole > limit
