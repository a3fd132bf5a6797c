"""Pull-request events as a stream: gate, upsert, incremental scan, progress.

The functions are plain DataFrame functions, so a batch and a stream run the
same code; the ``*_stream`` functions add source, state and sink.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from changelens.functions.text import once
from changelens.operators.findings import latest_per_key
from changelens.sources.landed import disposition

_TEXTS = ("event_type", "action", "pr_title", "pr_author", "base_branch", "head_branch", "diff_url", "html_url", "body", "repo_full_name")
_COUNTS = ("files_changed", "additions", "deletions")
_VALUE = ", ".join(f"{c} string" for c in (*_TEXTS, "pr_number", *_COUNTS))

# Event key of each stored field, and what a new row gets when the key is absent.
FIELDS = {
    "title": "pr_title", "author": "pr_author", "base_branch": "base_branch", "head_branch": "head_branch", "diff_url": "diff_url",
    "html_url": "html_url", "body": "body", "files_changed": "files_changed", "additions": "additions", "deletions": "deletions",
}
NEW_ROW = {"author": "unknown", "base_branch": "main", "head_branch": "unknown"}
KEY = ("repo_full_name", "pr_number")


def read_messages(spark: SparkSession, path: str, schema, files_per_trigger: int = 10, fmt: str = "parquet") -> DataFrame:
    """Message stream from files (S1); records of a Kafka topic go through ``from_kafka``."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def from_kafka(records: DataFrame) -> DataFrame:
    """Records with Kafka's columns (key, value, partition, offset, timestamp) as messages.

    All events of a pull request have one key and so one partition, in which offsets give their order; partition and offset together
    are the number that is unique and the same on redelivery.
    """
    return records.select(
        (F.col("partition").cast("bigint") * 2**40 + F.col("offset")).alias("seq"), F.col("timestamp").alias("ts"),
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def publish(records: DataFrame, fmt: str = "kafka", **options: str) -> None:
    """Write key and value of published events (S2) to a topic, or with another format to a table."""
    records.select(F.col("key").cast("binary"), F.col("value").cast("binary")).write.format(fmt).mode("append").options(**options).save()


def publish_stream(records: DataFrame, checkpoint: str, fmt: str = "kafka", available_now: bool = True, **options: str) -> StreamingQuery:
    """The same for a stream."""
    writer = records.select(F.col("key").cast("binary"), F.col("value").cast("binary")).writeStream.format(fmt).options(**options).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def parse(messages: DataFrame) -> DataFrame:
    """Event columns of each JSON value, and which keys it has: absent is not null."""
    parsed = once(messages.select("seq", "ts", "value"), v=F.from_json("value", _VALUE), present=F.json_object_keys("value"))
    whole = lambda c: F.col(f"v.{c}").try_cast("int").alias(c)
    return parsed.select("seq", "ts", *[F.col(f"v.{c}") for c in _TEXTS], whole("pr_number"), *[whole(c) for c in _COUNTS], "present")


def gate(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events to process, and the others with their disposition."""
    marked = once(events, disposition=disposition(F.col("event_type"), F.col("action"), F.col("repo_full_name"), F.col("pr_number")))
    accepted = F.col("disposition") == "accepted"
    return marked.filter(accepted).drop("disposition"), marked.filter(~F.coalesce(accepted, F.lit(False)))


def deduplicate(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Drop redelivered events by their id (T4); a stream remembers ids within the watermark.

    A batch is spread by the id before anything is sorted, so a task holds its part of the shuffle and not a whole row group of a file.
    """
    if events.isStreaming:
        return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["seq"])
    return events.repartition("seq").dropDuplicates(["seq"])


def fold(events: DataFrame) -> DataFrame:
    """Net effect of accepted events per pull request.

    Per field the value of the last event that has the key, with that event's
    number.  Folds of folds give the same result in any grouping, so partial
    aggregation applies and a busy pull request is no hot key.
    """
    # one bit for each key that an event has: the rows to be sorted carry a number in place of an array of names
    given = reduce(Column.bitwiseOR, [F.when(F.array_contains("present", key), 1 << i).otherwise(0) for i, key in enumerate(FIELDS.values())])
    synced = F.when(F.col("action") == "synchronize", F.col("seq"))
    # spread by the number first, as in ``deduplicate``: a task sorts its part of the shuffle, however large a file's row group is
    narrow = events.select(*KEY, "seq", synced.alias("_synced"), given.alias("_given"), *FIELDS.values()).repartition("seq")
    aggregates = [F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max("_synced").alias("sync_seq")]
    for i, (name, key) in enumerate(FIELDS.items()):
        at = F.when(F.col("_given").bitwiseAND(1 << i) != 0, F.col("seq"))
        aggregates += [F.max_by(key, at).alias(name), F.max(at).alias(f"{name}_seq")]
    return narrow.groupBy(*KEY).agg(*aggregates)


def merge_folds(folds: DataFrame) -> DataFrame:
    """Combine folds of several batches; repeating one changes nothing."""
    aggregates = [F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.max("sync_seq").alias("sync_seq")]
    for name in FIELDS:
        aggregates += [F.max_by(name, f"{name}_seq").alias(name), F.max(f"{name}_seq").alias(f"{name}_seq")]
    return folds.groupBy(*KEY).agg(*aggregates)


def upsert(prs: DataFrame, folds: DataFrame) -> DataFrame:
    """Stored pull requests after the folded events.

    ``applied_seq`` of a stored row is the last event already in it; folds that
    bring nothing newer leave the row as it is, so a replay is harmless.
    """
    new = folds.select(*KEY, F.struct(*[c for c in folds.columns if c not in KEY]).alias("n"))
    old = prs.select(*KEY, F.struct(*[c for c in prs.columns if c not in KEY]).alias("o"))
    both = old.join(new, list(KEY), "full_outer")
    exists, applied = F.col("o").isNotNull(), F.coalesce("o.applied_seq", F.lit(-1))
    reset = ~exists | (F.coalesce("n.sync_seq", F.lit(-1)) > applied)
    columns = {}
    for name in FIELDS:
        count = name in _COUNTS
        default = F.lit(0) if count else F.concat(F.lit("PR #"), F.col("pr_number").cast("string")) if name == "title" else F.lit(NEW_ROW.get(name)).cast("string")
        given = F.coalesce(f"n.{name}", F.lit(0)) if count else F.col(f"n.{name}")
        columns[name] = F.when(F.coalesce(f"n.{name}_seq", F.lit(-1)) > applied, given).when(exists, F.col(f"o.{name}")).otherwise(default)
    return both.select(
        *KEY, *[v.alias(k) for k, v in columns.items()],
        F.when(reset, "pending").otherwise(F.col("o.status")).alias("status"),
        F.when(~reset, F.col("o.risk_score")).alias("risk_score"),
        F.greatest(applied, F.coalesce("n.last_seq", F.lit(-1))).alias("applied_seq"))


def write_batches(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame, int], DataFrame], available_now: bool = True) -> StreamingQuery:
    """Write ``transform(batch, batch_id)`` of each micro-batch below ``batch=<id>``, overwriting on retry.

    A batch run twice after a failure replaces its own folder, so the output
    holds every batch once.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        transform(batch, batch_id).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def upsert_stream(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the fold of each micro-batch (T2): the work follows the batch, not the table.

    The state of the table is ``upsert`` of its last snapshot with
    ``merge_folds`` of the written folds, see ``current_prs``.
    """
    return write_batches(messages, path, checkpoint, lambda batch, _: fold(gate(parse(deduplicate(batch)))[0]))


_BASE_FIELDS = (*FIELDS, "status", "risk_score", "applied_seq")


def _told(folds: DataFrame, snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored rows as they were before any event, and all folds since: those in the snapshot and the new ones."""
    if "clocks" not in snapshot.columns:
        return snapshot, folds
    base = snapshot.filter("base is not null").select(*KEY, "base.*")
    known = snapshot.filter("clocks is not null").select(*KEY, "clocks.*")
    return base, known.unionByName(folds)


def current_prs(snapshot: DataFrame, path: str, after: int = -1, upto: int | None = None) -> DataFrame:
    """Snapshot plus the folds of the batches beyond ``after``, the last one in the snapshot; other batches' folders are not read."""
    base, folds = _merged(snapshot, path, after, upto)
    return upsert(base, folds)


def _merged(snapshot: DataFrame, path: str, after: int, upto: int | None) -> tuple[DataFrame, DataFrame]:
    folds = snapshot.sparkSession.read.parquet(path).filter(F.col("batch") > after)
    folds = folds if upto is None else folds.filter(F.col("batch") <= upto)
    base, folds = _told(folds.drop("batch"), snapshot)
    return base, merge_folds(folds)


def compact(snapshot: DataFrame, path: str, after: int, upto: int, out: str) -> DataFrame:
    """Write the state after batch ``upto`` as the next snapshot (T2); read on with ``current_prs(snapshot, path, upto)``.

    Beside each row the snapshot keeps the row before any event and the number of the event that set each field, so batches whose events are
    older than those of earlier batches still change the fields that no newer event has set.
    """
    base, folds = _merged(snapshot, path, after, upto)
    kept = base.select(*KEY, F.struct(*_BASE_FIELDS).alias("base"))
    clocks = folds.select(*KEY, F.struct(*[c for c in folds.columns if c not in KEY]).alias("clocks"))
    rows = upsert(base, folds).join(kept, list(KEY), "left").join(clocks, list(KEY), "left")
    rows.write.parquet(out)
    return snapshot.sparkSession.read.schema(rows.schema).parquet(out)


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_changes(changes: DataFrame, path: str, on: Sequence[str] = KEY, buckets: int = 1024) -> None:
    """Store changes by a hash of their key, for scans that need few of them."""
    changes.withColumn("bucket", bucket_of(on, buckets)).hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(path)


def incremental_scan(events: DataFrame, changes: DataFrame, scan: Callable[[DataFrame], DataFrame], on: Sequence[str] = KEY, buckets: int | None = None) -> DataFrame:
    """Findings of the changes named by accepted events, each change once per batch.

    With changes stored by ``write_changes``, ``buckets`` joins on their folder too: Spark then reads only the folders of the batch's keys.
    """
    keys = latest_per_key(gate(events)[0], list(on), [F.desc("seq")]).select(*on, "seq")
    if buckets is None:
        return scan(changes.join(keys, list(on)))
    return scan(changes.join(keys.withColumn("bucket", bucket_of(on, buckets)), [*on, "bucket"]).drop("bucket"))


def scan_stream(messages: DataFrame, changes: DataFrame, scan: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
                on: Sequence[str] = KEY, unique: Sequence[str] | None = None, buckets: int | None = None) -> StreamingQuery:
    """Findings of each micro-batch of events that no earlier batch has written.

    Two findings are the same if they agree in ``unique`` (all columns where it is not given), so an event that comes again writes nothing.
    """
    def fresh(batch: DataFrame, batch_id: int) -> DataFrame:
        found = incremental_scan(parse(deduplicate(batch)), changes, scan, on, buckets)
        names = list(unique or found.columns)
        found = found.dropDuplicates(names)
        if batch_id == 0:
            return found
        stored = batch.sparkSession.read.schema(f"{ddl(found)}, batch int").parquet(path).filter(F.col("batch") < batch_id).select(*names).alias("e")
        same = reduce(Column.__and__, [F.col(f"n.{c}").eqNullSafe(F.col(f"e.{c}")) for c in names])
        return found.alias("n").join(stored, same, "left_anti")

    return write_batches(messages, path, checkpoint, fresh)


def ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def _is(kind: str) -> Column:
    return F.col("type") == kind


def progress(messages: DataFrame) -> DataFrame:
    """Counts per pull request of feed messages up to its first completion, with which its feed ends (T5)."""
    closed = messages.filter(_is("review_complete")).groupBy("pr_id").agg(F.min("seq").alias("_end"))
    heard = messages.join(closed, "pr_id", "left").filter(F.col("_end").isNull() | (F.col("seq") <= F.col("_end")))
    return heard.groupBy("pr_id").agg(
        F.count_if(_is("agent_progress")).alias("steps"), F.count_if(_is("finding_created")).alias("findings"),
        (F.count_if(_is("review_complete")) > 0).alias("complete"), F.max("seq").alias("last_seq"))


_PROGRESS = "steps bigint, findings bigint, complete boolean, last_seq bigint"


def progress_stream(messages: DataFrame) -> DataFrame:
    """``progress`` of a stream in update mode (T5): four numbers are kept for each pull request, and nothing counts once it is complete.

    The messages of a micro-batch are taken in order of ``seq``; earlier batches come first, as the feed delivers them.
    """
    id_type = messages.schema["pr_id"].dataType.simpleString()

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        steps, findings, complete, last = state.get if state.exists else (0, 0, False, -1)
        new = pd.concat([b[["seq", "type"]] for b in batches]).sort_values("seq")
        if complete:
            return
        ends = (new["type"] == "review_complete").to_numpy()
        if ends.any():
            new, complete = new.iloc[: int(ends.argmax()) + 1], True
        steps, findings = steps + int((new["type"] == "agent_progress").sum()), findings + int((new["type"] == "finding_created").sum())
        last = max(last, int(new["seq"].max()))
        state.update((steps, findings, complete, last))
        yield pd.DataFrame([(key[0], steps, findings, complete, last)], columns=["pr_id", "steps", "findings", "complete", "last_seq"])

    return messages.groupBy("pr_id").applyInPandasWithState(
        advance, f"pr_id {id_type}, {_PROGRESS}", _PROGRESS, "update", GroupStateTimeout.NoTimeout)
