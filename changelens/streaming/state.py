"""Pull requests as a stored table of last-writer-wins registers.

Every field keeps its value together with the number of the event that set it, so merging is commutative, associative and idempotent: batches may
come in any order, be split anywhere and come twice.  A row also keeps the stored row it started from, whose own number decides which events are newer than it.

The table lies in buckets by a hash of the key.  A batch reads and writes only the buckets it touches, under a new version; a small manifest that names each bucket's
version is written last.  A version without its manifest does not exist for readers, so a cut run leaves the former state in place and is simply run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from changelens.streaming import events as E

_BASE = ("title", "author", "base_branch", "head_branch", "diff_url", "html_url", "body", "files_changed", "additions", "deletions", "status", "risk_score", "applied_seq")
_KINDS = {f: "int" for f in ("files_changed", "additions", "deletions")} | {"risk_score": "double", "applied_seq": "bigint"}
BASE = "struct<" + ",".join(f"{f}:{_KINDS.get(f, 'string')}" for f in _BASE) + ">"
FOLD = "struct<first_seq:bigint,last_seq:bigint,sync_seq:bigint," + ",".join(f"{f}:{_KINDS.get(f, 'string')},{f}_seq:bigint" for f in E.FIELDS) + ">"
STATE = f"repo_full_name string, pr_number int, base {BASE}, fold {FOLD}"


def _struct(columns, kind: str, alias: str) -> Column:
    return F.struct(*columns).cast(kind).alias(alias)


def of_stored(prs: DataFrame) -> DataFrame:
    """State of stored rows that no event has touched."""
    return prs.select(*E.KEY, _struct(_BASE, BASE, "base"), F.lit(None).cast(FOLD).alias("fold"))


def of_folds(folds: DataFrame) -> DataFrame:
    """State of the folds of a batch."""
    names = [n.split(":")[0] for n in FOLD[7:-1].split(",")]
    return folds.select(*E.KEY, F.lit(None).cast(BASE).alias("base"), _struct(names, FOLD, "fold"))


def merge(states: DataFrame) -> DataFrame:
    """One state for each key; the order and number of times that states were added make no difference.

    Of several stored rows of one key that with the highest number counts, as a whole row.
    """
    fold = {"first_seq": F.min("fold.first_seq"), "last_seq": F.max("fold.last_seq"), "sync_seq": F.max("fold.sync_seq")}
    for name in E.FIELDS:
        # a number names one event; the value breaks the tie of a feed that breaks this rule
        fold[name] = F.max_by(f"fold.{name}", F.when(F.col(f"fold.{name}_seq").isNotNull(), F.struct(f"fold.{name}_seq", f"fold.{name}")))
        fold[f"{name}_seq"] = F.max(f"fold.{name}_seq")
    base = F.max_by("base", F.when(F.col("base").isNotNull(), F.struct(F.coalesce("base.applied_seq", F.lit(-1)), F.to_json("base"))))
    merged = states.groupBy(*E.KEY).agg(base.alias("base"), *[c.alias(f"_{n}") for n, c in fold.items()])
    whole = F.when(F.col("_last_seq").isNotNull(), F.struct(*[F.col(f"_{n}").alias(n) for n in fold])).cast(FOLD)
    return merged.select(*E.KEY, "base", whole.alias("fold"))


def current(states: DataFrame) -> DataFrame:
    """The pull requests that states stand for, in the columns of ``events.upsert``."""
    prs = states.where("base is not null").select(*E.KEY, "base.*")
    folds = states.where("fold is not null").select(*E.KEY, "fold.*")
    return E.upsert(prs, folds)


class Table:
    """The stored table below ``path``; ``buckets`` is fixed when it is created."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def manifest(self) -> tuple[int, dict[int, int]]:
        """(version, {bucket: version of its rows}) of the last commit: one short row for each bucket."""
        rows = self.spark.read.schema("bucket int, at int, version int").parquet(f"{self.path}/manifest")
        last = rows.agg(F.max("version")).first()[0]
        return last, {r.bucket: r.at for r in rows.where(F.col("version") == last).collect()}

    def _write(self, states: DataFrame, version: int, kept: dict[int, int], touched: list[int]) -> None:
        placed = states.withColumn("bucket", E.bucket_of(E.KEY, self.buckets))
        placed.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/version={version}")
        named = sorted((kept | {b: version for b in touched}).items())
        # the commit: until this one file has its name, readers keep to the version before
        self.spark.createDataFrame(named, "bucket int, at int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")

    def create(self, prs: DataFrame) -> Table:
        """Version 0, from stored pull requests; of rows that repeat a key one is left, see ``merge``."""
        states = merge(of_stored(prs))
        found = [r.b for r in states.select(E.bucket_of(E.KEY, self.buckets).alias("b")).distinct().collect()]
        self._write(states, 0, {}, found)
        return self

    def _folders(self, manifest: dict[int, int], buckets) -> DataFrame:
        paths = [f"{self.path}/rows/version={manifest[b]}/bucket={b}" for b in sorted(buckets) if b in manifest]
        schema = StructType.fromDDL(STATE)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def apply(self, folds: DataFrame) -> list[int]:
        """Merge the folds of a batch; only the buckets of their keys are read and written.  Returns these buckets."""
        version, manifest = self.manifest()
        touched = [r.b for r in folds.select(E.bucket_of(E.KEY, self.buckets).alias("b")).distinct().collect()]
        if touched:
            self._write(merge(self._folders(manifest, touched).unionByName(of_folds(folds))), version + 1, manifest, touched)
        return sorted(touched)

    def states(self) -> DataFrame:
        """Rows of the last commit."""
        _, manifest = self.manifest()
        return self._folders(manifest, manifest)

    def current(self) -> DataFrame:
        return current(self.states())


def stream_into(table: Table, messages: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Apply every micro-batch of messages to the table (T2); a batch run again after a failure changes nothing more."""
    def sink(batch: DataFrame, _: int) -> None:
        own = Table(batch.sparkSession, table.path, table.buckets)
        folds = E.fold(E.gate(E.parse(E.deduplicate(batch)))[0]).persist()
        own.apply(folds)
        folds.unpersist()

    writer = messages.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
