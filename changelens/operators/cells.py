"""Exact nearest rows by metric cells (V2, V4).

Directions are points on a sphere, so the chord between two of them, sqrt(2 - 2 cos), is a metric.  Each row is stored in the cell of its nearest pivot, and
a cell keeps the smallest and largest chord from its pivot.  By the triangle inequality no row of a cell is nearer to a query than the query's
chord to the pivot leaves room for.  A search reads the nearest cells of each query until they hold k rows, which bounds the k-th chord, and then every
other cell whose bound does not exceed it.  Cells left out hold none of the k nearest, so the result is that of comparing all rows.

Pivots come from a bounded sample; that touches the speed alone.  A cell lies in slices of some ``block`` rows, the queries in blocks of some hundreds: no group grows
with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Room for rounding in chords.
SLACK = 1e-6
#: Queries of a block.
ASKED = 512


def _directions(vectors) -> np.ndarray:
    matrix = np.stack([np.asarray(v, np.float64) for v in vectors])
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _chords(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosines, 0))


def usable(rows: DataFrame, vector: str, width: int | None = None) -> DataFrame:
    """Rows whose vector has a direction: there, finite, not all zero, of the width."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.filter(F.coalesce(fine & (F.lit(True) if width is None else F.size(v) == width), F.lit(False)))


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Of the sampled directions those that lie far from the ones taken before: each is the farthest from all of them."""
    taken, near = [0], _chords(sample @ sample[0])
    while len(taken) < min(pivots, len(sample)) and near.max() > SLACK:
        taken.append(int(near.argmax()))
        near = np.minimum(near, _chords(sample @ sample[taken[-1]]))
    return sample[taken]


def write_cells(rows: DataFrame, path: str, key: str, vector: str = "vector", pivots: int = 256, sample: int = 8192, block: int = 4096) -> None:
    """Store (key, direction) of all usable rows by cell and slice, and the cells themselves.

    ``sample``: the rows, chosen by a hash of their key, that pivots are taken from; the width of vectors is that of most of them.
    """
    spark = rows.sparkSession
    named = usable(rows, vector).select(F.col(key), F.col(vector).cast("array<double>").alias("v"))
    some = named.orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(sample).collect()
    if not some:
        raise ValueError("no row has a vector with a direction")
    width = int(pd.Series([len(r.v) for r in some]).mode()[0])
    points = choose_pivots(_directions([r.v for r in some if len(r.v) == width]), pivots)
    shared = spark.sparkContext.broadcast(points)  # pivots x width numbers
    kind = rows.schema[key].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                unit = _directions(batch["v"])
                cosines = unit @ shared.value.T
                cell = cosines.argmax(axis=1)
                yield pd.DataFrame({key: batch[key], "v": list(unit), "cell": cell, "gap": _chords(cosines[np.arange(len(cell)), cell])})

    placed = usable(named, "v", width).mapInPandas(place, f"`{key}` {kind}, v array<double>, cell int, gap double")
    # the directions are written once by cell; cells of many rows are split when they are read
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows")
    cells = stored.groupBy("cell").agg(F.count("*").alias("n"), F.min("gap").alias("near"), F.max("gap").alias("far")).withColumn("slices", F.ceil(F.col("n") / block).cast("int"))
    pivot_rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "cell int, pivot array<double>")
    cells.join(pivot_rows, "cell").coalesce(1).write.parquet(f"{path}/cells")


def _cells(spark: SparkSession, path: str) -> pd.DataFrame:
    """At most as many rows as there are pivots."""
    found = spark.read.schema("cell int, n long, near double, far double, slices int, pivot array<double>").parquet(f"{path}/cells").toPandas()
    return found.sort_values("cell", ignore_index=True)


def _wanted(asked: DataFrame, cells, kinds: str, k: int, second: bool) -> DataFrame:
    """(query, v, block, cell, slices) to read: in the first round the nearest cells that hold k rows, in the second all others that may matter."""
    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = cells.value
        pivot, n = np.stack(known["pivot"]), known["n"].to_numpy()
        for batch in batches:
            if not len(batch):
                continue
            unit = np.stack(batch["v"])
            chord = _chords(unit @ pivot.T)
            bound = np.maximum(np.maximum(chord - known["far"].to_numpy(), known["near"].to_numpy() - chord), 0) - SLACK
            order = np.argsort(chord, axis=1, kind="stable")
            before = np.cumsum(n[order], axis=1) - n[order]
            first = np.zeros_like(chord, dtype=bool)
            np.put_along_axis(first, order, before < k, axis=1)
            take = ~first & (bound <= batch["reach"].to_numpy()[:, None] + SLACK) if second else first
            row, cell = np.nonzero(take)
            yield pd.DataFrame({"query": batch["query"].to_numpy()[row], "v": batch["v"].to_numpy()[row], "block": batch["block"].to_numpy()[row],
                                "cell": known["cell"].to_numpy()[cell], "slices": known["slices"].to_numpy()[cell]})

    return asked.mapInPandas(choose, f"query {kinds}, v array<double>, block int, cell int, slices int")


def _search(stored: DataFrame, wanted: DataFrame, key: str, key_kind: str, query_kind: str, k: int) -> DataFrame:
    """At most k rows of each slice for each query that wants it; only wanted cells are read."""
    asked = wanted.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    blocks = wanted.select("cell", "slices", "block").distinct()
    rows = stored.join(blocks, "cell").withColumn("slice", F.pmod(F.xxhash64(F.col(key).cast("string")), F.col("slices")).cast("int"))

    def best(some: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(queries):
            return pd.DataFrame({"query": queries["query"][:0], key: some[key][:0], "cosine": np.zeros(0)})
        some = some.sort_values(key, ignore_index=True)
        scores = np.round(np.stack(queries["v"]) @ np.stack(some["v"]).T, 12)  # equal rows score the same wherever they lie
        at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        row = np.repeat(np.arange(len(queries)), at.shape[1])
        return pd.DataFrame({"query": queries["query"].to_numpy()[row], key: some[key].to_numpy()[at.ravel()], "cosine": scores[row, at.ravel()]})

    by, own = ["cell", "slice", "block"], ["q_cell", "q_slice", "q_block"]
    named = asked.select(*[F.col(a).alias(b) for a, b in zip(by, own, strict=True)], "query", "v")
    return rows.select(*by, key, "v").groupBy(*by).cogroup(named.groupBy(*own)).applyInPandas(best, f"query {query_kind}, `{key}` {key_kind}, cosine double")


def _top(found: DataFrame, key: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), key))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest_in_cells(path: str, queries: DataFrame, key: str, query_key: str, query_vector: str = "vector", k: int = 5) -> DataFrame:
    """(query_key, key, certainty, rank): the k nearest of the stored rows for every query with a direction (V4), ties by key; exact.

    Queries without a direction, or of another width than the stored rows, have no neighbours.  The distinct queries need distinct keys.
    """
    first, second, _ = _rounds(path, queries, key, query_key, query_vector, k)
    found = _top(first.unionByName(second), key, k)
    return found.select(F.col("query").alias(query_key), key, ((1 + F.col("cosine")) / 2).alias("certainty"), F.col("rank").cast("int"))


def _rounds(path: str, queries: DataFrame, key: str, query_key: str, query_vector: str, k: int) -> tuple[DataFrame, DataFrame, tuple[DataFrame, DataFrame]]:
    spark = queries.sparkSession
    known = _cells(spark, path)
    cells = spark.sparkContext.broadcast(known)  # a row for each pivot
    stored = spark.read.parquet(f"{path}/rows")
    key_kind, query_kind = stored.schema[key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    width = len(known["pivot"][0])
    asked = usable(queries, query_vector, width).select(F.col(query_key).alias("query"), F.col(query_vector).cast("array<double>").alias("v"))

    def direct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(v=list(_directions(batch["v"])))

    blocks = -(-asked.count() // ASKED) or 1
    asked = asked.mapInPandas(direct, f"query {query_kind}, v array<double>").withColumn("block", F.pmod(F.xxhash64(F.col("query").cast("string")), F.lit(blocks)).cast("int"))
    near = _wanted(asked, cells, query_kind, k, False)
    first = _top(_search(stored, near, key, key_kind, query_kind, k), key, k).drop("rank")
    # the k-th chord so far; a query with fewer than k rows reaches everywhere
    kth = first.groupBy("query").agg(F.count("*").alias("n"), F.min("cosine").alias("low"))
    reach = F.when(F.col("n") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("low")))).otherwise(2.0)
    far = _wanted(asked.join(kth, "query", "left").withColumn("reach", F.coalesce(reach, F.lit(2.0))).select("query", "v", "block", "reach"), cells, query_kind, k, True)
    return first, _search(stored, far, key, key_kind, query_kind, k), (near, far)


def share_read(path: str, queries: DataFrame, key: str, query_key: str, query_vector: str = "vector", k: int = 5) -> float:
    """Part of all (query, stored row) pairs that a search compares."""
    *_, (near, far) = _rounds(path, queries, key, query_key, query_vector, k)
    known = _cells(queries.sparkSession, path)
    sizes = queries.sparkSession.createDataFrame(known[["cell", "n"]])
    compared = near.select("query", "cell").union(far.select("query", "cell")).join(sizes, "cell").agg(F.sum("n"), F.countDistinct("query")).first()
    return compared[0] / (compared[1] * int(known["n"].sum())) if compared[1] else 0.0
