"""Embedding near-duplicates by randomised-rotation binary codes.

A unit vector is rotated at random and coded by the signs of its coordinates.  The code is itself a unit vector (signs / sqrt(d)); its inner product
f with the rotated vector is stored as the correction factor.  For another vector q, rounded at random to 4 bits a coordinate so that the rounding
is right on average, <code, q> / f is an unbiased estimate of the cosine (Gao and Long, "RaBitQ").  Where the cosine is c, it strays by
sqrt(1-c^2) sqrt(1-f^2) / (f sqrt(d-1)) and by half the rounding step over f, as standard deviations.  A pair whose estimate lies more than
`sigmas` of these below the threshold is dropped; every other pair is computed exactly, in double precision, before it is linked.

Every vector is coded once, and its code, factor and rounded coordinates are stored with it.  Codes alone are shuffled into the buckets; a vector follows
only into those where the bounds leave it a partner.

Pairs to estimate come from buckets: a table holds the vectors that agree in the signs of `bits` rotated coordinates.  The number of bits grows with
the logarithm of the number of vectors, so that buckets of unrelated vectors keep their size; the number of tables follows from the bits, so that a pair right at the
threshold misses every table with a probability under `miss`.  A bucket above `block` vectors is compared in pairs of blocks of bounded size, read one after another by a task.
Equal vectors are one vector with a count throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import components, cut

SEED, LEVELS = 20240229, 15


@lru_cache(64)
def rotation(dim: int, number: int) -> np.ndarray:
    """The random rotation of that number: the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, number]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def codes(unit: np.ndarray, key: np.ndarray) -> dict[str, np.ndarray]:
    """Sign bits (64 to a word), correction factor, bit planes of the randomly rounded vector, its least value and step.  `key` seeds the rounding."""
    n, dim = unit.shape
    turned = unit @ rotation(dim, 0).T
    signs = turned > 0
    factor = np.abs(turned).sum(1) / math.sqrt(dim)
    low = turned.min(1)
    step = np.maximum((turned.max(1) - low) / LEVELS, 1e-12)
    dither = np.random.default_rng([SEED, n, int(key[0]) & 0x7FFFFFFF]).random((n, dim))
    rounded = np.clip(np.floor((turned - low[:, None]) / step[:, None] + dither), 0, LEVELS).astype(np.uint8)

    def packed(bits: np.ndarray) -> np.ndarray:
        wide = np.zeros((n, -(-dim // 64) * 64), np.uint8)
        wide[:, :dim] = bits
        return np.packbits(wide, axis=1).view("<u8")

    return {"bits": packed(signs), "factor": factor, "low": low, "step": step, "total": rounded.sum(1), "planes": np.stack([packed(rounded >> b & 1) for b in range(4)])}


def stored(code: dict[str, np.ndarray]) -> list[bytes]:
    """A row of bytes for each vector: factor, low, step, sign bits, four planes."""
    numbers = np.stack([code["factor"], code["low"], code["step"]], axis=1).astype("<f8").view("<u8")
    return [row.tobytes() for row in np.concatenate([numbers, code["bits"], *code["planes"]], axis=1)]


def restored(rows: list[bytes], dim: int) -> dict[str, np.ndarray]:
    """What `codes` gave for these rows."""
    words = -(-dim // 64)
    table = np.frombuffer(b"".join(rows), "<u8").reshape(len(rows), 3 + 5 * words)
    numbers = np.ascontiguousarray(table[:, :3]).view("<f8")
    planes = np.stack([table[:, 3 + words * (p + 1) : 3 + words * (p + 2)] for p in range(4)])
    total = sum(np.bitwise_count(planes[p]).sum(axis=1).astype(np.int64) << p for p in range(4))
    return {"bits": table[:, 3 : 3 + words], "factor": numbers[:, 0], "low": numbers[:, 1], "step": numbers[:, 2], "total": total, "planes": planes}


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of sorted batches, one table for each run of equal values in the first `keys` columns (whole numbers)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = np.stack([batch.column(k).to_numpy() for k in range(keys)], axis=1)
        cuts = [0, *(np.flatnonzero((table[1:] != table[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if last is not None and last != tuple(table[a].tolist()):
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(table[a].tolist())
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def estimates(a: dict, b: dict, dim: int) -> np.ndarray:
    """Estimated cosines of all of a (by their codes) with all of b (by their rounded vectors)."""
    both = np.zeros((len(a["factor"]), len(b["factor"])))
    for p in range(4):
        for w in range(a["bits"].shape[1]):
            both += np.bitwise_count(a["bits"][:, w][:, None] & b["planes"][p][:, w][None, :]).astype(np.float32) * (1 << p)
    ones = np.bitwise_count(a["bits"]).sum(1)[:, None].astype(float)
    # sum of sign * (low + step * rounded) over the coordinates
    inner = b["low"] * (2 * ones - dim) + b["step"] * (2 * both - b["total"])
    return inner / math.sqrt(dim) / a["factor"][:, None]


def margins(a: dict, b: dict, dim: int, threshold: float) -> np.ndarray:
    """One standard deviation of the estimates at the threshold."""
    f = a["factor"][:, None]
    return np.sqrt((1 - threshold**2) * np.maximum(1 - f**2, 0) / max(1, dim - 1) + (b["step"] / 2) ** 2) / f


def table_plan(n: int, threshold: float, miss: float, bucket: int) -> tuple[int, int]:
    """(bits in a key, tables) for n vectors."""
    bits = max(1, min(31, round(math.log2(max(2, n) / bucket))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-meet))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, sigmas: float = 6.0,
                 miss: float = 1e-4, bucket: int = 256, block: int = 1024) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row of `vectors`: see the module.

    n_links counts the other rows linked directly, copies among them; component_id is the smallest id reachable, the row's own included.
    A vector that is null, empty, all zero or holds null or non-finite components links with nothing and is its own component, and so is a
    row without an id (component_id null, kept false).  Vectors of different lengths never link.  Rows that repeat an id and its vector are
    copies of each other.  An empty table gives no rows; other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(usable, F.col("v")))
    classes = cut(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    bits, tables = table_plan(classes.count(), threshold, miss, bucket)

    def keyed(batches):
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["v"].map(len)):
                unit = _units(np.array(part["v"].to_list(), float))
                turns = -(-bits * tables // dim)
                signs = np.concatenate([unit @ rotation(dim, r + 1).T > 0 for r in range(turns)], axis=1)[:, : bits * tables]
                keys = signs.reshape(len(unit), tables, bits) @ (1 << np.arange(bits))
                yield pd.DataFrame({"id": part["id"], "mark": part["mark"], "copies": part["copies"], "v": part["v"], "dim": dim, "code": stored(codes(unit, part["id"].to_numpy())), "keys": list(keys.astype(np.int32))})

    coded = classes.withColumn("mark", F.xxhash64("v")).mapInPandas(keyed, "id long, mark long, copies long, v array<double>, dim int, code binary, keys array<int>")
    coded = cut(coded)
    places = coded.select("id", "mark", "dim", "code", F.posexplode("keys").alias("t", "key"))
    # how many blocks a bucket has; those of one vector hold no pair
    sizes = places.groupBy("dim", "t", "key").agg(F.count("*").alias("n")).where("n > 1").select("dim", "t", "key", F.ceil(F.col("n") / block).alias("blocks"))
    own = F.pmod(F.xxhash64("id", "mark"), F.col("blocks")).cast("int")
    dealt = places.join(sizes, ["dim", "t", "key"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    dealt = dealt.withColumn("first", F.least("own", "other")).withColumn("second", F.greatest("own", "other"))
    group = ["dim", "t", "key", "first", "second"]

    def open_pairs(own: np.ndarray, code: dict, dim: int, first: int, second: int) -> np.ndarray:
        """Pairs that the bounds leave open, above the diagonal."""
        maybe = estimates(code, code, dim) + sigmas * margins(code, code, dim, threshold) >= threshold
        maybe = np.triu(maybe | maybe.T, 1)
        # a block is compared with itself only in its own group; across, only with the other block
        return maybe & (own[:, None] != own[None, :]) if first != second else maybe

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, 5):
            dim, first, second = (rows.column(k)[0].as_py() for k in (0, 3, 4))
            maybe = open_pairs(rows["own"].to_numpy(), restored(rows["code"].to_pylist(), dim), dim, first, second)
            left = rows.filter(pa.array(maybe.any(axis=0) | maybe.any(axis=1))).drop_columns(["code"])
            yield from left.combine_chunks().to_batches()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, 5):
            dim, t, first, second = (rows.column(k)[0].as_py() for k in (0, 1, 3, 4))
            rows = rows.sort_by([("id", "ascending"), ("mark", "ascending")])
            ids, copies = rows["id"].to_numpy(), rows["copies"].to_numpy()
            keys = np.asarray(rows["keys"].combine_chunks().flatten()).reshape(len(ids), -1)
            unit = _units(np.asarray(rows["v"].combine_chunks().flatten(), float).reshape(len(ids), dim))
            links, low = np.zeros(len(ids), np.int64), np.arange(len(ids))
            i, j = np.nonzero(open_pairs(rows["own"].to_numpy(), restored(rows["code"].to_pylist(), dim), dim, first, second))
            linked = np.concatenate([np.einsum("ij,ij->i", unit[i[a : a + 65536]], unit[j[a : a + 65536]]) >= threshold for a in range(0, len(i), 65536)] or [np.zeros(0, bool)])
            i, j = i[linked], j[linked]
            # a pair that meets in several tables counts in the first
            new = np.ones(len(i), bool)
            for s in range(t):
                new &= keys[i, s] != keys[j, s]
            np.add.at(links, i[new], copies[j[new]])
            np.add.at(links, j[new], copies[i[new]])
            while len(i):  # smallest linked place, until nothing changes: a star for each component of the group
                before = low.copy()
                np.minimum.at(low, j, low[i])
                np.minimum.at(low, i, low[j])
                low = low[low]
                if (before == low).all():
                    break
            told = (links > 0) | (low != np.arange(len(ids)))
            if told.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[told]), pa.array(links[told]), pa.array(ids[low][told])], ["id", "links", "to"])

    # groups are short and many, so a task reads its sorted rows through instead of starting a function for each
    slim = dealt.select(*group, "own", "id", "mark", "code").repartition(*group).sortWithinPartitions(*group)
    kind = "dim int, t int, key int, first int, second int, own int, id long, mark long"
    left = slim.mapInArrow(bounded, kind)
    whole = left.join(coded.select("id", "mark", "copies", "v", "code", "keys"), ["id", "mark"]).select(*group, "own", "id", "mark", "copies", "v", "code", "keys")
    found = cut(whole.repartition(*group).sortWithinPartitions(*group).mapInArrow(compare, "id long, links long, to long"))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = components(found.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b")))
    told = classes.join(counts, "id", "left").join(named, classes["id"] == named["node"], "left").select(
        "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    linked = rows.where("v is not null").join(told, "v").select("id", "n_links", "component_id")
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.union(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))
