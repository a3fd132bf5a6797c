"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has one bit for each majority over the hashes of a text's word shingles.  Bit i gets the number phi(i) in 1..2^(r+1)-1; the
table of v, for each v in 1..2^(r+1)-1, keeps the bits with an odd count of ones in phi(i) & v.  Any r bits have at most r numbers, and these
never span all r+1 binary dimensions, so some v is orthogonal to them all: that table masks out every differing bit, and a pair within the
radius r meets there for certain (Pagh, "CoveringLSH").  No pair within the radius is missed.

Links are found between distinct fingerprints.  A bucket with more than `dense` of them is not compared pair by pair: every member names the
points that differ from it in at most one masked-out bit (for the radius 2, two fingerprints within it share such a point, and two that share a point are
within it), and members of one point, of whom there are few by construction, are tied to the smallest.  Both ways are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import components, cut

SEED = 42


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of one text: A-Z lower-cased, words between ASCII white space, shingles of `words` words.

    Fewer words make one shingle of the whole sequence; no words (null, empty, only spaces) give zero.
    """
    if not text:
        return 0
    # bytes.lower() and bytes.split() know ASCII alone, as asked for
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(tokens[i : i + words]), SEED) for i in range(n)), "<u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id_col, fp long: the fingerprint's bits as a signed long, text_hash) for every row, in one pass without a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), "<u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view("<i8")), batch.column(2)], [id_col, "fp", "text_hash"])

    slim = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    return slim.mapInArrow(run, f"`{id_col}` long, fp long, text_hash long")


def masks(radius: int = 2, bits: int = 64) -> list[int]:
    """The covering masks: 2^(radius+1)-1 of them, as unsigned numbers."""
    top = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if ((1 + i % top) & v).bit_count() & 1) for v in range(1, top + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_links(distinct: DataFrame, dense: int = 64) -> DataFrame:
    """Edges (a, b) that join exactly the components of "two or fewer differing bits" on the column fp of distinct fingerprints."""
    covering = masks(2)
    tables = distinct.select("fp", F.posexplode(F.array(*[F.lit(_signed(m)) for m in covering])).alias("t", "mask"))
    tables = tables.select("t", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    shared = tables.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    # sizes are joined on (t, key): a dense bucket is a skewed key of an ordinary join, which adaptive execution splits
    sized = tables.join(shared, ["t", "key"])

    few = sized.where(F.col("n") <= dense).groupBy("t", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))

    def near(x: Column, y: Column) -> Column:
        return (x < y) & (F.bit_count(x.bitwiseXOR(y)) <= 2)

    pairs = few.select(F.explode(F.flatten(F.transform("fps", lambda x: F.transform(F.filter("fps", lambda y: near(x, y)), lambda y: F.struct(x.alias("b"), y.alias("a")))))).alias("e"))
    pairs = pairs.select("e.a", "e.b")

    free = F.element_at(F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in covering]), F.col("t") + 1)
    points = sized.where(F.col("n") > dense).select("t", "key", "fp", F.explode(free).alias("flip"))
    points = points.select("t", "key", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    # distinct fingerprints around one point: at most one for each flip
    stars = points.groupBy("t", "key", "point").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    stars = stars.select(F.explode(F.slice("fps", 2, 1 << 16)).alias("a"), F.col("fps")[0].alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id_col, fp, component_id): one row for each row of `docs`.

    component_id is the smallest id of a document reachable over links of two or fewer differing bits, the document's own included.
    Null and empty texts have the fingerprint zero and link like others.  Rows with the same id, and rows whose text repeats, each keep a
    row; a null id links like others but never names a component (it is null only where no id is reachable).  An empty table gives none.
    """
    prints = cut(fingerprints(docs, id_col, text_col, words).drop("text_hash"))
    classes = cut(prints.groupBy("fp").agg(F.min(id_col).alias("first")))
    joined = _rooted(classes)
    # the smallest fingerprint names a component so far; its smallest document is to name it
    roots = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.join(roots, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col(id_col), "fp", "component_id")


def _rooted(classes: DataFrame) -> DataFrame:
    """(fp, first, root) of distinct fingerprints (fp, first): the smallest fingerprint of each one's component."""
    found = components(fingerprint_links(classes.select("fp")))
    return classes.join(found, classes["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component_id", "fp").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with exactly one row for each component, in all its columns: that of the smallest id, null after all others, then of the smallest hash of the text.

    A row is known by its id and the hash of its text, so rows of one id in different components each stay, and of rows without an id that are
    copies of each other one.  Of rows equal in both, one stays.
    """
    prints = fingerprints(docs, id_col, text_col)
    row = F.struct(F.col(id_col).isNull().alias("nameless"), F.col(id_col).alias("id"), F.col("text_hash").alias("text_hash"))
    classes = cut(prints.groupBy("fp").agg(F.min(row).alias("first")))
    kept = _rooted(classes).groupBy("root").agg(F.min("first").alias("first"))
    # in a struct a null id equals itself, in joins as in groups
    kept = kept.select(F.struct(F.col("first.id").alias("id"), F.col("first.text_hash").alias("text_hash")).alias("key"))
    # all columns of the documents in one, so that none can clash with the key
    key = F.struct(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("text_hash"))
    keyed = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return keyed.join(kept, "key", "left_semi").dropDuplicates(["key"]).select(*[F.col(f"row.`{c}`") for c in docs.columns])


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row for each component: the one with the smallest id, in all its columns.  Of rows that repeat that id one stays.

    Rows without an id stay, as no component can be named after them.
    """
    found = near_duplicates(docs, id_col, text_col)
    kept = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_kept")).distinct()
    named = docs.join(kept, docs[id_col].cast("long") == F.col("_kept"), "left_semi").dropDuplicates([id_col])
    return named.unionByName(docs.where(F.col(id_col).isNull()))
