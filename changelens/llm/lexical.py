"""Ranked lexical search over bit-sliced Bloom signatures.

Every document gets a Bloom signature of its terms; a key is a term together with a level, and level l is set where the term occurs at least 2^l times.
Signatures have a power of two of bits that follows the number of keys, so long documents do not fill theirs.  Documents of equal signature
length are rows of one block, and a block is stored by slices: one bitmap over its rows for each bit.  The AND of a key's slices marks every row
that holds it, and some that do not, never one too few.  So the weighted sum of a query's slices, a level's rows weighing what its largest
count adds to the score, is an upper bound of each row's score.

A search makes two passes over the slices.  The first takes, for every item, the rows of the highest bounds; their exact scores give a floor under the k-th best
score.  The second keeps every row whose bound reaches the floor; all of these are scored exactly from their whole texts.  No row is left out unless
its bound proves that it is not among the k best.

The index knows nothing of the queries: it also holds each task's document counts of all terms, which are added up for the terms of a query.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changelens.session import work_dir

#: Places of a key in a signature, levels of counts (1, 2, 4, ... 128), and bits for each key at least.
HASHES, LEVELS, SPARSE = 3, 8, 8
LEAST_BITS, MOST_BITS = 256, 1 << 20
#: Rows of a block, and bits of a block in all, at most (eight rows at least).
ROWS, CELLS = 1024, 1 << 22
#: Terms whose document counts a task holds before it writes them.
COUNTED = 200_000
#: Terms of documents whose signatures are computed together.
TOGETHER = 20_000
_INDEX = ("bits int, ids array<long>, marks array<long>, sizes array<long>, slices binary, term binary, docs long, words long")
_ARROW = pa.schema([("bits", pa.int32()), ("ids", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("slices", pa.binary()),
                    ("term", pa.binary()), ("docs", pa.int64()), ("words", pa.int64())])
# other ASCII signs than letters and digits part terms, capital A to Z become small; bytes of longer characters stay
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text in order, as UTF-8: runs of ASCII letters and digits and of all other characters beyond ASCII, only A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def _hashes(found, n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), "<u8", n)


def _keys(hashes: np.ndarray, level: int) -> np.ndarray:
    x = hashes ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    """(keys, HASHES): the bits of each key in a signature of `bits` bits."""
    step = (keys >> np.uint64(32)) | np.uint64(1)
    return ((keys[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def _record(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in _ARROW], schema=_ARROW)


class _Block:
    """Rows of one signature length on their way to a stored block."""

    def __init__(self, bits: int) -> None:
        self.bits, self.rows = bits, max(8, min(ROWS, CELLS // bits))
        self.clear()

    def clear(self) -> None:
        self.ids, self.marks, self.sizes = [], [], []
        self.cells = np.zeros((self.rows, self.bits), np.uint8)

    def add(self, key: int | None, mark: int, size: int, places: np.ndarray) -> bool:
        self.cells[len(self.ids), places] = 1
        self.ids.append(key)
        self.marks.append(mark)
        self.sizes.append(size)
        return len(self.ids) == self.rows

    def record(self) -> pa.RecordBatch:
        used = -(-len(self.ids) // 8) * 8
        packed = np.packbits(self.cells[:used], axis=0).T
        out = _record(bits=[self.bits], ids=[self.ids], marks=[self.marks], sizes=[self.sizes], slices=[packed.tobytes()])
        self.clear()
        return out


def _signed(counts: list[Counter]) -> Iterator[tuple[int, np.ndarray]]:
    """(bits, places) of every document's signature, computed for several documents together."""
    lengths = np.array([len(c) for c in counts])
    hashes = _hashes(chain.from_iterable(counts), int(lengths.sum()))
    times = np.fromiter(chain.from_iterable(c.values() for c in counts), np.int64, len(hashes))
    owner = np.repeat(np.arange(len(counts)), lengths)
    levels = [np.flatnonzero(times >= 1 << level) for level in range(LEVELS)]
    keys = np.concatenate([_keys(hashes[at], level) for level, at in enumerate(levels)])
    of = np.concatenate([owner[at] for at in levels])
    held = np.bincount(of, minlength=len(counts))
    bits = np.array([min(MOST_BITS, max(LEAST_BITS, 1 << (SPARSE * int(n) - 1).bit_length())) for n in held], np.uint64)
    step = (keys >> np.uint64(32)) | np.uint64(1)
    places = ((keys[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) & (bits[of] - np.uint64(1))[:, None]).astype(np.int64)
    places = np.split(places[np.argsort(of, kind="stable")], np.cumsum(held)[:-1])
    return zip(bits.tolist(), places, strict=True)


def _index_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks: dict[int, _Block] = {}
    seen, n_docs, n_words = Counter(), 0, 0
    held: list = []
    waiting = 0

    def stored() -> Iterator[pa.RecordBatch]:
        for (key, mark, size, _), (bits, places) in zip(held, _signed([h[3] for h in held]), strict=True):
            block = blocks.get(bits) or blocks.setdefault(bits, _Block(bits))
            if block.add(key, mark, size, places.ravel()):
                yield block.record()
        held.clear()

    for batch in batches:
        for key, text, mark in zip(*batch.columns, strict=True):
            counts = Counter(found := terms(text.as_py()))
            if not found:
                continue
            n_docs, n_words, waiting = n_docs + 1, n_words + len(found), waiting + len(counts)
            seen.update(counts.keys())
            held.append((key.as_py(), mark.as_py(), len(found), counts))
            if waiting >= TOGETHER:
                yield from stored()
                waiting = 0
            if len(seen) >= COUNTED:
                yield _record(term=list(seen), docs=list(seen.values()))
                seen = Counter()
    if held:
        yield from stored()
    for block in blocks.values():
        if block.ids:
            yield block.record()
    if seen:
        yield _record(term=list(seen), docs=list(seen.values()))
    yield _record(docs=[n_docs], words=[n_words])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"))


def build_index(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the index of all rows of `docs` to `folder`, in one pass without a shuffle.

    A row is known by its id and the hash of its text; a row that repeats both is a row of its own.  Rows without a term (null and empty texts too) are
    in no block.  Very long texts are taken whole; above 2^20 bits signatures fill up, which loosens bounds and loses nothing.  An empty table gives an empty index.
    """
    _keyed(docs, id_col, text_col).mapInArrow(_index_task, _INDEX).write.parquet(folder)


@dataclass
class Queries:
    """Items by place: `held[i]` the places of an item's terms in `hashes`, `weights[i]` their weights times their repeats; corpus counts N and L; a floor for each item."""

    names: list[bytes]
    hashes: np.ndarray
    held: list[np.ndarray]
    weights: list[np.ndarray]
    n_docs: int
    n_words: int
    floor: np.ndarray

    def __post_init__(self) -> None:
        self.place = {name: i for i, name in enumerate(self.names)}

    def spread(self, sizes):
        """A document's m."""
        return 25 + 75 * sizes * self.n_docs // self.n_words

    def bounds(self, bits: int, sizes: np.ndarray, slices: bytes) -> np.ndarray:
        """(items, rows): upper bounds of the scores of a block's rows."""
        n = len(sizes)
        cells = np.frombuffer(slices, np.uint8).reshape(bits, -1)
        m8, total = 8 * self.spread(sizes), np.zeros((len(self.held), n))
        live, low = np.arange(len(self.names)), np.zeros(n, np.int64)
        alive = None
        for level in range(LEVELS):
            at = _places(_keys(self.hashes[live], level), bits)
            got = cells[at[:, 0]]
            for k in range(1, HASHES):
                got &= cells[at[:, k]]
            # a count of 2^l occurrences is one of every smaller level too
            alive = got if alive is None else alive & got
            some = alive.any(axis=1)
            live, alive = live[some], alive[some]
            if not len(live):
                break
            most = np.minimum(sizes, (2 << level) - 1) if level < LEVELS - 1 else sizes
            high = 10**9 * most // (1000 * most + m8)
            where = np.full(len(self.names), -1)
            where[live] = np.arange(len(live))
            rows = np.unpackbits(alive, axis=1)[:, :n]
            for i, (held, weights) in enumerate(zip(self.held, self.weights, strict=True)):
                own = where[held]
                if (some := own >= 0).any():
                    total[i] += (weights[some] @ rows[own[some]].astype(float)) * (high - low)
            low = high
        return total

    def scores(self, text: str | None, items: list[int] | None = None) -> dict[int, int]:
        """Exact scores above 0 of one document for the items at these places (all without `items`)."""
        found = terms(text)
        counts = {self.place[t]: n for t, n in Counter(found).items() if t in self.place}
        if not counts:
            return {}
        m8 = 8 * (25 + 75 * len(found) * self.n_docs // self.n_words)
        value = {t: 10**9 * n // (1000 * n + m8) for t, n in counts.items()}
        out = {}
        for i in range(len(self.held)) if items is None else items:
            score = sum(w * value[t] for t, w in zip(self.held[i].tolist(), self.weights[i].tolist(), strict=True) if t in value)
            if score > 0:
                out[i] = int(score)
        return out


def _queries(index: DataFrame, texts: list[str | None]) -> Queries:
    """Weights of the items' terms from the index's counts; terms of no document weigh like the others, and reach none."""
    spark = index.sparkSession
    counts = [Counter(terms(t)) for t in texts]
    names = sorted(set().union(*counts)) if counts else []
    total = index.where("words is not null").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    n_docs, n_words = total["docs"] or 0, total["words"] or 0
    # the terms of one block of items, by the hash join that the planner picks; as many rows come back at most
    asked = spark.createDataFrame([(bytes(t),) for t in names], "term binary")
    held = {bytes(r["term"]): r["docs"] for r in index.where("term is not null").join(asked, "term").groupBy("term").agg(F.sum("docs").alias("docs")).collect()} if names else {}
    place = {t: i for i, t in enumerate(names)}
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held.get(t, 0) + 1))) for t in names}
    return Queries(names, _hashes(names, len(names)), [np.array([place[t] for t in c], np.int64) for c in counts],
                   [np.array([weight[t] * n for t, n in c.items()], float) for c in counts], n_docs, n_words, np.ones(len(counts)))


class _Best:
    """The best (score, id, mark) of each item that a task has seen."""

    def __init__(self, k: int) -> None:
        self.k, self.kept = k, {}

    def add(self, item: int, score: int, key: int | None, mark: int) -> None:
        rows = self.kept.setdefault(item, [])
        rows.append((-score, key is None, key or 0, mark))
        if len(rows) >= 8 * self.k:
            rows.sort()
            del rows[self.k :]

    def record(self) -> pa.RecordBatch:
        rows = [(i, *r) for i, found in self.kept.items() for r in sorted(found)[: self.k]]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([-r[1] for r in rows], pa.int64()),
                                           pa.array([None if r[2] else r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())], ["item", "score", "id", "mark"])


_FOUND = "item int, score long, id long, mark long"


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item with their rank; tasks have cut theirs before the shuffle, the planner's own limit does so again."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "mark")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index_folder: str, docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", items_at_once: int = 512, pilots: int = 20) -> DataFrame:
    """(item_col, rank, id_col, score): the `k` best rows of `docs` above 0 for every item, highest first; equal scores by ascending id, null ids last, then by the hash of the text.

    `index_folder` is what `build_index` wrote of the same `docs`.  The items are a stated set of queries, taken in blocks of `items_at_once` in the order of their
    ids, and each block is compared with all rows; a repeated item (same id and text) counts once.  Null and empty item texts find nothing.  Of each item, `pilots` rows
    give the floor: more make it higher, none changes the result.  Only k rows an item and pilot come to the driver.  Rows that repeat an id and a text have a rank each.
    """
    spark = docs.sparkSession
    index = spark.read.schema(_INDEX).parquet(index_folder)
    blocks = index.where("bits is not null").select("bits", "ids", "marks", "sizes", "slices")
    rows = _keyed(docs, id_col, text_col)
    asked = items.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("text")).distinct().orderBy("item", "text")
    out = spark.createDataFrame([], f"`{item_col}` long, rank int, `{id_col}` long, score long")
    some: list = []
    todo = asked.toLocalIterator()
    while True:
        row = next(todo, None)
        if row is not None:
            some.append(row)
        if some and (row is None or len(some) == items_at_once):
            found = _search_block(spark, index, blocks, rows, [r["text"] for r in some], k, pilots)
            names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(some)], "item int, name long")
            out = out.union(found.join(names, "item").select("name", F.col("rank").cast("int"), "id", "score"))
            some = []
        if row is None:
            return out


def _search_block(spark, index: DataFrame, blocks: DataFrame, rows: DataFrame, texts: list, k: int, pilots: int) -> DataFrame:
    queries = _queries(index, texts)
    if not queries.n_docs:
        return spark.createDataFrame([], _FOUND + ", rank int")
    first = spark.sparkContext.broadcast(queries)  # the terms of one block of items

    def high(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, best = first.value, _Best(pilots)
        for batch in batches:
            for block in batch.to_pylist():
                bounds = q.bounds(block["bits"], np.array(block["sizes"], np.int64), block["slices"])
                for i, line in enumerate(bounds):
                    for j in np.argsort(-line, kind="stable")[:pilots]:
                        if line[j] > 0:
                            best.add(i, int(line[j]), block["ids"][j], block["marks"][j])
        yield best.record()

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, best = first.value, _Best(k)
        for batch in batches:
            for key, text, mark in zip(*batch.columns, strict=True):
                for i, score in q.scores(text.as_py()).items():
                    best.add(i, score, key.as_py(), mark.as_py())
        yield best.record()

    # at most `pilots` keys an item: a bounded side for the broadcast
    keys = [(r["id"], r["mark"]) for r in _top(blocks.mapInArrow(high, _FOUND), pilots).select("id", "mark").distinct().collect()]
    named = spark.createDataFrame(keys, "pilot long, pilot_mark long")
    piloted = rows.join(F.broadcast(named), F.col("id").eqNullSafe(F.col("pilot")) & (F.col("mark") == F.col("pilot_mark"))).select("id", "text", "mark")
    floor = np.ones(len(texts))
    for r in _top(piloted.mapInArrow(exact, _FOUND), k).where(F.col("rank") == k).select("item", "score").collect():
        floor[r["item"]] = r["score"]
    queries.floor = floor
    second = spark.sparkContext.broadcast(queries)

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = second.value
        for batch in batches:
            for block in batch.to_pylist():
                bounds = q.bounds(block["bits"], np.array(block["sizes"], np.int64), block["slices"])
                keep = bounds >= q.floor[:, None]
                at = np.flatnonzero(keep.any(axis=0))
                yield pa.RecordBatch.from_arrays([pa.array([block["ids"][j] for j in at], pa.int64()), pa.array([block["marks"][j] for j in at], pa.int64()),
                                                  pa.array([np.flatnonzero(keep[:, j]) for j in at], pa.list_(pa.int32()))], ["id", "mark", "items"])

    def rescored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, best = second.value, _Best(k)
        for batch in batches:
            for key, text, mark, wanted in zip(*batch.columns, strict=True):
                for i, score in q.scores(text.as_py(), wanted.as_py()).items():
                    if score >= q.floor[i]:
                        best.add(i, score, key.as_py(), mark.as_py())
        yield best.record()

    # one row for each document that is left, with all its items; the join has the same form at every size
    open_rows = blocks.mapInArrow(left, "id long, mark long, items array<int>").dropDuplicates(["id", "mark"])
    open_rows = open_rows.select(F.struct("id", "mark").alias("key"), "items").hint("merge")
    joined = rows.withColumn("key", F.struct("id", "mark")).join(open_rows, "key").select("id", "text", "mark", "items")
    return _top(joined.mapInArrow(rescored, _FOUND), k)


def ranked(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """`search` over an index that is written to the shared folder first."""
    folder = work_dir(docs.sparkSession, "lexical-index")
    build_index(docs, folder, how.get("id_col", "doc_id"), how.get("text_col", "text"))
    return search(folder, docs, items, **how)
