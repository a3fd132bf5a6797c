"""Quality classifier: Naive Bayes support vectors (Wang and Manning, "Baselines and Bigrams").

Features are indicators of a text's byte n-grams and of n-grams of its words' shapes (repeated, capital, digits, last sign), hashed to a fixed space.  Each is scaled by its class log-count ratio, which is counted
over all labelled rows; a linear hinge-loss model on the scaled indicators is then fitted by dual coordinate descent on a bounded
sample of them.  Texts are taken in windows of bounded size, as an indicator says little about a text that is long enough to hold every n-gram; the
score of a text is the mean over its windows, weighted by their sizes, so all of it counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS, WINDOW = 17, 4096
#: Longest n-grams of bytes, and of word shapes.
BYTES, SHAPES = 3, 4
SMOOTH = 1.0
_KIND = np.zeros(256, np.uint32)  # 0 other signs, 1 white space, 2 digits, 3 capitals, 4 letters
_KIND[[32, *range(9, 14)]], _KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 1, 2, 3, 4, 4


def _slots(code: np.ndarray, salt: int) -> np.ndarray:
    return ((code ^ np.uint32(salt * 0x01000193)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def shapes(window: np.ndarray) -> np.ndarray:
    """A number below 64 for each word: whether it repeats the word before it, and the kinds of its first, second and last byte."""
    kind = _KIND[window]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], kind == 1, [True]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint32)
    # words are compared by a sum that depends on places, exact enough for an indicator
    place = np.arange(len(window)) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(window)]])))
    mixed = (window.astype(np.uint32) + np.uint32(1)) * (place.astype(np.uint32) * np.uint32(2654435761) + np.uint32(40503)) * (kind != 1)
    sums = np.add.reduceat(mixed ^ (mixed >> np.uint32(15)), starts)
    again = np.append(False, (sums[1:] == sums[:-1]) & ((ends - starts)[1:] == (ends - starts)[:-1]))
    second = kind[np.minimum(starts + 1, ends - 1)]
    return (again * np.uint32(125) + kind[starts] * np.uint32(25) + second * np.uint32(5) + kind[ends - 1]).astype(np.uint32)


def grams(window: np.ndarray) -> np.ndarray:
    """The distinct hashed n-grams of a window of bytes, in ascending order."""
    seen = np.zeros(1 << BITS, bool)
    for symbols, longest, salt in ((window, BYTES, 1), (shapes(window), SHAPES, 101)):
        code = np.zeros(len(symbols), np.uint32)
        for n in range(1, min(longest, len(symbols)) + 1):
            code = (code[: len(symbols) - n + 1] * np.uint32(251 if salt > 1 else 256)) + symbols[n - 1 :]
            seen[_slots(code, salt + n)] = True
    return np.flatnonzero(seen)


def windows(text: str | None) -> list[np.ndarray]:
    """Consecutive windows of the text's bytes, all of it; one empty window for a null or empty text."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    return [raw[i : i + WINDOW] for i in range(0, max(1, len(raw)), WINDOW)]


def descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = 1.0, epochs: int = 20, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear hinge-loss model by dual coordinate descent (Hsieh and others).

    A row is the indices of its indicators; its values are `scale` there, divided by their length, and a constant 1 for the bias.  Both
    classes weigh the same in the cost.
    """
    values = [scale[r] / max(np.linalg.norm(scale[r]), 1e-12) for r in rows]
    square = np.array([v @ v for v in values]) + 1.0
    share = {c: max(1, int((y == c).sum())) for c in (-1, 1)}
    upper = np.array([cost * len(y) / (2 * share[int(c)]) for c in y])
    w, bias, alpha, rng = np.zeros(len(scale)), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), upper[i])
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * y[i] * values[i]
                bias += (new - alpha[i]) * y[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


@dataclass
class Model:
    """`scale`: the log-count ratios; `weights` and `bias` on the scaled indicators; `slope`: of the logistic curve from margin to score."""

    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 3.0

    def __post_init__(self) -> None:
        self.product, self.square = (self.weights * self.scale).astype(np.float32), (self.scale**2).astype(np.float32)

    def margin(self, text: str | None) -> float:
        total = size = 0.0
        for window in windows(text):
            rows = grams(window)
            length = max(1, len(window))
            total += length * (float(self.product[rows].sum(dtype=float)) / max(float(self.square[rows].sum(dtype=float)) ** 0.5, 1e-12) + self.bias)
            size += length
        return total / size

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(text), -30, 30))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", sample: int = 6000, seed: int = 5, most_chars: int = WINDOW) -> Model:
    """Fit on the documents that `labels` (id, label 0 or 1; other labels and null ones are left out) names.

    The counts behind the ratios cover every labelled document; the support vectors come from at most `sample` of them, half of each class,
    chosen by a hash of their id, so that only their texts are read again; of each of these texts the vectors see at most `most_chars` characters, at a place (and for
    half of them of a length) that the hash names, in one or more windows.  Both bounds hold for the vectors alone: the counts read whole texts, however long, as scores do.  Without documents of both classes the model scores 1/2 everywhere, on the side of the class there is.
    """
    texts_of = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)").distinct()
    # labels grow with the documents, so they are never broadcast: one plan at every size, the texts shuffled once
    rows = texts_of.join(marks.hint("merge"), "id").select("text", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for window in windows(text.as_py()):
                    counts[label, grams(window)] += 1
        label, feature = np.nonzero(counts)
        # one row for each feature seen by the task
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(feature, pa.int32()), pa.array(counts[label, feature])], ["label", "feature", "n"])

    counted = rows.mapInArrow(count, "label int, feature int, n long").groupBy("label", "feature").agg(F.sum("n").alias("n"))
    # the feature space is fixed, so what comes to the driver is bounded whatever the number of rows
    counts = np.zeros((2, 1 << BITS))
    found = counted.toArrow()
    counts[found["label"].to_numpy(), found["feature"].to_numpy()] = found["n"].to_numpy()
    p, q = counts[1] + SMOOTH, counts[0] + SMOOTH
    scale = np.log((p / p.sum()) / (q / q.sum()))

    order = F.xxhash64(F.lit(seed), "id", "label")
    first = F.row_number().over(Window.partitionBy("label").orderBy(order, "id"))
    # at most `sample` short rows
    chosen = marks.withColumn("place", first).where(F.col("place") <= sample // 2).withColumn("turn", order)
    # of each sampled text a window at a place and of a length that the hash names: bounded in bytes, and short texts are learned too
    spot = F.pmod("turn", F.greatest(F.lit(1), F.length("text") - most_chars + 1)).cast("int")
    length = F.pow(2.0, 3 + F.pmod(F.shiftright("turn", 20), F.lit(1000)) / 1000 * float(np.log2(most_chars) - 3)).cast("int")
    length = F.when(F.pmod(F.shiftright("turn", 40), F.lit(2)) == 0, length).otherwise(most_chars)
    some = texts_of.join(F.broadcast(chosen), "id").select("id", "label", F.coalesce(F.substring(F.col("text"), spot + 1, length), F.lit("")).alias("text"))
    # a repeated id gives one text, so no more than `sample` of them come
    got = sorted(some.groupBy("id", "label").agg(F.min("text").alias("text")).collect())
    cuts = [(w, 2 * r["label"] - 1) for r in got for w in windows(r["text"])]
    y = np.array([c for _, c in cuts])
    if len(set(y.tolist())) < 2:
        return Model(scale * 0, scale * 0, float(y[0]) * 1e-9 if len(y) else 0.0)
    return Model(scale, *descend([grams(w) for w, _ in cuts], y, scale))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with a double from 0 to 1 (higher: label 1 is likelier), never null.  Null texts count as empty ones; whole texts are read, however long; no row is dropped."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # a fixed number of weights, 2**BITS

    def run(batches: Iterator) -> Iterator:
        for texts in batches:
            yield texts.map(shared.value.score)

    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def typed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return run(batches)

    typed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(score_col, pandas_udf(typed, "double")(F.col(text_col).cast("string")))
