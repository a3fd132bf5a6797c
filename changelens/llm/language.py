"""Language of a text by a byte convolutional network, trained in numpy.

A window of bytes passes filters of several widths, the largest answer of each filter over the window is kept, and a softmax over these gives the
languages.  As bytes are symbols, a filter is a table: its weight for each byte at each of its places.  A text is the sum of its windows' log
probabilities, all windows counted, each by the bytes it holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTHS, FILTERS, WINDOW = (2, 3, 4), 8, 256
UNKNOWN = "und"
#: Windows computed together.
BATCH = 64


def has_letter(text: str | None) -> bool:
    """Whether a sign is of Unicode's categories L; training asks for the same by \\p{L}.  Digits, fractions and numbered signs are none."""
    return any(map(str.isalpha, text or ""))


def encode(text: str) -> bytes:
    """The bytes the network sees: lower case, white space as one space."""
    return " ".join(text.lower().split()).encode("utf-8", "replace")


def cut(raw: bytes, window: int = WINDOW) -> np.ndarray:
    """Consecutive windows of fixed length, the last filled with zero bytes."""
    n = max(1, -(-len(raw) // window))
    return np.frombuffer(raw + bytes(n * window - len(raw)), np.uint8).reshape(n, window)


@dataclass
class Network:
    """`tables`: for each width an array (place, byte, filter); `shift`: the filters' biases; `out`, `bias`: the softmax layer; `names`: its languages."""

    tables: list[np.ndarray]
    shift: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    names: list[str]

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest answer of each filter (windows, filters), not below 0, and where it was."""
        best, where = [], []
        for table in self.tables:
            width, span = len(table), x.shape[1] - len(table) + 1
            answer = table[0][x[:, :span]]
            for k in range(1, width):
                answer += table[k][x[:, k : k + span]]
            at = answer.argmax(1)
            where.append(at)
            best.append(np.take_along_axis(answer, at[:, None], 1)[:, 0])
        return np.maximum(np.concatenate(best, 1) + self.shift, 0), np.concatenate(where, 1)

    def largest(self, x: np.ndarray) -> np.ndarray:
        """`pooled` without the places, by tables of two bytes: fewer look-ups for the same sums."""
        pairs = self._pairs()
        two = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        best = []
        for width, table in zip(WIDTHS, self.tables, strict=True):
            span = x.shape[1] - width + 1
            answer = pairs[width, 0].take(two[:, :span], 0, mode="clip")
            if width == 3:
                answer += table[2].take(x[:, 2 : 2 + span], 0, mode="clip")
            if width == 4:
                answer += pairs[width, 2].take(two[:, 2 : 2 + span], 0, mode="clip")
            best.append(answer.max(1))
        return np.maximum(np.concatenate(best, 1) + self.shift, 0)

    def _pairs(self) -> dict:
        if not hasattr(self, "_two"):
            join = lambda t, k: (t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, -1)
            self._two = {(w, k): join(t, k) for w, t in zip(WIDTHS, self.tables, strict=True) for k in range(0, w - 1, 2)}
        return self._two

    def log_probabilities(self, hidden: np.ndarray) -> np.ndarray:
        z = hidden @ self.out + self.bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and probability of each text; a text that is null or has no letter is `und` with 0."""
        out: list = [(UNKNOWN, 0.0)] * len(texts)
        spoken = [i for i, t in enumerate(texts) if has_letter(t)] if self.names else []
        raws = [encode(texts[i]) for i in spoken]
        x = [cut(r) for r in raws]
        owner = np.repeat(np.arange(len(x)), [len(w) for w in x])
        sums = np.zeros((len(x), len(self.names)))
        sizes = np.concatenate([np.minimum(WINDOW, len(r) - WINDOW * np.arange(len(w))) for r, w in zip(raws, x, strict=True)]) if x else None
        x = np.concatenate(x) if x else np.zeros((0, WINDOW), np.uint8)
        for a in range(0, len(x), BATCH):
            told = self.log_probabilities(self.largest(x[a : a + BATCH]))
            np.add.at(sums, owner[a : a + BATCH], told * sizes[a : a + BATCH, None])
        for i, raw, s in zip(spoken, raws, sums, strict=True):
            p = np.exp((s - s.max()) / len(raw))  # the mean over the bytes: short and long texts alike
            out[i] = self.names[int(s.argmax())], float(p.max() / p.sum())
        return out


def fit(texts: list[str], labels: list[str], epochs: int = 12, rate: float = 0.01, seed: int = 3, windows: int = 4) -> Network:
    """Adam on the cross entropy of single windows; of each text up to `windows` windows at random."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    x, y = [], []
    for text, label in zip(texts, labels, strict=True):
        own = cut(encode(text))
        for i in rng.permutation(len(own))[:windows]:
            x.append(own[i])
            y.append(names.index(label))
    net = Network([rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32),
                  rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(names))).astype(np.float32), np.zeros(len(names), np.float32), names)
    if len(names) < 2:
        return net
    x, y = np.array(x), np.array(y)
    # every language weighs the same, however many texts it has
    weight = (len(y) / len(names) / np.bincount(y, minlength=len(names)))[y]
    parts = [*net.tables, net.shift, net.out, net.bias]
    first, second, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), BATCH):
            some = order[a : a + BATCH]
            hidden, where = net.pooled(x[some])
            delta = np.exp(net.log_probabilities(hidden))
            delta[np.arange(len(some)), y[some]] -= 1
            delta *= weight[some, None] / len(some)
            back = (delta @ net.out.T * (hidden > 0)).astype(np.float32)
            grads = [np.zeros_like(t) for t in net.tables]
            for j, (w, g) in enumerate(zip(WIDTHS, grads, strict=True)):
                cols = slice(j * FILTERS, (j + 1) * FILTERS)
                for k in range(w):
                    seen = x[some][np.arange(len(some))[:, None], where[:, cols] + k]
                    np.add.at(g[k], (seen, np.arange(FILTERS)[None, :]), back[:, cols])
            grads += [back.sum(0), hidden.T @ delta, delta.sum(0)]
            step += 1
            pace = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, m, v in zip(parts, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (pace * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return net


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = 300, seed: int = 3, most_chars: int = 4096, windows: int = 4) -> Network:
    """Fit on at most `sample` texts of each language, chosen by a hash of the text, and `most_chars` characters of each, at a place the hash names; of these at most
    `windows` windows of 256 bytes, drawn at random.  The bounds hold for the fit alone: predictions read whole texts.

    Rows without a language, or whose text is null or has no letter, teach nothing.
    """
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text rlike '[\\\\p{L}]'")
    rows = rows.select("text", "lang", F.xxhash64(F.lit(seed), "text").alias("turn"))
    # first the numbers alone: a bounded list for each language, kept short before the shuffle; then the texts that they name
    place = F.row_number().over(Window.partitionBy("lang").orderBy("turn"))
    chosen = rows.select("lang", "turn").distinct().withColumn("place", place).where(F.col("place") <= sample).select("lang", "turn")
    spot = F.pmod("turn", F.greatest(F.lit(1), F.length("text") - most_chars + 1)).cast("int")
    named = rows.join(F.broadcast(chosen), ["lang", "turn"]).select("lang", "turn", F.substring(F.col("text"), spot + 1, F.lit(most_chars)).alias("text"))
    got = sorted(named.groupBy("lang", "turn").agg(F.min("text").alias("text")).collect())
    return fit([r["text"] for r in got], [r["lang"] for r in got], seed=seed, windows=windows)


def predict(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) for every row of `docs`; see `Network.predict`.  Without any learned language all are `und`."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # fixed tables, some 60 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                told = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.float64())], [id_col, "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, f"`{id_col}` long, lang_pred string, score double")
