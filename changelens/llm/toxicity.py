"""Toxicity by multiple-instance learning: sentences are scored, noisy-or makes a document of them, only documents have labels.

A document is toxic if any of its sentences makes it so: P = 1 - (1 - leak) * product over sentences of (1 - p_s).  A sentence's p_s is
1 - exp(-a_s), with a_s = softplus(b + z_s) - softplus(b) and not below 0, and z_s the weights of its distinct words.  A sentence without any evidence so has p_s = 0,
and a long clean text stays clean; labels that no sentence explains go to the leak.  Weights come from the likelihood of the documents' labels alone, by
gradient steps with soft thresholds that leave few words with a weight.  The same sentence scores then say where a text offends.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A sentence is what ends in these signs or a line end, and the signs with it.
SENTENCE = re.compile(r"[^.!?。！？\n]+[.!?。！？]*")
WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str | None) -> Iterator[tuple[int, int, set[str]]]:
    """(start, end, distinct words) of every sentence of a whole text that has a word; offsets are code points."""
    for found in SENTENCE.finditer(text or ""):
        if words := set(WORD.findall(found.group().lower())):
            yield found.start(), found.end(), words


def softplus(x):
    return np.logaddexp(0.0, x)


@dataclass
class Model:
    """`weights` of words, `base` (b), `leak`: the chance that a text is toxic with no sentence to show for it."""

    weights: dict[str, float]
    base: float
    leak: float

    def evidence(self, words: set[str]) -> float:
        z = sum(self.weights[w] for w in words & self.weights.keys())
        return float(softplus(self.base + z) - softplus(self.base)) if z > 0 else 0.0

    def judge(self, text: str | None) -> tuple[float, float, int | None, int | None]:
        """Score of the text; score, start and end of its worst sentence (0 and nulls if none has any evidence; of equal ones the first)."""
        total, worst, start, end = 0.0, 0.0, None, None
        for a, b, words in sentences(text):
            if own := self.evidence(words):
                total += own
                if own > worst:
                    worst, start, end = own, a, b
        return float(1 - (1 - self.leak) * np.exp(-total)), float(-np.expm1(-worst)), start, end


def loss(parts: tuple[np.ndarray, float, float], bags: tuple, y: np.ndarray) -> tuple[float, tuple[np.ndarray, float, float]]:
    """Mean negative log likelihood of the documents' labels, and its gradient in (weights, base, hidden leak).

    `bags`: for each word in a sentence its number and its sentence; for each sentence its document.
    """
    w, base, hidden = parts
    word, sentence, document = bags
    n = len(y)
    z = np.bincount(sentence, w[word], len(document))
    on = z > 0
    grow = np.where(on, softplus(base + z) - softplus(base), 0.0)
    total = np.bincount(document, grow, n) + softplus(hidden)
    positive = y == 1
    # -log(1 - exp(-A)) for a toxic text, A for another
    value = np.where(positive, -np.log(-np.expm1(-total)), total).mean()
    slope = np.where(positive, -1 / np.expm1(total), 1.0) / n
    up = 1 / (1 + np.exp(-(base + z)))
    by_sentence = slope[document] * on
    return float(value), (np.bincount(word, (by_sentence * up)[sentence], len(w)), float((by_sentence * (up - 1 / (1 + np.exp(-base)))).sum()), float((slope / (1 + np.exp(-hidden))).sum()))


def fit(texts: list[str], y: list[int], least: int = 5, steps: int = 300, rate: float = 0.1, sparse: float = 0.02) -> Model:
    """Maximum likelihood by Adam: first with an L1 penalty of `sparse` / sqrt(texts) by soft thresholds, then without it for the words it left.

    Words of fewer than `least` of the texts get no weight.
    """
    split = [[words for _, _, words in sentences(t)] for t in texts]
    counts = Counter(w for doc in split for w in set().union(*doc))
    names = sorted(w for w, n in counts.items() if n >= least)
    place = {w: i for i, w in enumerate(names)}
    word, sentence, document = [], [], []
    for d, doc in enumerate(split):
        for words in doc:
            if known := [place[w] for w in words if w in place]:
                word += known
                sentence += [len(document)] * len(known)
                document.append(d)
    y = np.array(y)
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.0
    if not names or len(set(y.tolist())) < 2:
        return Model({}, 0.0, share)
    bags = np.array(word), np.array(sentence), np.array(document)
    # every word starts with the same small push, so that sentences are alive; the likelihood sorts them out
    parts = [np.full(len(names), 0.02), -2.0, float(np.log(np.expm1(-np.log1p(-0.2))))]
    first, second = [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]
    penalty, live = sparse / len(y) ** 0.5, np.ones(len(names))
    for step in range(1, steps + 1):
        if step == 2 * steps // 3:
            penalty, live = 0.0, (parts[0] > 0).astype(float)
            parts[0] = parts[0] * live
        _, grads = loss(tuple(parts), bags, y)
        grads = grads[0] * live, *grads[1:]
        pace = rate * (1 - step / (steps + 1))
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            scale = pace / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
            parts[k] = parts[k] - scale * first[k] / (1 - 0.9**step)
            if k == 0:
                parts[0] = np.sign(parts[0]) * np.maximum(np.abs(parts[0]) - scale * penalty, 0) * live
    weights = {w: float(v) for w, v in zip(names, parts[0], strict=True) if v}
    return Model(weights, float(parts[1]), float(-np.expm1(-softplus(parts[2]))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", sample: int = 4000, longest: int = 16384, seed: int = 13) -> Model:
    """Fit on at most `sample` different labelled texts of at most `longest` bytes, half of each label, chosen by a hash of the text.

    The bounds hold for the fit alone: scores read whole texts.  Copies of a text with one label are one text.  Labels other than 0 and 1, null ids and null
    texts teach nothing.  Without texts of both labels no word gets a weight and every text scores the share of label 1 (0 without any text).
    """
    text = F.col(f"`{text_col}`").cast("string")
    texts_of = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(F.lit(seed), text).alias("turn"))
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("label in (0, 1)").distinct()
    # first the numbers alone; labels grow with the documents, so they are never broadcast
    slim = texts_of.where(F.octet_length("text") <= longest).select("id", "turn").join(marks.hint("merge"), "id")
    slim = slim.groupBy("label", "turn").agg(F.min("id").alias("id"))
    count = {r["label"]: r["n"] for r in slim.groupBy("label").agg(F.count("*").alias("n")).collect()}
    # hashes below a threshold are some twice as many as are needed, whatever the number of rows; of these the smallest are taken
    top = {c: min(1.0, sample / n) for c, n in count.items()}
    bound = [F.when((F.col("label") == c) & (F.col("turn") <= int(min(2.0**63 - 1024, -(2.0**63) + share * 2.0**64))), True) for c, share in top.items()]
    few = slim.where(F.coalesce(*bound)) if bound else slim.where("false")
    place = F.row_number().over(Window.partitionBy("label").orderBy("turn", "id"))
    chosen = few.withColumn("place", place).where(F.col("place") <= sample // 2).select("id", "turn", "label")
    # at most `sample` short rows, so the broadcast is bounded
    named = texts_of.join(F.broadcast(chosen), ["id", "turn"]).groupBy("label", "turn").agg(F.first("text").alias("text"))
    got = sorted((r["text"], r["label"]) for r in named.select("text", "label").collect())
    return fit([t for t, _ in got], [c for _, c in got])


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", worst_col: str = "worst") -> DataFrame:
    """`docs` with `score_col`, a double from 0 to 1 that is never null, and `worst_col`, a struct (score, start, end) of the worst sentence.

    Whole texts are read, however long; a null text counts as an empty one and scores the leak.  No row is dropped, repeated ones each keep theirs.
    Columns of `docs` of these two names are replaced.
    """
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few weights: as many as the bounded sample has words

    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            told = [shared.value.judge(t) for t in texts]
            yield pd.DataFrame({"score": [t[0] for t in told], "worst": [t[1] for t in told], "start": pd.array([t[2] for t in told], "Int64"), "end": pd.array([t[3] for t in told], "Int64")})

    judged.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    told = pandas_udf(judged, "score double, worst double, start long, end long")(F.col(f"`{text_col}`").cast("string"))
    inner = "told"
    while inner in docs.columns:
        inner += "_"
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (score_col, worst_col)]
    both = docs.select(*[F.col(f"`{c}`") for c in docs.columns], told.alias(inner))
    return both.select(*rest, F.col(f"{inner}.score").alias(score_col), F.struct(F.col(f"{inner}.worst").alias("score"), F.col(f"{inner}.start").alias("start"), F.col(f"{inner}.end").alias("end")).alias(worst_col))


def offending(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id_col, start, end, sentence, score): every sentence whose own score reaches the threshold, by code points of its text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = text.as_py() or ""
                rows += [(key, a, b, own[a:b], p) for a, b, words in sentences(own) if (p := float(-np.expm1(-shared.value.evidence(words)))) >= threshold]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [id_col, "start", "end", "sentence", "score"])

    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.mapInArrow(run, f"`{id_col}` long, start long, end long, sentence string, score double")
