"""Vector expressions on array columns."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from changelens.functions.text import let


def hash_embedding(text: Column, dimensions: int = 768) -> Column:
    """Unit vector derived from the SHA-256 of the text (V3).

    Value i comes from byte i mod 32 of the digest shifted right by
    (i div 32) mod 8 bits, so it repeats after 256 values: those are computed
    once and laid end to end.
    """
    digest = F.sha2(text, 256)
    octets = let(digest, lambda h: F.transform(
        F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int")))
    shifted = let(octets, lambda b: F.transform(
        F.sequence(F.lit(0), F.lit(255)),
        lambda i: F.call_function("shiftright", F.get(b, i % 32), F.floor(i / 32).cast("int")) / 255.0 - 0.5))
    values = let(shifted, lambda v: F.slice(F.flatten(F.array_repeat(v, -(-dimensions // 256))), 1, dimensions))
    return let(values, lambda v: let(
        F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)),
        lambda m: F.when(m > 0, F.transform(v, lambda x: x / m)).otherwise(v)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine similarity of a vector column with a fixed query vector."""
    literal = F.from_json(F.lit(json.dumps([float(x) for x in query])), "array<double>")
    norm = sum(float(x) ** 2 for x in query) ** 0.5
    return let(vector, lambda v: F.try_divide(dot(v, literal), F.sqrt(dot(v, v)) * norm))
