"""Column helpers shared by the operators: text, lookups, hashes, formats."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities from most to least serious.
SEVERITIES = ("critical", "high", "medium", "low", "info")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df, **columns: Column):
    """Add columns that later filters read instead of repeating their expressions.

    The optimizer moves filters below projections and copies the expressions
    into them; it does not move them below a generator.
    """
    kept = [c for c in df.columns if c not in columns]
    added = F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()])))
    return df.select(*kept, added).select(*df.columns, *[c for c in columns if c not in df.columns])


def any_of(conditions: Iterable[Column]) -> Column:
    """Logical OR of conditions; false when there are none."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True when one of the words is a substring (LIKE would treat ``_`` as a wildcard)."""
    return any_of([text.contains(w) for w in words])


def count_contained(text: Column, words: Iterable[str]) -> Column:
    """How many of the words are substrings."""
    return reduce(lambda a, b: a + b, [F.when(text.contains(w), 1).otherwise(0) for w in words])


def first_contained(text: Column, labels: Sequence[tuple[str, str]]) -> Column:
    """Label of the first listed word found in the text, else null."""
    return F.coalesce(*[F.when(text.contains(word), F.lit(label)) for word, label in labels])


def strip(text: Column) -> Column:
    """Drop white space (not only spaces) at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def java(pattern: str) -> str:
    """Pattern with ``.`` excluding the line feed only, so a carriage return still matches."""
    return "(?d)" + pattern


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(java(pattern))


def quote(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_contains_any(text: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quote(w)})" for w in words) + ")"


def sql_matches(text: str, pattern: str) -> str:
    return f"({text} RLIKE {quote(java(pattern))})"


def literal_rows(rows: list[dict], schema: str) -> Column:
    """A constant array of structs; the optimizer folds it to one literal."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")


def literal_map(mapping: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(mapping)), "map<string,string>")


def literal_table(spark, rows: list[dict], schema: str):
    """A constant DataFrame; small enough to broadcast because it is written in code."""
    return spark.sql("SELECT inline(from_json(:j, :s))", args={"j": json.dumps(rows), "s": f"array<struct<{schema}>>"})


def lookup(key: Column, mapping: dict[str, str], default: str | None = None) -> Column:
    found = F.try_element_at(literal_map(mapping), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def severity_rank(severity: Column) -> Column:
    """1 for critical to 5 for info, 6 for anything else."""
    pos = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)
    return F.when(F.coalesce(pos, F.lit(0)) == 0, 6).otherwise(pos).cast("int")


def risk_band(score: Column) -> Column:
    return F.when(score > 0.7, "red").when(score > 0.3, "amber").otherwise("green")


def duration_text(seconds: Column) -> Column:
    """``--`` for null, ``x.xs`` below a minute, else ``Nm Ns``."""
    whole = F.floor(seconds / 60)
    return (
        F.when(seconds.isNull(), "--")
        .when(seconds < 60, F.concat(F.format_string("%.1f", F.round(seconds, 1)), F.lit("s")))
        .otherwise(
            F.concat(
                whole.cast("string"), F.lit("m "),
                F.round(seconds - whole * 60, 0).cast("bigint").cast("string"), F.lit("s"),
            )
        )
    )


def hmac_sha256(secret: str, body: Column) -> Column:
    """Hex HMAC-SHA256 of a binary column, composed from ``sha2``."""
    import hashlib

    key = secret.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in key))
    outer = F.lit(bytearray(b ^ 0x5C for b in key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body), 256))), 256)
