"""Symbols in code: native regular expressions for any language, ``ast`` for Python."""

from __future__ import annotations

import ast
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Symbol patterns by language, in matching order.
# ---------------------------------------------------------------------------
SYMBOL_PATTERNS = [
    (("python",), [
        r"def\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(",
        r"class\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*[:\(]",
        r"async\s+def\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(",
    ]),
    (("javascript", "typescript"), [
        r"function\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(",
        r"const\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*(?:async\s+)?\(",
        r"class\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*[{\(]",
        r"([a-zA-Z_][a-zA-Z0-9_]*)\s*:\s*(?:async\s+)?function",
    ]),
    (("go",), [
        r"func\s+(?:\([^)]+\)\s+)?([a-zA-Z_][a-zA-Z0-9_]*)\s*\(",
        r"type\s+([a-zA-Z_][a-zA-Z0-9_]*)\s+struct",
    ]),
    (("java",), [
        r"(?:public|private|protected|static).*\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(",
        r"class\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*",
        r"interface\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*",
    ]),
]
OTHER_SYMBOLS = r"(?:def|function|func|class)\s+([a-zA-Z_][a-zA-Z0-9_]*)"


def symbols(content: Column, language: Column, limit: int | None = None) -> Column:
    """Distinct symbols longer than two letters, pattern by pattern (D9); only the first ``limit`` where one is given."""
    def found(pattern):
        return F.regexp_extract_all(content, F.lit("(?d)" + pattern), F.lit(1))

    every = None
    for languages, patterns in SYMBOL_PATTERNS:
        branch = F.concat(*[found(p) for p in patterns])
        test = language.isin(*languages)
        every = F.when(test, branch) if every is None else every.when(test, branch)
    every = every.otherwise(found(OTHER_SYMBOLS))
    kept = F.filter(F.array_distinct(every), lambda s: F.length(s) > 2)
    return kept if limit is None else F.slice(kept, 1, limit)


def python_sources(documents: DataFrame) -> DataFrame:
    """Python files standing in for repository sources: one function per document line."""
    def function(line, i):
        ifs = F.size(F.split(line, " ")) % 14
        return F.concat(
            F.lit("def fn_"), F.col("doc_id").cast("string"), F.lit("_"), i.cast("string"), F.lit("(a, b):\n"),
            F.repeat(F.lit("    if a and b:\n        a = b\n"), ifs), F.lit("    return a\n"))

    return documents.select("doc_id", F.concat(
        F.lit("import os\n"), F.array_join(F.transform(F.split("text", "\n"), function), "")).alias("code"))


_BRANCHES = (ast.If, ast.While, ast.For, ast.ExceptHandler, ast.With, ast.Assert, ast.comprehension)
_NAMED = (ast.BoolOp, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Import, ast.ImportFrom)
_SYMBOL_SCHEMA = "kind string, name string, line int, args array<string>, decorators int, is_async boolean, complexity int, total_lines int"
_SYMBOL_NAMES = [c.split()[0] for c in _SYMBOL_SCHEMA.split(", ")]
_SYMBOL_TYPES = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.bool_(), pa.int32(), pa.int32()]
# fields that hold names, numbers, operators or import aliases: nothing below them is counted
_PLAIN = frozenset(("arg", "attr", "conversion", "ctx", "id", "is_async", "kind", "kwd_attrs", "level", "module", "name", "names", "op", "ops", "rest", "simple", "tag", "type_comment", "type_ignores"))


class _Kinds(dict):
    """What a type of node counts (1 a branch, 2 looked at by its type, 0 nothing) and its fields that may lead to nodes worth a visit; none for constants and other values."""

    def __missing__(self, kind: type) -> tuple[int, tuple[str, ...]]:
        nodes = issubclass(kind, ast.AST) and kind is not ast.Constant
        counted = 1 if issubclass(kind, _BRANCHES) else 2 if issubclass(kind, _NAMED) else 0
        self[kind] = counted, tuple(f for f in kind._fields if f not in _PLAIN) if nodes else ()
        return self[kind]


_KINDS = _Kinds()


def _structure(code: str | None) -> list[tuple]:
    """Rows of one source.  One that is null, or that the parser or the walk cannot take (null bytes, very deep nesting), is one error row."""
    if code is None:
        return [("error", "No source", None, [], 0, False, 0, 0)]
    lines = code.count("\n") + 1
    collects = gc.isenabled()
    gc.disable()  # a tree has no cycles: it goes with its last reference, and looking for cycles in it only costs time
    try:
        return _nodes(ast.parse(code), lines)
    except SyntaxError as error:
        return [("error", f"Syntax error: {error}", None, [], 0, False, 0, lines)]
    except (RecursionError, MemoryError, ValueError) as error:
        return [("error", f"Not parsed: {type(error).__name__}", None, [], 0, False, 0, lines)]
    finally:
        if collects:
            gc.enable()


def _nodes(tree: ast.AST, lines: int) -> list[tuple]:
    """Rows in the order of ``ast.walk``, in one walk: each branch counts for the function it lies in, and a function's count for the one around it."""
    rows, around, counts = [], [], []
    nodes, inside = [tree], [-1]
    for node, owner in zip(nodes, inside):  # both lists grow on the way
        kind = node.__class__
        counted, fields = _KINDS[kind]
        if not counted:
            pass
        elif counted == 1:
            if owner >= 0:
                counts[owner] += 1
        elif kind is ast.BoolOp:
            if owner >= 0:
                counts[owner] += len(node.values) - 1
        elif kind is ast.FunctionDef or kind is ast.AsyncFunctionDef:
            around.append((owner, len(rows)))
            owner = len(counts)
            counts.append(0)
            rows.append(("function", node.name, node.lineno, [a.arg for a in node.args.args], len(node.decorator_list), kind is ast.AsyncFunctionDef, 0, lines))
        elif kind is ast.ClassDef:
            rows.append(("class", node.name, node.lineno, [], 0, False, 0, lines))
        elif kind is ast.Import:
            rows.extend(("import", alias.name, node.lineno, [], 0, False, 0, lines) for alias in node.names)
        elif kind is ast.ImportFrom:
            rows.append(("import", node.module or "", node.lineno, [], 0, False, 0, lines))
        for field in fields:
            below = getattr(node, field, None)
            if below.__class__ is list:
                if below:
                    nodes += below
                    inside += [owner] * len(below)
            elif _KINDS[below.__class__][1]:
                nodes.append(below)
                inside.append(owner)
    for i in range(len(counts) - 1, -1, -1):  # inner functions come after outer ones
        outer, at = around[i]
        if outer >= 0:
            counts[outer] += counts[i]
        rows[at] = (*rows[at][:6], 1 + counts[i], lines)
    return rows


def python_structure(sources: DataFrame, code: str = "code") -> DataFrame:
    """One row per function, class, import or syntax error of each Python source.

    Structure summaries take the synchronous functions only (``not is_async``);
    complexity counts both, and a nested function also counts in its parent.
    """
    names = [f.name for f in sources.schema.fields if f.name != code]

    def frame(rows: list[tuple], keys: list[pa.Array], sources_of: list[int]) -> pa.RecordBatch:
        at = pa.array(sources_of, pa.int32())
        told = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), _SYMBOL_TYPES, strict=True)]
        return pa.RecordBatch.from_arrays([k.take(at) for k in keys] + told, names=[*names, *_SYMBOL_NAMES])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = [batch.column(n) for n in names], batch.column(code)
            rows, sources_of = [], []
            for i in range(batch.num_rows):  # one text at a time: no second copy of the batch
                found = _structure(texts[i].as_py())
                rows += found
                sources_of += [i] * len(found)
                if len(rows) >= 10_000:  # a frame holds this many rows and those of one more source
                    yield frame(rows, keys, sources_of)
                    rows, sources_of = [], []
            if rows:
                yield frame(rows, keys, sources_of)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sources.schema.fields if f.name != code) + ", " + _SYMBOL_SCHEMA
    return sources.mapInArrow(parse, schema)


def complexity_hotspots(structure: DataFrame, key: str, top: int, threshold: int = 10) -> DataFrame:
    """Functions above the complexity threshold, the ``top`` ones of each key."""
    order = Window.partitionBy(key).orderBy(F.desc("complexity"), "line", "name")
    hot = structure.filter((F.col("kind") == "function") & (F.col("complexity") > threshold))
    return hot.withColumn("hot_rank", F.row_number().over(order)).filter(F.col("hot_rank") <= top)


def total_complexity(structure: DataFrame, key: str) -> DataFrame:
    """1 plus the complexity beyond the base of every function of a source."""
    functions = F.col("kind") == "function"
    return structure.groupBy(key).agg(
        (1 + F.coalesce(F.sum(F.when(functions, F.col("complexity") - 1)), F.lit(0))).alias("total_complexity"),
        F.count_if(functions & (F.col("complexity") > 10)).alias("high_complexity_functions"))
