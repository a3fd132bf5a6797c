"""Structure of Python sources: one walk of each tree, whatever its nesting."""

import ast
import time

from changelens.operators import symbols as Y


def nested(depth, lines):
    """Functions within functions; the innermost one has the branches."""
    heads = "".join(" " * i + f"def f{i}(a):\n" for i in range(depth))
    return heads + (" " * depth + "if a and a: a = a\n") * lines


def plain(code):
    """The rule told plainly: every function walks all that lies in it."""
    score = lambda f: 1 + sum(isinstance(n, Y._BRANCHES) + (len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0) for n in ast.walk(f))
    return [(n.name, score(n)) for n in ast.walk(ast.parse(code)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]


def test_a_nested_function_counts_in_its_parents():
    code = nested(4, 3) + "class C:\n  @(x or y)\n  async def m(self, b=(p and q and r)):\n    return [i for i in b if i]\nz = lambda: u or v\nmatch z:\n  case {'k': 1} if p or q:\n    def g(): assert p\n"
    assert [(r[1], r[6]) for r in Y._structure(code) if r[0] == "function"] == plain(code)


def test_time_follows_the_source_and_not_its_nesting():
    code = nested(80, 4000)
    start = time.perf_counter()
    ast.parse(code)
    parsed = time.perf_counter() - start
    start = time.perf_counter()
    rows = Y._structure(code)
    assert time.perf_counter() - start < 15 * parsed + 0.2
    assert {r[6] for r in rows} == {8001} and len(rows) == 80


def test_rows_of_every_source_with_their_keys(spark):
    sources = spark.createDataFrame([(1, "x", "import os\ndef f(a, b): pass\n" * 6000), (2, None, None), (None, "y", "def broken(:\n"), (4, "z", "")], "k long, other string, code string")
    got = Y.python_structure(sources).groupBy("k", "other", "kind").count().collect()
    assert sorted(map(tuple, got), key=repr) == [(1, "x", "function", 6000), (1, "x", "import", 6000), (2, None, "error", 1), (None, "y", "error", 1)]
