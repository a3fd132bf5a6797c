"""Awkward diffs against a plain reading of the format."""

import pytest
from pyspark.sql import functions as F

from changelens.operators import diffs as D

TWO_FILES = "\n".join([
    "noise before any file", "+early", "diff --git a/a.py b/a.py", "--- a/a.py", "+++ b/a.py", "@@ -1,2 +1,2 @@", "+one", "-two", " three", "\\ No newline at end of file",
    "diff --git a/x b/y b/x b/y.go", "--- a/x", "+++ b/x b/y.go", "@@ -1 +1 @@", "--- comment removed", "+++ added plus", "+last\r", ""])
ONLY_DELETIONS = "diff --git a/d.js b/d.js\n--- a/d.js\n+++ /dev/null\n-gone\n-away"
NO_HEADER = "+just a line"
BARE = "--- a/z.sql\n+++ b/z.sql\n+select 1"
CASES = [TWO_FILES, ONLY_DELETIONS, NO_HEADER, BARE, "", "diff --git a/e b/e"]


@pytest.fixture(scope="module")
def diffs(spark):
    return spark.createDataFrame([(i, d) for i, d in enumerate(CASES)], "pr_id int, diff string")


def expected_paths(diff):
    path, out = "unknown", []
    for no, line in enumerate(diff.split("\n"), 1):
        if line.startswith("+++ b/"):
            path = line[6:]
        out.append((no, path, line))
    return out


def test_lines_and_paths(diffs):
    rows = D.diff_lines(diffs).select("pr_id", "diff_line", "diff_file", "line").collect()
    assert sorted(map(tuple, rows)) == sorted((i, *row) for i, d in enumerate(CASES) for row in expected_paths(d))


def test_added_numberings(diffs):
    want = []
    for i, diff in enumerate(CASES):
        added = code = 0
        for no, path, line in expected_paths(diff):
            if line.startswith("+"):
                added += 1
                plain = not line.startswith("+++")
                code += plain
                want.append((i, no, added, code if plain else None, path, line[1:]))
    rows = D.added_lines(diffs).select("pr_id", "diff_line", "added_no", "code_no", "diff_file", "code").collect()
    assert sorted(map(tuple, rows)) == sorted(want)


def test_file_chunks(diffs):
    rows = {(r.pr_id, r.file_path): r for r in D.file_chunks(diffs).collect()}
    assert set(rows) == {(0, "a.py"), (0, "x b/y.go"), (1, "d.js"), (3, "z.sql"), (5, "e")}
    assert (rows[0, "a.py"].added_lines, rows[0, "a.py"].removed_lines, rows[0, "a.py"].language) == (1, 1, "python")
    # "--- comment" and "+++ added" look like headers and are not counted
    assert (rows[0, "x b/y.go"].added_lines, rows[0, "x b/y.go"].removed_lines) == (1, 0)
    assert (rows[1, "d.js"].added_lines, rows[1, "d.js"].removed_lines) == (0, 2)
    assert rows[3, "z.sql"].diff_chunk == BARE
    assert "noise" not in rows[0, "a.py"].diff_chunk


def test_code_text(diffs):
    code = {r.file_path: r for r in D.file_chunks(diffs).filter("pr_id = 0").select(
        "file_path", D.code_of(F.col("diff_chunk")).alias("all"), D.code_of(F.col("diff_chunk"), False).alias("added")).collect()}
    assert code["a.py"].all == "diff --git a/a.py b/a.py\none\ntwo\n three"
    assert code["a.py"].added == "diff --git a/a.py b/a.py\none\n three"


def plain_chunks(code, size=50, overlap=10):
    lines, out, stride = code.split("\n"), [], max(1, size - overlap)
    for start in range(0, len(lines), stride):
        end = min(start + size, len(lines))
        content = "\n".join(lines[start:end])
        if not content.strip():
            continue
        out.append((len(out), start + 1, end, content))
        if end >= len(lines):
            break
    return out


@pytest.mark.parametrize("n", [1, 49, 50, 51, 90, 91, 130, 131])
def test_chunk_windows(spark, n):
    texts = ["\n".join(f"line {i}" for i in range(n)), "\n".join([""] * n), "\n".join(["x"] + [""] * (n - 1))]
    for text in texts:
        rows = D.code_chunks(spark.createDataFrame([(text,)], "code string")).select("chunk_index", "line_start", "line_end", "content").collect()
        assert sorted(map(tuple, rows)) == plain_chunks(text)


def test_statistics(diffs):
    row = D.diff_statistics(diffs).filter("pr_id = 0").first()
    assert (row.total_files, row.total_additions, row.total_removals) == (2, 2, 1)
    assert row.files_by_language == {"python": 1, "go": 1}


def test_no_operator_shuffles(diffs):
    for df in (D.diff_lines(diffs), D.added_lines(diffs), D.file_chunks(diffs), D.diff_statistics(diffs)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
