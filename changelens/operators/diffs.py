"""Unified diffs to files, lines, code and chunks.

A diff is one cell, so everything that depends on earlier or later lines of the
same diff is computed inside the row with array functions: no operator here
shuffles.  Work is linear in the length of the diff.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.functions.text import lookup, strip

# ---------------------------------------------------------------------------
# Languages by file extension and sensitive path words.
# ---------------------------------------------------------------------------
AGENT_LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript", ".tsx": "typescript",
    ".go": "go", ".java": "java", ".rb": "ruby", ".php": "php", ".cs": "csharp", ".cpp": "cpp", ".c": "c",
    ".rs": "rust", ".kt": "kotlin", ".swift": "swift", ".sh": "bash", ".sql": "sql", ".yaml": "yaml",
    ".yml": "yaml", ".tf": "terraform",
}
TOOL_LANGUAGES = AGENT_LANGUAGES | {".json": "json", ".md": "markdown", ".html": "html", ".css": "css"}
SENSITIVE_PATHS = [
    ("auth", "Authentication/Authorization module"),
    ("security", "Security configuration"),
    ("crypto", "Cryptographic code"),
    ("payment", "Payment processing"),
    ("billing", "Billing system"),
    ("admin", "Admin interface"),
    ("config", "Application configuration"),
    ("settings", "Application settings"),
    ("secret", "Secrets/credentials"),
    ("password", "Password handling"),
    ("token", "Token management"),
    ("jwt", "JWT implementation"),
    ("oauth", "OAuth flow"),
    (".env", "Environment variables"),
    ("migration", "Database migration"),
    ("schema", "Database schema"),
    ("permission", "Permission system"),
    ("role", "Role management"),
]


def language_of(path: Column, languages: dict[str, str] = TOOL_LANGUAGES) -> Column:
    return lookup(F.regexp_extract(path, r"(\.[^./]+)$", 1), languages, "unknown")


def _cut(items: Column, positions: Column) -> Column:
    """Slices of ``items`` starting at 0 and at each of the ascending positions."""
    starts = F.concat(F.array(F.lit(0)), positions)
    ends = F.concat(positions, F.array(F.size(items)))
    return F.transform(
        F.arrays_zip(starts.alias("a"), ends.alias("b")),
        lambda p: F.slice(items, p["a"] + 1, p["b"] - p["a"]),
    )


def _positions(items: Column, test) -> Column:
    return F.filter(F.transform(items, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())


def _following(kept: Column, i: Column, n: int) -> Column:
    """Text of the next ``n`` kept lines that are not ``+++`` lines."""

    def take(stop):
        near = F.filter(F.slice(kept, i + 2, stop), lambda s: ~s["line"].startswith("+++"))
        return F.slice(near, 1, n)

    near = take(F.lit(n + 16))
    return F.transform(
        F.when((F.size(near) == n) | (i + 1 + n + 16 >= F.size(kept)), near).otherwise(take(F.size(kept))),
        lambda s: F.substring(s["line"], 2, 2**31 - 1),
    )


def _explode_pieces(df: DataFrame, kept: str) -> DataFrame:
    """Explode an array of line structs, carrying the last ``+++ b/`` path forward.

    The array is cut at every ``+++`` line, each cut piece knows its path, and
    the pieces are exploded before their lines, so no line looks back.
    """
    columns = [c for c in df.columns if c != kept]
    cut = df.withColumn("_at", _positions(F.col(kept), lambda s: s["line"].startswith("+++")))
    cut = cut.withColumn("_heads", F.transform("_at", lambda i: F.get(F.col(kept), i)["line"]))
    cut = cut.withColumn("_pieces", F.transform(
        _cut(F.col(kept), F.col("_at")),
        lambda body, k: F.struct(
            k.alias("headers"),
            F.when(k == 0, 0).otherwise(F.get(F.col("_at"), k - 1)).alias("offset"),
            F.when(F.get(F.col("_heads"), k - 1).startswith("+++ b/"), F.get(F.col("_heads"), k - 1)).otherwise(
                F.try_element_at(F.filter(F.slice("_heads", 1, k), lambda h: h.startswith("+++ b/")), F.lit(-1))
            ).alias("head"),
            body.alias("body"),
        ),
    ))
    # outer: a plain explode would infer a size filter and push all of the above down a second time
    pieces = cut.select(*columns, F.explode_outer("_pieces").alias("_p")).select(*columns, "_p.*")
    lines = pieces.select(*columns, "headers", "offset", "head", F.posexplode("body").alias("_pos", "_l"))
    return lines.select(
        *columns,
        F.col("_l.*"),
        F.coalesce(F.substring("head", 7, 2**31 - 1), F.lit("unknown")).alias("diff_file"),
        (F.col("offset") + F.col("_pos") + 1).alias("kept_no"),
        "headers",
    )


def diff_lines(diffs: DataFrame) -> DataFrame:
    """Every diff line with its number, sign class and file."""
    columns = [c for c in diffs.columns if c != "diff"]
    kept = diffs.select(*columns, F.transform(F.split("diff", "\n"), lambda l: F.struct(l.alias("line"))).alias("_kept"))
    sign = F.substring("line", 1, 1)
    return _explode_pieces(kept, "_kept").select(
        *columns,
        F.col("kept_no").alias("diff_line"),
        F.when(F.col("line").startswith("+++") | F.col("line").startswith("---"), "header")
        .when(sign == "+", "added").when(sign == "-", "removed").otherwise("other").alias("sign"),
        "diff_file", "line",
    )


def added_lines(diffs: DataFrame, context: int = 0, context_when=None, pair_when=None) -> DataFrame:
    """Added lines under all three numberings.

    ``diff_line`` counts all lines; ``added_no`` counts ``+`` lines including
    ``+++`` headers; ``code_no`` leaves the headers out and is null on them.
    Where ``context_when(code)`` holds, ``following`` has the next ``context``
    lines of the ``code_no`` numbering; where ``pair_when(code)`` holds,
    ``pair`` is the line joined with the next line of the ``added_no`` numbering.
    """
    columns = [c for c in diffs.columns if c != "diff"]
    numbered = diffs.select(*columns, F.filter(
        F.transform(F.split("diff", "\n"), lambda l, i: F.struct((i + 1).alias("diff_line"), l.alias("line"))),
        lambda s: s["line"].startswith("+"),
    ).alias("_plus"))
    text = lambda s: F.substring(s["line"], 2, 2**31 - 1)

    def extras(s, i):
        # lower case is materialised here, once per line, for the many literal tests that follow
        fields = [s["diff_line"].alias("diff_line"), s["line"].alias("line"),
                  text(s).alias("code"), F.lower(text(s)).alias("low")]
        if context_when is not None:
            wanted = context_when(text(s)) & ~s["line"].startswith("+++")
            fields.append(F.when(wanted, _following(F.col("_plus"), i, context)).alias("following"))
        if pair_when is not None:
            fields.append(F.when(pair_when(text(s)), F.concat(text(s), F.lit("\n"), text(F.get(F.col("_plus"), i + 1)))).alias("pair"))
        return F.struct(*fields)

    out = _explode_pieces(numbered.select(*columns, F.transform("_plus", extras).alias("_kept")), "_kept")
    return (
        out.withColumn("added_no", F.col("kept_no"))
        .withColumn("code_no", F.when(~F.col("line").startswith("+++"), F.col("kept_no") - F.col("headers")))
        .drop("kept_no", "headers")
    )


def with_file_array(diffs: DataFrame) -> DataFrame:
    """Add ``files``: one struct per file segment of the diff."""
    columns = [c for c in diffs.columns if c != "diff"]
    lines = diffs.select(*columns, F.split("diff", "\n").alias("_ls"))
    segments = lines.select(*columns, _cut(
        F.col("_ls"), _positions(F.col("_ls"), lambda l: l.startswith("diff --git "))
    ).alias("_segments"))

    def describe(seg, k):
        named = F.filter(seg, lambda l: l.startswith("+++ b/"))
        path = F.coalesce(
            strip(F.substring(F.try_element_at(named, F.lit(-1)), 7, 2**31 - 1)),
            F.when(k > 0, F.element_at(F.split(F.get(seg, F.lit(0)), " b/"), -1)),
        )
        # text before the first file header belongs to no file
        first = F.array_position(F.transform(seg, lambda l: l.startswith("+++ b/")), F.lit(True))
        body = F.when(k > 0, seg).otherwise(F.filter(
            seg, lambda l, i: (i + 1 >= first) | l.startswith("--- ") | l.startswith("+++ ")))
        return F.struct(path.alias("file_path"), body.alias("body"))

    described = segments.select(*columns, F.filter(
        F.transform("_segments", describe), lambda f: F.coalesce(f["file_path"], F.lit("")) != ""
    ).alias("_files"))
    return described.select(*columns, F.transform("_files", lambda f, k: F.struct(
        (k + 1).alias("file_no"),
        f["file_path"].alias("file_path"),
        language_of(f["file_path"]).alias("language"),
        F.array_join(f["body"], "\n").alias("diff_chunk"),
        F.size(F.filter(f["body"], lambda l: l.startswith("+") & ~l.startswith("+++"))).alias("added_lines"),
        F.size(F.filter(f["body"], lambda l: l.startswith("-") & ~l.startswith("---"))).alias("removed_lines"),
    )).alias("files"))


def file_chunks(diffs: DataFrame) -> DataFrame:
    """One row per changed file with its part of the diff and line counts."""
    columns = [c for c in diffs.columns if c != "diff"]
    exploded = with_file_array(diffs).select(*columns, F.explode_outer("files").alias("f"))
    return exploded.filter(F.col("f").isNotNull()).select(*columns, "f.*")


def code_of(diff_chunk: Column, include_context: bool = True) -> Column:
    """Code text of a file's diff: signs stripped, headers and markers dropped."""
    kept = F.filter(F.split(diff_chunk, "\n"), lambda l: ~(
        l.startswith("+++") | l.startswith("---") | l.startswith("@@") | l.startswith("\\")
        | (F.lit(not include_context) & l.startswith("-"))
    ))
    return F.array_join(F.transform(kept, lambda l: F.when(
        l.startswith("+") | l.startswith("-"), F.substring(l, 2, 2**31 - 1)).otherwise(l)), "\n")


def diff_statistics(diffs: DataFrame) -> DataFrame:
    """Totals, files per language and a file list for each diff, within the row."""
    columns = [c for c in diffs.columns if c != "diff"]
    languages = F.transform("files", lambda f: f["language"])
    return with_file_array(diffs).select(
        *columns,
        F.size("files").alias("total_files"),
        F.aggregate("files", F.lit(0), lambda a, f: a + f["added_lines"]).alias("total_additions"),
        F.aggregate("files", F.lit(0), lambda a, f: a + f["removed_lines"]).alias("total_removals"),
        F.map_from_entries(F.transform(
            F.array_distinct(languages),
            lambda g: F.struct(g, F.size(F.filter("files", lambda f: f["language"] == g)).cast("bigint")),
        )).alias("files_by_language"),
        F.transform("files", lambda f: F.struct(
            f["file_path"].alias("path"), f["language"].alias("language"),
            f["added_lines"].alias("additions"), f["removed_lines"].alias("removals"))).alias("files"),
    )


def sensitive_files(files: DataFrame) -> DataFrame:
    """Files whose path holds a sensitive word, with the first such word and its reason."""
    path = F.lower("file_path")
    word = F.coalesce(*[F.when(path.contains(w), F.lit(w)) for w, _ in SENSITIVE_PATHS])
    return files.withColumn("pattern", word).filter(F.col("pattern").isNotNull()).withColumn(
        "reason", lookup(F.col("pattern"), dict(SENSITIVE_PATHS)))


def code_chunks(files: DataFrame, size: int = 50, overlap: int = 10) -> DataFrame:
    """Overlapping line windows over each file's ``code``."""
    stride = max(1, size - overlap)
    columns = files.columns
    windows = files.select("*", F.split("code", "\n").alias("_ls")).select(*columns, F.transform(
        # a window starts only if the one before it did not reach the end
        F.filter(F.sequence(F.lit(0), F.size("_ls") - 1, F.lit(stride)),
                 lambda s: (s == 0) | (s - stride + size < F.size("_ls"))),
        lambda s: F.struct(
            (s + 1).alias("line_start"),
            F.least(s + size, F.size("_ls")).alias("line_end"),
            F.array_join(F.slice("_ls", s + 1, size), "\n").alias("content"),
        ),
    ).alias("_w"))
    return windows.select(*columns, F.posexplode_outer(
        F.filter("_w", lambda w: w["content"].rlike(r"\S"))
    ).alias("chunk_index", "_c")).filter(F.col("_c").isNotNull()).select(*columns, "chunk_index", "_c.*")
