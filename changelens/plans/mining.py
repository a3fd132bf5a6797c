"""Registered queries: diff and code mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from changelens.operators import diffs as D
from changelens.operators import symbols as Y
from changelens.plans.sqlbase import CTES, q, query, strip
from changelens.sources import views as V

QUERIES, ORACLES = {}, {}


def _changes(spark, sf, *columns):
    return V.changes(spark, sf).select("pr_id", "diff", *columns)


def _language_sql(path, languages):
    return "CASE " + " ".join(f"WHEN ends_with({path}, {q(e)}) THEN {q(l)}" for e, l in languages.items()) + " ELSE 'unknown' END"


def diff_lines(spark, sf):
    lines = D.diff_lines(_changes(spark, sf))
    return lines.groupBy("diff_file", "sign").agg(
        F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"), F.sum("diff_line").alias("line_no_sum"))


QUERIES["d1_diff_lines"] = diff_lines
ORACLES["d1_diff_lines"] = query("""
SELECT diff_file, CASE WHEN starts_with(line, '+++') OR starts_with(line, '---') THEN 'header' WHEN starts_with(line, '+') THEN 'added'
    WHEN starts_with(line, '-') THEN 'removed' ELSE 'other' END AS sign,
  count(*) AS lines, sum(length(line))::BIGINT AS chars, sum(diff_line)::BIGINT AS line_no_sum
FROM dl GROUP BY ALL""")


def added_lines(spark, sf):
    return D.added_lines(_changes(spark, sf)).select(
        "pr_id", "diff_line", F.col("added_no").cast("bigint"), F.coalesce("code_no", F.lit(-1)).cast("bigint").alias("code_no"),
        "diff_file", F.md5("code").alias("code_md5"))


QUERIES["d2_added_lines"] = added_lines
ORACLES["d2_added_lines"] = query("""
SELECT pr_id, diff_line, added_no, coalesce(code_no, -1) AS code_no, diff_file, md5(code) AS code_md5 FROM added""")


def line_paths(spark, sf):
    return D.diff_lines(_changes(spark, sf)).groupBy("pr_id", "diff_file").agg(
        F.min("diff_line").cast("bigint").alias("first_line"), F.max("diff_line").cast("bigint").alias("last_line"))


QUERIES["d3_line_paths"] = line_paths
ORACLES["d3_line_paths"] = query(
    "SELECT pr_id, diff_file, min(diff_line) AS first_line, max(diff_line) AS last_line FROM dl GROUP BY ALL")

CTES["segments"] = r"""
SELECT *, sum(starts_with(line, 'diff --git ')::INT) OVER (PARTITION BY pr_id ORDER BY diff_line ROWS UNBOUNDED PRECEDING) AS seg FROM dl"""
CTES["files"] = f"""
SELECT pr_id, seg AS file_no,
  coalesce({strip("arg_max(CASE WHEN starts_with(line, '+++ b/') THEN substr(line, 7) END, diff_line) FILTER (starts_with(line, '+++ b/'))")},
    list_extract(string_split(arg_min(line, diff_line), ' b/'), -1)) AS file_path,
  string_agg(line, chr(10) ORDER BY diff_line) AS diff_chunk,
  count(*) FILTER (starts_with(line, '+') AND NOT starts_with(line, '+++')) AS added_lines,
  count(*) FILTER (starts_with(line, '-') AND NOT starts_with(line, '---')) AS removed_lines
FROM segments WHERE seg > 0 GROUP BY pr_id, seg"""
CTES["files_lang"] = f"SELECT *, {_language_sql('file_path', D.TOOL_LANGUAGES)} AS language FROM files"


def file_chunks(spark, sf):
    return D.file_chunks(_changes(spark, sf)).select(
        "pr_id", F.col("file_no").cast("bigint"), "file_path", "language", F.md5("diff_chunk").alias("chunk_md5"),
        F.col("added_lines").cast("bigint"), F.col("removed_lines").cast("bigint"))


QUERIES["d4_file_chunks"] = file_chunks
ORACLES["d4_file_chunks"] = query("""
SELECT pr_id, file_no::BIGINT AS file_no, file_path, language, md5(diff_chunk) AS chunk_md5, added_lines, removed_lines FROM files_lang""")
QUERIES["w1_segment_ids"] = lambda spark, sf: D.file_chunks(_changes(spark, sf)).groupBy("pr_id").agg(
    F.max("file_no").cast("bigint").alias("segments"),
    F.sum(F.size(F.split("diff_chunk", "\n"))).alias("lines"))
ORACLES["w1_segment_ids"] = query(
    "SELECT pr_id, max(seg)::BIGINT AS segments, count(*) AS lines FROM segments WHERE seg > 0 GROUP BY pr_id")
QUERIES["w2_carry_forward_path"] = lambda spark, sf: D.added_lines(_changes(spark, sf)).groupBy("diff_file").agg(
    F.count("*").alias("added"), F.countDistinct("pr_id").alias("changes"))
ORACLES["w2_carry_forward_path"] = query(
    "SELECT diff_file, count(*) AS added, count(DISTINCT pr_id) AS changes FROM added GROUP BY diff_file")


def _code(spark, sf, include_context=True):
    return D.file_chunks(_changes(spark, sf)).withColumn("code", D.code_of(F.col("diff_chunk"), include_context))


_CODE_SQL = r"""
SELECT pr_id, seg AS file_no, string_agg(CASE WHEN starts_with(line, '+') OR starts_with(line, '-') THEN substr(line, 2) ELSE line END, chr(10) ORDER BY diff_line)
  AS code
FROM segments WHERE seg > 0 AND NOT starts_with(line, '+++') AND NOT starts_with(line, '---') AND NOT starts_with(line, '@@') AND NOT starts_with(line, '\') {more}
GROUP BY pr_id, seg"""
CTES["codes"] = _CODE_SQL.format(more="")
CTES["codes_added"] = _CODE_SQL.format(more="AND NOT starts_with(line, '-')")
QUERIES["d5_code_text"] = lambda spark, sf: _code(spark, sf).select(
    "pr_id", F.col("file_no").cast("bigint"), F.md5("code").alias("code_md5"),
    F.md5(D.code_of(F.col("diff_chunk"), False)).alias("added_md5"))
ORACLES["d5_code_text"] = query("""
SELECT c.pr_id, c.file_no::BIGINT AS file_no, md5(c.code) AS code_md5, md5(a.code) AS added_md5
FROM codes c JOIN codes_added a USING (pr_id, file_no)""")


def diff_statistics(spark, sf):
    stats = D.diff_statistics(_changes(spark, sf))
    entries = F.array_sort(F.transform(F.map_entries("files_by_language"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return stats.select(
        "pr_id", F.col("total_files").cast("bigint"), F.col("total_additions").cast("bigint"), F.col("total_removals").cast("bigint"),
        F.array_join(entries, ",").alias("files_by_language"),
        F.array_join(F.transform("files", lambda f: F.concat_ws(":", f["path"], f["additions"].cast("string"), f["removals"].cast("string"))), ",").alias("files"))


QUERIES["d6_diff_statistics"] = diff_statistics
ORACLES["d6_diff_statistics"] = query("""
SELECT t.*, l.files_by_language FROM (
  SELECT pr_id, count(*) AS total_files, sum(added_lines)::BIGINT AS total_additions, sum(removed_lines)::BIGINT AS total_removals,
    string_agg(file_path || ':' || added_lines || ':' || removed_lines, ',' ORDER BY file_no) AS files
  FROM files_lang GROUP BY pr_id) t
JOIN (SELECT pr_id, string_agg(language || '=' || n, ',' ORDER BY language || '=' || n) AS files_by_language
  FROM (SELECT pr_id, language, count(*) AS n FROM files_lang GROUP BY ALL) GROUP BY pr_id) l USING (pr_id)""")

QUERIES["d7_sensitive_files"] = lambda spark, sf: D.sensitive_files(
    D.file_chunks(_changes(spark, sf)).select("pr_id", "file_path"))
ORACLES["d7_sensitive_files"] = query(
    "SELECT pr_id, file_path, list_extract(hit, 1) AS pattern, list_extract(hit, 2) AS reason FROM (SELECT pr_id, file_path, list_extract(list_filter(["
    + ", ".join(f"[{q(w)}, {q(r)}]" for w, r in D.SENSITIVE_PATHS)
    + "], lambda p: contains(lower(file_path), p[1])), 1) AS hit FROM files) WHERE hit IS NOT NULL")


def _chunks(spark, sf, *more):
    return D.code_chunks(_code(spark, sf).select("pr_id", "file_no", "file_path", "language", "code", *more))


CTES["windows"] = """
SELECT pr_id, file_no, file_path, language, s + 1 AS line_start, least(s + 50, n) AS line_end,
  array_to_string(list_slice(ls, s + 1, s + 50), chr(10)) AS content
FROM (SELECT *, unnest(range(0, n, 40)) AS s FROM (SELECT f.*, string_split(c.code, chr(10)) AS ls, len(string_split(c.code, chr(10))) AS n
  FROM codes c JOIN files_lang f USING (pr_id, file_no)))
WHERE s = 0 OR s + 10 < n"""
CTES["chunks"] = r"""
SELECT *, row_number() OVER (PARTITION BY pr_id, file_no ORDER BY line_start) - 1 AS chunk_index
FROM windows WHERE regexp_matches(content, '\S')"""
QUERIES["d8_overlapping_chunks"] = lambda spark, sf: _chunks(spark, sf).select(
    "pr_id", F.col("file_no").cast("bigint"), F.col("chunk_index").cast("bigint"), F.col("line_start").cast("bigint"),
    F.col("line_end").cast("bigint"), F.md5("content").alias("content_md5"))
ORACLES["d8_overlapping_chunks"] = query("""
SELECT pr_id, file_no::BIGINT AS file_no, chunk_index, line_start, line_end, md5(content) AS content_md5 FROM chunks""")

QUERIES["d9_symbols"] = lambda spark, sf: _chunks(spark, sf).select(
    "pr_id", F.col("file_no").cast("bigint"), F.col("chunk_index").cast("bigint"),
    F.array_join(Y.symbols(F.col("content"), F.col("language")), ",").alias("symbols"))


def _symbols_sql() -> str:
    cases = " ".join(
        f"WHEN language IN ({', '.join(q(l) for l in langs)}) THEN flatten([{', '.join(f'regexp_extract_all(content, {q(p)}, 1)' for p in patterns)}])"
        for langs, patterns in Y.SYMBOL_PATTERNS)
    return (f"CASE {cases} ELSE regexp_extract_all(content, {q(Y.OTHER_SYMBOLS)}, 1) END")


# distinct in order of first appearance
CTES["chunk_symbols"] = f"""
SELECT pr_id, file_no, file_path, language, chunk_index, line_start, line_end, content,
  list_filter(all_symbols, lambda x, i: length(x) > 2 AND list_position(all_symbols, x) = i) AS symbols
FROM (SELECT *, {_symbols_sql()} AS all_symbols FROM chunks)"""
ORACLES["d9_symbols"] = query("""
SELECT pr_id, file_no::BIGINT AS file_no, chunk_index, array_to_string(symbols, ',') AS symbols FROM chunk_symbols""")
QUERIES["u2_ordered_distinct"] = lambda spark, sf: _chunks(spark, sf).select(
    F.explode(Y.symbols(F.col("content"), F.col("language"))).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("chunks"))
ORACLES["u2_ordered_distinct"] = query(
    "SELECT symbol, count(*) AS chunks FROM (SELECT unnest(symbols) AS symbol FROM chunk_symbols) GROUP BY symbol")

# Python sources derived from the documents: one function per line, as many branches as the line has words modulo 14.
CTES["functions"] = """
SELECT doc_id, i, 'fn_' || doc_id || '_' || i AS name, len(string_split(l, ' ')) % 14 AS ifs
FROM (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS i, unnest(ls) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"""
QUERIES["d10_python_structure"] = lambda spark, sf: Y.python_structure(Y.python_sources(V.table(spark, sf, "documents"))).filter(
    "kind = 'function'").select("doc_id", "name", F.col("line").cast("bigint"), F.array_join("args", ",").alias("args"), F.col("decorators").cast("bigint"))
ORACLES["d10_python_structure"] = query("""
SELECT doc_id, name, 2 + coalesce(sum(2 + 2 * ifs) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line,
  'a,b' AS args, 0::BIGINT AS decorators FROM functions""")
QUERIES["d11_complexity_hotspots"] = lambda spark, sf: Y.complexity_hotspots(
    Y.python_structure(Y.python_sources(V.table(spark, sf, "documents"))), "doc_id", 5).select(
    "doc_id", "name", F.col("complexity").cast("bigint"), F.col("hot_rank").cast("bigint"))
ORACLES["d11_complexity_hotspots"] = query("""
SELECT doc_id, name, complexity, hot_rank FROM (
  SELECT doc_id, name, 1 + 2 * ifs AS complexity, row_number() OVER (PARTITION BY doc_id ORDER BY ifs DESC, i) AS hot_rank
  FROM functions WHERE 1 + 2 * ifs > 10) WHERE hot_rank <= 5""")


def _odd_sources(spark, sf):
    """The Python files, some with a class and imports in it, some broken, some null."""
    d = F.col("doc_id")
    more = F.when(d % 5 == 0, "def broken(:\n").when(d % 3 == 0, F.concat(F.lit("class C"), d.cast("string"), F.lit(":\n    from json import loads\n    import re, sys\n"))).otherwise("")
    return Y.python_sources(V.table(spark, sf, "documents")).withColumn("code", F.when(d % 50 != 7, F.concat("code", more)))


QUERIES["d10_classes_imports_errors"] = lambda spark, sf: Y.python_structure(_odd_sources(spark, sf)).filter("kind <> 'function'").select(
    "doc_id", "kind", F.when(F.col("kind") != "error", F.col("name")).otherwise(F.regexp_extract("name", "^[A-Za-z ]+", 0)).alias("name"))
ORACLES["d10_classes_imports_errors"] = query("""
SELECT doc_id, 'error' AS kind, CASE WHEN doc_id % 50 = 7 THEN 'No source' ELSE 'Syntax error' END AS name FROM documents WHERE doc_id % 5 = 0 OR doc_id % 50 = 7
UNION ALL SELECT doc_id, 'import', 'os' FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 50 <> 7
UNION ALL SELECT doc_id, kind, name FROM (SELECT doc_id, unnest(['class', 'import', 'import', 'import']) AS kind, unnest(['C' || doc_id, 'json', 're', 'sys']) AS name FROM documents
  WHERE doc_id % 5 <> 0 AND doc_id % 3 = 0 AND doc_id % 50 <> 7)""")
QUERIES["d11_total_complexity"] = lambda spark, sf: Y.total_complexity(Y.python_structure(Y.python_sources(V.table(spark, sf, "documents"))), "doc_id")
ORACLES["d11_total_complexity"] = query("""
SELECT doc_id, (1 + sum(2 * ifs))::BIGINT AS total_complexity, count(*) FILTER (1 + 2 * ifs > 10) AS high_complexity_functions FROM functions GROUP BY doc_id""")
