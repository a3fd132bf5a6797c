"""Registered queries: code search."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from changelens.operators import cells as C
from changelens.operators import postings as P
from changelens.operators import search as V
from changelens.functions.vectors import hash_embedding
from changelens.plans.mining import CTES
from changelens.plans.sqlbase import query
from changelens.session import work_dir
from changelens.sources import views

QUERIES, ORACLES = {}, {}


def _index(spark, sf):
    return V.chunk_index(views.changes(spark, sf).select("pr_id", F.col("repo_full_name").alias("repo"), "diff"))


CTES["chunk_bytes"] = """
SELECT c.*, 'org/' || s.source AS repo, list_transform(range(0, 256), lambda i: ((('0x' || substr(sha256(c.content), 2 * (i % 32) + 1, 2))::INT >> (i // 32)::INT) & 255) / 255.0::DOUBLE - 0.5::DOUBLE) AS v
FROM chunk_symbols c JOIN codes k USING (pr_id, file_no) JOIN changes0 s ON c.pr_id = s.d::VARCHAR
WHERE length(k.code) >= 50 AND regexp_matches(k.code, '\\S')"""
CTES["chunk_vectors"] = "SELECT *, sqrt(3 * list_sum(list_transform(v, lambda x: x * x))) AS norm FROM chunk_bytes"

QUERIES["v1_chunk_index"] = lambda spark, sf: _index(spark, sf).select(
    "pr_id", "repo", "file_path", "language", F.col("chunk_index").cast("bigint"), F.col("line_start").cast("bigint"), F.col("line_end").cast("bigint"),
    F.md5("content").alias("content_md5"), F.array_join("symbols", ",").alias("symbols"),
    *[F.round(F.get("vector", F.lit(i)), 6).alias(f"v{i}") for i in (0, 1, 255, 256, 767)])
ORACLES["v1_chunk_index"] = query("""
SELECT pr_id, repo, file_path, language, chunk_index, line_start, line_end, md5(content) AS content_md5, array_to_string(symbols, ',') AS symbols,
  round(v[1] / norm, 6) AS v0, round(v[2] / norm, 6) AS v1, round(v[256] / norm, 6) AS v255, round(v[1] / norm, 6) AS v256, round(v[256] / norm, 6) AS v767
FROM chunk_vectors""")
QUERIES["v3_hash_embedding"] = lambda spark, sf: views.table(spark, sf, "documents").select("doc_id", hash_embedding(F.col("text")).alias("v")).select(
    "doc_id", F.size("v").cast("bigint").alias("dimensions"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("square"),
    F.round(F.get("v", F.lit(37)), 6).alias("v37"))
ORACLES["v3_hash_embedding"] = query("""
SELECT doc_id, 768::BIGINT AS dimensions, 1.0::DOUBLE AS square, round(v[38] / sqrt(3 * list_sum(list_transform(v, lambda x: x * x))), 6) AS v37
FROM (SELECT doc_id, list_transform(range(0, 256), lambda i: ((('0x' || substr(sha256(text), 2 * (i % 32) + 1, 2))::INT >> (i // 32)::INT) & 255) / 255.0::DOUBLE - 0.5::DOUBLE) AS v
  FROM documents)""")

_WAVE = [math.sin(i + 1) for i in range(64)]
_WAVE_SQL = "[" + ", ".join(repr(x) for x in _WAVE) + "]::DOUBLE[]"
QUERIES["v2_nearest_chunks"] = lambda spark, sf: V.nearest(
    views.table(spark, sf, "embeddings"), _WAVE, "vec_id", "embedding", 10).select("vec_id", F.col("label").cast("bigint"), F.round("certainty", 6).alias("certainty"))
ORACLES["v2_nearest_chunks"] = query(f"""
SELECT vec_id, label::BIGINT AS label, round((1 + list_cosine_similarity(embedding::DOUBLE[], {_WAVE_SQL})) / 2, 6) AS certainty
FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_WAVE_SQL}) DESC, vec_id LIMIT 10""")
_QUERIES = [[math.sin((i + 1) * (j + 1)) for i in range(64)] for j in range(12)]
QUERIES["v4_nearest_many"] = lambda spark, sf: V.nearest_many(
    views.table(spark, sf, "embeddings"), _QUERIES, "vec_id", "embedding", 5).select("query_no", "vec_id", F.col("rank").cast("bigint"), F.round("certainty", 6).alias("certainty"))
ORACLES["v4_nearest_many"] = query(f"""
SELECT query_no, vec_id, rank, round((1 + c) / 2, 6) AS certainty FROM (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY c DESC, vec_id) AS rank FROM (
  SELECT query_no, vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS c FROM embeddings,
    (VALUES {', '.join(f"({j}::BIGINT, [{', '.join(repr(x) for x in q)}]::DOUBLE[])" for j, q in enumerate(_QUERIES))}) t(query_no, q))) WHERE rank <= 5""")
QUERIES["v5_symbol_search"] = lambda spark, sf: V.by_symbol(_index(spark, sf), "delete").select("pr_id", "file_path", F.col("chunk_index").cast("bigint"), F.lit("delete").alias("symbol"))
ORACLES["v5_symbol_search"] = query("""
SELECT pr_id, file_path, chunk_index, 'delete' AS symbol FROM chunk_bytes WHERE list_contains(symbols, 'delete') ORDER BY pr_id, file_path, chunk_index LIMIT 10""")

_TEXT, _LONG_WAVE = "def transfer step pkg", [math.sin(i + 1) for i in range(768)]
_LONG_SQL = "[" + ", ".join(repr(x) for x in _LONG_WAVE) + "]::DOUBLE[]"


def _hybrid(spark, sf):
    keyed = _index(spark, sf).withColumn("chunk", F.concat_ws("|", "pr_id", "file_path", "chunk_index"))
    return V.hybrid(keyed.select("chunk", "content", "vector"), _TEXT, _LONG_WAVE, "chunk", "content", k=10).select(
        "chunk", F.coalesce("vector_rank", F.lit(-1)).alias("vector_rank"), F.coalesce("keyword_rank", F.lit(-1)).alias("keyword_rank"), F.round("score", 9).alias("score"))


QUERIES["v6_hybrid_search"] = _hybrid
_TERMS = _TEXT.split()
CTES["bag"] = """
SELECT pr_id || '|' || file_path || '|' || chunk_index AS chunk, list_filter(string_split_regex(lower(content), '[^\\p{L}\\p{N}_]+'), lambda w: w <> '') AS words,
  flatten([v, v, v]) AS vec FROM chunk_bytes"""
CTES["term_counts"] = "SELECT chunk, vec, len(words) AS dl, " + ", ".join(f"len(list_filter(words, lambda w: w = '{t}')) AS tf{i}" for i, t in enumerate(_TERMS)) + " FROM bag"
CTES["term_totals"] = "SELECT count(*) AS n, avg(dl) AS mean, " + ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(_TERMS))) + " FROM term_counts"
_BM25 = " + ".join(f"ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))" for i in range(len(_TERMS)))
ORACLES["v6_hybrid_search"] = query(f"""
SELECT chunk, rv AS vector_rank, coalesce(rk, -1) AS keyword_rank, round(score, 9) AS score FROM (
  SELECT a.chunk, rv, rk, 0.5::DOUBLE / (60 + rv) + coalesce(0.5::DOUBLE / (60 + rk), 0) AS score
  FROM (SELECT chunk, row_number() OVER (ORDER BY list_cosine_similarity(vec, {_LONG_SQL}) DESC, chunk) AS rv FROM term_counts) a
  LEFT JOIN (SELECT chunk, row_number() OVER (ORDER BY b DESC, chunk) AS rk FROM (SELECT chunk, {_BM25} AS b FROM term_counts, term_totals) WHERE b > 0) k USING (chunk))
ORDER BY score DESC, chunk LIMIT 10""")


def _stored(spark, sf):
    """The index written to a table and read back."""
    path = work_dir(spark, "chunk-index")
    V.write_index(_index(spark, sf), path)
    return path, V.read_index(spark, path)


_HASH_CERTAINTY = f"(1 + list_cosine_similarity(flatten([v, v, v]), {_LONG_SQL})) / 2"
QUERIES["v2_stored_index_search"] = lambda spark, sf: V.nearest(
    _stored(spark, sf)[1], _LONG_WAVE, ("pr_id", "file_path", "chunk_index"), k=10, filters={"language": "python", "repo": "org/src0"}).select(
    "pr_id", "file_path", F.col("chunk_index").cast("bigint"), F.round("certainty", 5).alias("certainty"))
ORACLES["v2_stored_index_search"] = query(f"""
SELECT pr_id, file_path, chunk_index, round({_HASH_CERTAINTY}, 5) AS certainty FROM chunk_bytes WHERE language = 'python' AND repo = 'org/src0'
ORDER BY {_HASH_CERTAINTY} DESC, pr_id, file_path, chunk_index LIMIT 10""")
QUERIES["v4_nearest_join"] = lambda spark, sf: V.nearest_join(
    views.table(spark, sf, "embeddings"), views.table(spark, sf, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"),
    "vec_id", "query_id", "embedding", "embedding", 5, slices=8).select("query_id", "vec_id", F.col("rank").cast("bigint"), F.round("certainty", 6).alias("certainty"))
ORACLES["v4_nearest_join"] = query("""
SELECT query_id, vec_id, rank, round((1 + c) / 2, 6) AS certainty FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS c FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)) WHERE rank <= 5""")


def _in_cells(spark, sf):
    path, rows = work_dir(spark, "cells"), views.table(spark, sf, "embeddings")
    C.write_cells(rows, path, "vec_id", "embedding", pivots=64)
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return C.nearest_in_cells(path, asked, "vec_id", "query_id", "embedding", 5).select("query_id", "vec_id", F.col("rank").cast("bigint"), F.round("certainty", 6).alias("certainty"))


QUERIES["v4_nearest_in_cells"] = _in_cells
ORACLES["v4_nearest_in_cells"] = ORACLES["v4_nearest_join"]


def _postings(spark, sf):
    """Stored chunks, and their postings written in two parts."""
    stored, path = work_dir(spark, "chunks"), work_dir(spark, "postings")
    _index(spark, sf).withColumn("chunk", F.concat_ws("|", "pr_id", "file_path", "chunk_index")).select("chunk", "content", "vector", "pr_id").write.parquet(stored)
    chunks = spark.read.parquet(stored)
    for part in (0, 1):
        P.write_postings(chunks.filter(F.col("pr_id").cast("bigint") % 2 == part), path, "chunk", "content", 32)
    return chunks, path


def _hybrid_stored(spark, sf):
    chunks, path = _postings(spark, sf)
    return V.hybrid_stored(chunks.select("chunk", "vector"), P.keyword_matches(spark, path, _TERMS, 32), _LONG_WAVE, "chunk", k=10).select(
        "chunk", F.coalesce("vector_rank", F.lit(-1)).alias("vector_rank"), F.coalesce("keyword_rank", F.lit(-1)).alias("keyword_rank"), F.round("score", 9).alias("score"))


QUERIES["v6_hybrid_from_postings"] = _hybrid_stored
ORACLES["v6_hybrid_from_postings"] = ORACLES["v6_hybrid_search"]


def _top_keywords(spark, sf):
    _, path = _postings(spark, sf)
    return P.top_keywords(spark, path, _TERMS, 20, 32).select(F.col("key").alias("chunk"), F.round("bm25", 9).alias("bm25"))


QUERIES["v6_top_keywords"] = _top_keywords
ORACLES["v6_top_keywords"] = query(f"SELECT chunk, round(b, 9) AS bm25 FROM (SELECT chunk, {_BM25} AS b FROM term_counts, term_totals) WHERE b > 0 ORDER BY b DESC, chunk LIMIT 20")


def _after_delete(spark, sf):
    path, _ = _stored(spark, sf)
    gone = views.table(spark, sf, "documents").filter("doc_id % 7 = 0").select(F.col("doc_id").cast("string").alias("pr_id"))
    return V.delete_from_index(spark, path, gone, work_dir(spark, "chunk-index"))


QUERIES["v7_stored_index_after_delete"] = lambda spark, sf: _after_delete(spark, sf).groupBy("language").agg(F.count("*").alias("chunks"))
ORACLES["v7_stored_index_after_delete"] = query("SELECT language, count(*) AS chunks FROM chunk_bytes WHERE pr_id::BIGINT % 7 <> 0 GROUP BY language")
QUERIES["v7_delete_change_chunks"] = lambda spark, sf: V.delete_change_chunks(_index(spark, sf), "7")[1]
ORACLES["v7_delete_change_chunks"] = query("SELECT count(*) AS removed FROM chunk_bytes WHERE pr_id = '7'")
QUERIES["v7_index_after_delete"] = lambda spark, sf: V.delete_change_chunks(_index(spark, sf), "7")[0].groupBy("language").agg(F.count("*").alias("chunks"))
ORACLES["v7_index_after_delete"] = query("SELECT language, count(*) AS chunks FROM chunk_bytes WHERE pr_id <> '7' GROUP BY language")
QUERIES["v8_reembed_selection"] = lambda spark, sf: V.reembed_selection(
    views.pr_facts(spark, sf), _stored(spark, sf)[1]).select("pr_id")
ORACLES["v8_reembed_selection"] = query("SELECT pr_id FROM pr_facts WHERE status = 'completed' AND pr_id::VARCHAR NOT IN (SELECT pr_id FROM chunk_bytes)")
