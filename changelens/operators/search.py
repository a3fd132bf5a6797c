"""Code search: chunk index, nearest vectors, symbols, keyword and hybrid ranking."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changelens.functions.text import once
from changelens.functions.vectors import cosine, hash_embedding
from changelens.operators.diffs import code_chunks, code_of, file_chunks
from changelens.operators.symbols import symbols
from changelens.schemas import CODE_CHUNKS, conform, read_table
from changelens.session import materialize

RANK_CONSTANT = 60  # of reciprocal-rank fusion
BM25_K1, BM25_B = 1.2, 0.75
GROUP_ROWS, GROUP_QUERIES = 8192, 1024  # of one task of a join of vectors


def chunk_index(changes: DataFrame, max_files: int | None = None, max_chunks: int | None = None) -> DataFrame:
    """Code chunks of each change with symbols and vector (V1).

    The work limits (files of a change, chunks of a file) are off by default.
    """
    files = file_chunks(changes)
    if max_files is not None:
        files = files.filter(F.col("file_no") <= max_files)
    coded = once(files, code=code_of(F.col("diff_chunk"))).drop("diff_chunk", "added_lines", "removed_lines", "file_no")
    chunks = code_chunks(coded.filter((F.length("code") >= 50) & F.col("code").rlike(r"\S"))).drop("code")
    if max_chunks is not None:
        chunks = chunks.filter(F.col("chunk_index") < max_chunks)
    return chunks.withColumns({"symbols": symbols(F.col("content"), F.col("language")), "vector": hash_embedding(F.col("content"))})


def write_index(index: DataFrame, path: str) -> None:
    """Append chunks to a stored index, partitioned by language, so that a search of one language reads no other (V1)."""
    conform(index, CODE_CHUNKS).hint("rebalance", "language").write.mode("append").partitionBy("language").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The stored index under its declared columns; filters on ``language`` prune folders, others are pushed to the files (V2)."""
    return read_table(spark, path, CODE_CHUNKS)


def delete_from_index(spark: SparkSession, path: str, deleted: DataFrame, out: str) -> DataFrame:
    """Write the index at ``path`` without the chunks of the deleted changes to ``out`` and read it from there (V7).

    A folder can't be read and overwritten by one job, so the caller puts the new one in the place of the old.
    """
    gone = materialize(deleted.select("pr_id").distinct(), "deleted")
    kept = read_index(spark, path).join(gone, "pr_id", "left_anti")
    # rows come by folder, language by language as they were written: dealing them out again would only move all vectors once more
    conform(kept, CODE_CHUNKS).write.mode("append").partitionBy("language").parquet(out)
    return read_index(spark, out)


def nearest(corpus: DataFrame, query: Sequence[float], key: str | Sequence[str], vector: str = "vector", k: int = 5, filters: dict | None = None) -> DataFrame:
    """The k rows nearest to a vector by cosine, with certainty (1 + cos) / 2 (V2); ties go by the key columns."""
    for name, value in (filters or {}).items():
        corpus = corpus.filter(F.col(name) == value)
    scored = corpus.withColumn("certainty", (1 + cosine(F.col(vector), query)) / 2)
    return scored.orderBy(F.desc("certainty"), *([key] if isinstance(key, str) else key)).limit(k)


def _usable(vectors: pd.Series, width: int) -> np.ndarray:
    """Which vectors are there, of the right length and finite throughout."""
    return np.fromiter((v is not None and len(v) == width and bool(np.isfinite(np.asarray(v, dtype=np.float64)).all()) for v in vectors), dtype=bool, count=len(vectors))


def _best(matrix: np.ndarray, query_ids: np.ndarray, batch: pd.DataFrame, key: str, vector: str, query_key: str, k: int) -> pd.DataFrame:
    """At most k rows of the batch for each normalised query; equal scores in order of the key, as in the final ranking."""
    batch = batch[_usable(batch[vector], matrix.shape[1])]
    if batch.empty or not len(matrix):
        return pd.DataFrame({query_key: query_ids[:0], key: batch[key].to_numpy()[:0], "certainty": np.zeros(0)})
    vectors, keys = np.stack(batch[vector].to_numpy()).astype(np.float64), batch[key].to_numpy()
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    scores = matrix @ (vectors / np.where(norms > 0, norms, 1)).T
    by_key = np.argsort(keys, kind="stable")
    scores = scores[:, by_key]
    # all that reach the k-th best score, sorted: among equal ones the first by key stay
    least = np.partition(scores, -k, axis=1)[:, -k] if k < scores.shape[1] else np.full(len(matrix), -np.inf)
    row, at = np.nonzero(scores >= least[:, None])
    order = np.lexsort((at, -scores[row, at], row))
    row, at = row[order], at[order]
    first = np.searchsorted(row, np.arange(len(matrix)))
    kept = np.arange(len(row)) - first[row] < k
    row, at = row[kept], at[kept]
    return pd.DataFrame({query_key: query_ids[row], key: keys[by_key[at]], "certainty": (1 + scores[row, at]) / 2})


def _normalised(vectors) -> tuple[np.ndarray, np.ndarray]:
    """Directions of the queries that have one, and which these are."""
    matrix = np.asarray(vectors, dtype=np.float64)
    norms = np.linalg.norm(matrix, axis=1)
    some = norms > 0
    return matrix[some] / norms[some, None], some


def _ranked(found: DataFrame, query_key: str, key: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("certainty"), key))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest_many(corpus: DataFrame, queries: Sequence[Sequence[float]], key: str, vector: str = "vector", k: int = 5) -> DataFrame:
    """The k nearest rows for each of the given query vectors (V4); for queries in a table see ``nearest_join``.

    The queries go to the tasks as one matrix, 256 at a time against each batch of rows, and each batch gives at most k candidates per query.
    Rows whose vector is null, of another length or not finite, and queries of length zero, have no neighbours.
    """
    matrix, some = _normalised(queries)
    ids = np.flatnonzero(some)
    key_type = corpus.schema[key].dataType.simpleString()

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(matrix), 256):
                yield _best(matrix[at:at + 256], ids[at:at + 256], batch, key, vector, "query_no", k)

    found = corpus.select(key, vector).mapInPandas(candidates, f"query_no long, `{key}` {key_type}, certainty double")
    return _ranked(found, "query_no", key, k)


def nearest_join(corpus: DataFrame, queries: DataFrame, key: str, query_key: str, vector: str = "vector", query_vector: str = "vector", k: int = 5,
                 slices: int = 64, blocks: int = 1) -> DataFrame:
    """The k nearest rows for each query of a table (V4), as ``nearest_many`` gives them.

    Rows are dealt over slices and queries over blocks by their hash; each pair of a slice and a block is one task's group and gives at most k rows per query.
    Both tables are counted first: there are at least ``slices`` and ``blocks``, and more where a group would go beyond some ``GROUP_ROWS`` rows or
    ``GROUP_QUERIES`` queries, so a group's memory does not follow the tables.  Of a group 256 queries are compared at a time.
    """
    slices, blocks = max(slices, -(-corpus.count() // GROUP_ROWS)), max(blocks, -(-queries.count() // GROUP_QUERIES))
    key_type, query_type = corpus.schema[key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    rows = corpus.select(F.col(key), F.col(vector).alias("_v"), place(key, slices).alias("_slice"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    asked = queries.filter(F.col(query_vector).isNotNull()).select(
        F.col(query_key), F.col(query_vector).alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice"), place(query_key, blocks).cast("int").alias("_block"))
    grouped = lambda df: df.withColumn("_slice", F.col("_slice").cast("int")).groupBy("_slice", "_block")

    def candidates(some_rows: pd.DataFrame, some_queries: pd.DataFrame) -> pd.DataFrame:
        given = some_queries[_usable(some_queries["_v"], len(some_queries["_v"].iloc[0]))] if len(some_queries) else some_queries
        if given.empty:
            return pd.DataFrame({query_key: given[query_key], key: some_rows[key][:0], "certainty": np.zeros(0)})
        matrix, some = _normalised(np.stack(given["_v"].to_numpy()))
        ids = given[query_key].to_numpy()[some]
        found = [_best(matrix[at:at + 256], ids[at:at + 256], some_rows, key, "_v", query_key, k) for at in range(0, max(len(matrix), 1), 256)]
        return pd.concat(found, ignore_index=True)

    found = grouped(rows).cogroup(grouped(asked)).applyInPandas(candidates, f"`{query_key}` {query_type}, `{key}` {key_type}, certainty double")
    return _ranked(found, query_key, key, k)


def by_symbol(index: DataFrame, symbol: str, repo: str | None = None, limit: int = 10, order: Sequence[str] = ("pr_id", "file_path", "chunk_index")) -> DataFrame:
    """Chunks that define a symbol (V5)."""
    hits = index.filter(F.array_contains("symbols", symbol))
    if repo is not None:
        hits = hits.filter(F.col("repo") == repo)
    return hits.orderBy(*order).limit(limit)


def _term_counts(corpus: DataFrame, terms: Sequence[str], text: str) -> DataFrame:
    """The rows with their number of words and of each term."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    frequency = lambda term: F.size(F.filter("_words", lambda w: w == term))
    return once(once(corpus, _words=words), _len=F.size("_words"), **{f"_tf{i}": frequency(t) for i, t in enumerate(terms)}).drop("_words")


def _scored(counted: DataFrame, terms: Sequence[str]) -> DataFrame:
    """BM25 of counted rows, in the place of their counts; the rows are read twice."""
    totals = counted.agg(
        F.count("*").alias("n"), F.avg("_len").alias("mean"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    # one struct, so that all references are to one subquery and the corpus is counted once
    total = totals.select(F.struct(*totals.columns)).scalar()
    n, mean = total["n"], total["mean"]
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"_tf{i}"), total[f"df{i}"]
        idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("_len") / mean))
    return counted.withColumn("bm25", score).drop("_len", *[f"_tf{i}" for i in range(len(terms))])


def _distinct_terms(terms: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(t.lower() for t in terms))


def keyword_scores(corpus: DataFrame, terms: Sequence[str], text: str) -> DataFrame:
    """BM25 of each row for the query terms; term counts stay in the row, only totals are aggregated."""
    terms = _distinct_terms(terms)
    return _scored(_term_counts(corpus, terms, text), terms)


def _exact_ranks(scores: DataFrame, candidates: DataFrame, key: str, score: str, rank: str) -> DataFrame:
    """Rank of each candidate among all rows with a score, counted in parallel.

    The candidates are few by construction.  Every row is placed between two of
    them and only the counts per place are added up: no global sort.
    """
    marks = candidates.filter(F.col(score).isNotNull()).select(F.struct((-F.col(score)).alias("s"), F.col(key).alias("k")).alias("m"))
    ordered = marks.agg(F.sort_array(F.collect_list("m")).alias("marks")).scalar()
    me = F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"))
    place = F.size(F.filter(F.col("_marks"), lambda m: m < F.col("_me")))
    placed = once(scores.filter(F.col(score).isNotNull()), _marks=ordered, _me=me).groupBy(place.alias("_place")).agg(F.count("*").alias("_n"))
    # a row at place p stands behind p candidates, so it counts for every candidate from p on
    before = placed.agg(F.map_from_entries(F.collect_list(F.struct("_place", "_n")))).scalar()
    at = F.array_position(ordered, F.struct((-F.col(score)).alias("s"), F.col(key).alias("k")))
    ranks = candidates.filter(F.col(score).isNotNull()).withColumn("_before", before).withColumn("_at", at).select(
        key, F.aggregate(F.sequence(F.lit(0), F.col("_at").cast("int") - 1), F.lit(0).cast("bigint"), lambda a, i: a + F.coalesce(
            F.try_element_at(F.col("_before"), i), F.lit(0))).alias(rank))
    return ranks


def hybrid(corpus: DataFrame, query: str, query_vector: Sequence[float], key: str, text: str, vector: str = "vector", k: int = 5, alpha: float = 0.5) -> DataFrame:
    """Reciprocal-rank fusion of vector and keyword ranking (V6), exact without sorting the corpus.

    A row in neither of the two best lists of length m scores at most
    1 / (61 + m); k rows of one list alone reach max(alpha, 1 - alpha) / (60 + k).
    Beyond the m where the second exceeds the first no row can enter the result,
    so only those lists are fused, with their exact ranks.
    """
    terms = _distinct_terms(query.split())
    counted = once(_term_counts(corpus, terms, text), _cos=cosine(F.col(vector), query_vector))
    # a few numbers per row, for the totals and the scores: the texts are read once
    counted = materialize(counted.select(key, "_cos", "_len", *[f"_tf{i}" for i in range(len(terms))]), "hybrid-counts")
    return fuse(_scored(counted, terms).select(key, "_cos", F.nullif("bm25", F.lit(0.0)).alias("bm25")), key, k, alpha)


def hybrid_stored(vectors: DataFrame, matches: DataFrame, query_vector: Sequence[float], key: str, vector: str = "vector", k: int = 5, alpha: float = 0.5) -> DataFrame:
    """``hybrid`` with the keyword scores (key, bm25) of a stored index, see ``postings.keyword_matches`` (V6); no text is read."""
    near = vectors.select(F.col(key), cosine(F.col(vector), query_vector).alias("_cos"))
    return fuse(near.join(matches.select(F.col("key").alias(key), F.nullif("bm25", F.lit(0.0)).alias("bm25")), key, "left"), key, k, alpha)


def fuse(scored: DataFrame, key: str, k: int, alpha: float) -> DataFrame:
    """Reciprocal-rank fusion of rows (key, _cos, bm25), bm25 null without a match; see ``hybrid``."""
    depth = max(k, int((RANK_CONSTANT + k) / max(alpha, 1 - alpha)) - RANK_CONSTANT + 1)
    # three narrow columns per row, read by the four steps below
    scored = materialize(scored, "hybrid-scores")
    best = scored.orderBy(F.desc("_cos"), key).limit(depth).unionByName(
        scored.filter(F.col("bm25").isNotNull()).orderBy(F.desc("bm25"), key).limit(depth)).distinct()
    vector_rank = _exact_ranks(scored, best, key, "_cos", "vector_rank")
    keyword_rank = _exact_ranks(scored, best, key, "bm25", "keyword_rank")
    part = lambda weight, rank: F.coalesce(weight / (RANK_CONSTANT + F.col(rank)), F.lit(0.0))
    fused = vector_rank.join(keyword_rank, key, "full_outer").withColumn(
        "score", part(F.lit(alpha), "vector_rank") + part(F.lit(1 - alpha), "keyword_rank"))
    return fused.orderBy(F.desc("score"), key).limit(k)


def delete_change_chunks(index: DataFrame, pr_id: str) -> tuple[DataFrame, DataFrame]:
    """The index without a change's chunks, and the number removed (V7)."""
    mine = F.col("pr_id") == pr_id
    return index.filter(~F.coalesce(mine, F.lit(False))), index.filter(mine).agg(F.count("*").alias("removed"))


def reembed_selection(prs: DataFrame, index: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Completed pull requests that the index lacks (V8): all of them, or a night's batch of ``limit``; the next night takes the next ones."""
    due = prs.filter(F.col("status") == "completed")
    if index is not None:
        stored = index.select(F.col("pr_id").cast(prs.schema["pr_id"].dataType).alias("pr_id")).distinct()
        due = due.join(stored, "pr_id", "left_anti")
    return due if limit is None else due.orderBy("pr_id").limit(limit)
