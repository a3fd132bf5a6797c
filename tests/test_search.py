"""Search over vectors that are missing or odd, and over a stored index."""

import re

from pyspark.sql import functions as F

from changelens.operators import search
from changelens.session import work_dir


def test_odd_vectors_and_queries_have_no_neighbours(spark):
    nan = float("nan")
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [1.0]), (5, [0.0, 2.0]), (6, [0.0, 1.0])], "id long, vector array<double>")
    found = search.nearest_many(corpus, [[0.0, 1.0], [0.0, 0.0]], "id", k=2).orderBy("rank").collect()
    assert [(r.query_no, r.id, r.certainty) for r in found] == [(0, 5, 1.0), (0, 6, 1.0)]
    queries = spark.createDataFrame([(7, [0.0, 3.0]), (8, [0.0, 0.0]), (9, None), (10, [nan, 0.0])], "q long, vector array<double>")
    for slices in (1, 3):
        joined = search.nearest_join(corpus, queries, "id", "q", k=2, slices=slices, blocks=2).orderBy("rank").collect()
        assert [(r.q, r.id, r.certainty) for r in joined] == [(7, 5, 1.0), (7, 6, 1.0)]


def test_filters_of_a_stored_index_prune(spark):
    path = work_dir(spark, "index")
    rows = spark.range(40).select(
        F.col("id").cast("string").alias("pr_id"), F.lit("r").alias("repo"), F.lit("f").alias("file_path"), F.when(F.col("id") % 2 == 0, "python").otherwise("go").alias("language"),
        F.lit("c").alias("content"), F.lit(0).alias("chunk_index"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("vector"))
    search.write_index(rows, path)
    found = search.nearest(search.read_index(spark, path), [1.0, 0.0], ("pr_id", "chunk_index"), k=3, filters={"language": "python"})
    assert [r.pr_id for r in found.collect()] == ["0", "2", "4"]
    assert "PartitionFilters: [isnotnull(language" in found._jdf.queryExecution().executedPlan().toString().replace("PartitionFilters: [(isnotnull(language", "PartitionFilters: [isnotnull(language")
    left = search.delete_from_index(spark, path, rows.filter("id < 10"), work_dir(spark, "index"))
    assert left.count() == 30


def test_reembedding_goes_on_where_it_stopped(spark):
    prs = spark.range(5).select(F.col("id").alias("pr_id"), F.lit("completed").alias("status"))
    first = search.reembed_selection(prs, limit=2)
    indexed = first.select(F.col("pr_id").cast("string"))
    assert [r.pr_id for r in search.reembed_selection(prs, indexed, 2).collect()] == [2, 3]
    assert search.reembed_selection(prs, indexed).count() == 3


def test_groups_of_a_join_grow_in_number_and_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(search, "GROUP_ROWS", 50)
    monkeypatch.setattr(search, "GROUP_QUERIES", 100)
    turn = lambda n: F.array(F.cos(F.col("id") % n), F.sin(F.col("id") % n))
    corpus, queries = spark.range(420).withColumn("vector", turn(70)), spark.range(700).select(F.col("id").alias("q"), turn(70).alias("vector"))
    joined = search.nearest_join(corpus, queries, "id", "q", k=4, slices=2)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"pmod\(xxhash64\(id#\d+L, 42\), 9\)", plan) and re.search(r"pmod\(xxhash64\(q#\d+L, 42\), 7\)", plan), plan
    # six copies of each direction: of equal rows the first by key
    assert {(r.q, r.rank, r.id) for r in joined.collect()} == {(q, i + 1, q % 70 + 70 * i) for q in range(700) for i in range(4)}
