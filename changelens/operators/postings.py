"""Keyword search over a stored inverted index (V6).

A word's postings lie in blocks of bounded size, chosen by a hash of the row, and a block keeps its largest count and shortest row: with the word's weight these
give the most that a row of the block can get from the word.  Rows, their words in all, and the rows that hold a word are kept as sums for each
write, so adding rows rewrites nothing.  The files lie by a hash of the word: a query reads only its own words' folders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.functions.text import once
from changelens.operators.search import BM25_B, BM25_K1
from changelens.session import materialize

BUCKETS, BLOCK, SLICE = 256, 256, 500_000


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def write_postings(corpus: DataFrame, path: str, key: str, text: str, buckets: int = BUCKETS, block: int = BLOCK) -> None:
    """Add rows to the index.  Keys must be new to it; null and empty texts count as rows without words.

    A word of a third of all rows is many blocks: its rows are dealt by their hash, counted first, never gathered whole.  A task takes blocks of a slice of a bucket,
    some ``SLICE`` words of text.
    """
    words = F.array_sort(F.filter(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != ""))
    rows = once(corpus.select(key, text), _words=words).select(F.col(key).alias("key"), "_words", F.size("_words").alias("len"))
    spark, total = corpus.sparkSession, rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("len").cast("bigint")), F.lit(0)).alias("words")).first()
    spark.createDataFrame([total], "n bigint, words bigint").coalesce(1).write.mode("append").parquet(f"{path}/totals")
    # a row's own words are counted in the row: equal ones stand together
    begun = once(rows.filter("len > 0"), _starts=_starts("len", lambda i: F.get("_words", i) != F.get("_words", i - 1)))
    counts = F.transform("_starts", lambda p, i: F.struct(F.get("_words", p).alias("word"), (F.coalesce(F.get("_starts", i + 1), F.col("len")) - p).cast("bigint").alias("tf")))
    counted = begun.select("key", "len", F.inline(counts))
    # words of more than one block are a small part of all words; a small table goes to every task, so the postings themselves are shuffled once
    held = materialize(counted.groupBy("word").agg(F.count("*").alias("df")).filter(F.col("df") > block), "frequent-words")
    deal = F.coalesce(F.pmod(F.xxhash64(F.col("key").cast("string")), F.ceil(F.col("df") / block)), F.lit(0))
    slices = -(-total["words"] // (buckets * SLICE)) or 1
    dealt = counted.join(held, "word", "left").withColumn("block", deal).withColumns({"bucket": _bucket(F.col("word"), buckets), "slice": F.pmod(F.xxhash64("word", "block"), F.lit(slices))})
    blocks = dealt.repartition("bucket", "slice").groupBy("bucket", "slice", "word", "block").agg(F.array_sort(F.collect_list(F.struct("key", "len", "tf"))).alias("_found"))
    # a key that repeats against the rule is one row with the sum of its counts
    at = lambda i: F.get("_found", i)
    same = once(blocks, _size=F.size("_found"))
    same = once(same, _starts=_starts("_size", lambda i: ~at(i)["key"].eqNullSafe(at(i - 1)["key"]) | (at(i)["len"] != at(i - 1)["len"])))
    upto = lambda i: F.coalesce(F.get("_starts", i + 1), F.col("_size"))
    summed = lambda p, i: F.aggregate(F.slice("_found", p + 1, upto(i) - p), F.lit(0).cast("bigint"), lambda a, r: a + r["tf"])
    placed = once(same, rows=F.transform("_starts", lambda p, i: F.struct(at(p)["key"].alias("key"), summed(p, i).alias("tf"), at(p)["len"].alias("len")))).select(
        "word", "rows", F.array_max("rows.tf").alias("most"), F.array_min("rows.len").alias("shortest"), F.size("rows").cast("bigint").alias("n"), "bucket")
    placed.sortWithinPartitions("bucket", "word").write.mode("append").partitionBy("bucket").parquet(f"{path}/blocks")


def _starts(size: str, differs) -> Column:
    """Places in a sorted array of at least one entry where an entry differs from the one before."""
    return F.filter(F.sequence(F.lit(0), F.col(size) - 1), lambda i: (i == 0) | differs(i))


def _blocks(spark: SparkSession, path: str, terms: Sequence[str], buckets: int) -> DataFrame:
    """Blocks of the terms; folders and row groups of other words are not read."""
    places = spark.range(1).select(F.array(*[_bucket(F.lit(t), buckets) for t in terms])).first()[0]
    return spark.read.parquet(f"{path}/blocks").filter(F.col("bucket").isin(*places) & F.col("word").isin(*terms))


def _terms(text_terms: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(t.lower() for t in text_terms))


class _Weights:
    """What BM25 needs of the whole corpus for some terms: a few sums over sums."""

    def __init__(self, spark: SparkSession, path: str, terms: Sequence[str], blocks: DataFrame) -> None:
        total = spark.read.parquet(f"{path}/totals").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
        self.n, words = total["n"] or 0, total["words"] or 0
        self.mean = words / self.n if self.n else 0.0
        df = {r["word"]: r["df"] for r in blocks.groupBy("word").agg(F.sum("n").alias("df")).collect()}
        self.idf = [F.log(1 + (F.lit(self.n) - F.lit(df.get(t, 0)) + 0.5) / (F.lit(df.get(t, 0)) + 0.5)) for t in terms]

    def part(self, i: int, tf: Column, length: Column) -> Column:
        return self.idf[i] * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / F.lit(self.mean)))


def _summed(postings: DataFrame, terms: Sequence[str], weights: _Weights) -> DataFrame:
    """(key, bm25) of rows of postings (word, key, tf, len), added in the order of the terms."""
    counts = postings.groupBy("key").agg(F.first("len").alias("len"), *[F.coalesce(F.max(F.when(F.col("word") == t, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, t in enumerate(terms)])
    score = F.lit(0.0)
    for i in range(len(terms)):
        score = score + weights.part(i, F.col(f"tf{i}"), F.col("len"))
    return counts.select("key", score.alias("bm25"))


def keyword_matches(spark: SparkSession, path: str, terms: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """(key, bm25) of every row that holds one of the terms, the scores of ``search.keyword_scores``; only the terms' postings are read (V6)."""
    terms = _terms(terms)
    blocks = _blocks(spark, path, terms, buckets)
    weights = _Weights(spark, path, terms, blocks)
    return _summed(blocks.select("word", F.explode("rows").alias("r")).select("word", "r.*"), terms, weights)


def top_keywords(spark: SparkSession, path: str, terms: Sequence[str], k: int = 10, buckets: int = BUCKETS, report: dict | None = None) -> DataFrame:
    """(key, bm25) of the k best rows, ties by key; blocks that can't hold one of them are not opened (V6).

    What a row gets from one term is a floor of its score, so the k-th best of these, over the blocks of highest bounds, is a floor of the k-th score.  Terms whose largest
    bounds together stay below it bring no row up by themselves, so their blocks are closed, as is a block whose bound and the other terms' largest bounds
    stay below it.  A row among the k best is in an open block of some term, and is then scored from all its postings.
    ``report`` takes the numbers of blocks in all and opened.
    """
    terms = _terms(terms)
    blocks = _blocks(spark, path, terms, buckets)
    weights = _Weights(spark, path, terms, blocks)
    bound = F.coalesce(*[F.when(F.col("word") == t, weights.part(i, F.col("most"), F.col("shortest"))) for i, t in enumerate(terms)])
    bounded = blocks.withColumn("bound", bound)
    highest = {r["word"]: r["bound"] for r in bounded.groupBy("word").agg(F.max("bound").alias("bound")).collect()}
    # k blocks hold k rows at least; each gives its largest single contributions
    first = bounded.orderBy(F.desc("bound"), "word").limit(k).select("word", F.explode("rows").alias("r")).select("word", "r.*")
    alone = F.coalesce(*[F.when(F.col("word") == t, weights.part(i, F.col("tf"), F.col("len"))) for i, t in enumerate(terms)])
    best = [r["s"] for r in first.select("key", alone.alias("s")).groupBy("key").agg(F.max("s").alias("s")).orderBy(F.desc("s")).limit(k).collect()]
    floor = best[-1] if len(best) == k else 0.0
    others = F.coalesce(*[F.when(F.col("word") == t, F.lit(sum(v for w, v in highest.items() if w != t))) for t in terms])
    weak, below = [], 0.0
    for word, most in sorted(highest.items(), key=lambda x: (x[1], x[0])):
        below += most
        if below >= floor * (1 - 1e-9):
            break
        weak.append(word)
    opened = bounded.filter(~F.col("word").isin(*weak)) if weak else bounded
    opened = opened.filter(F.col("bound") + others >= F.lit(floor * (1 - 1e-9)))
    if report is not None:
        report.update(blocks=blocks.count(), opened=opened.count())
    rows = opened.select(F.explode("rows.key").alias("key")).distinct()
    postings = blocks.select("word", F.explode("rows").alias("r")).select("word", "r.*").join(rows, "key", "left_semi")
    return _summed(postings, terms, weights).filter("bm25 > 0").orderBy(F.desc("bm25"), "key").limit(k)
