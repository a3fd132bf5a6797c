"""What several operators share: table access, a checkpoint in the shared folder, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.session import work_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The rows of `df`, stored by checkpoint() in the folder that ``spark.checkpoint.dir`` names."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or work_dir(spark, "checkpoints"))
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """(node, component_id): the smallest node reachable, for every node of the undirected `edges` (a, b).

    Alternates large-star and small-star steps until the edges are stars around the smallest nodes.  Each step takes the smallest
    neighbour of a node by a partial aggregate and joins it back (an ordinary join, whose large keys adaptive execution splits), so no
    neighbourhood is ever gathered in one place; the edges never grow in number.  Every round is stored before the next one.
    Edges with a null end or from a node to itself carry nothing and are left out.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b")
    edges = cut(edges.distinct())

    def state() -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    before = state()
    while before[0]:
        # large star: every neighbour above the node is tied to the smallest node around it
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a"), F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # small star: a node and its smaller neighbours are tied to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        edges = cut(small.where("a <> b").distinct())
        if (now := state()) == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component_id")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component_id")).distinct())
