"""A corpus from raw documents to token ids in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm import catalog, mixing, pieces, quality, simhash
from changelens.llm.common import table
from changelens.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  Its model is learned from the labelled rows among its input."""
    name = "score"
    while name in docs.columns:
        name += "_"
    scored = quality.score(docs, catalog.quality_model(spark, docs, sf_dir), score_col=name)
    return scored.where(F.col(name) >= 0.5).drop(name)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, whatever its id: the one with the smallest."""
    return simhash.keep_one(docs)


def pseudonym_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts become pseudonyms; n_chars follows the text."""
    done = catalog.pseudonymized(docs)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: a document comes as often as it is taken, none, once or twice."""
    done = mixing.mixed(docs)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids): token ids of every text, the end id last."""
    return pieces.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded=False).select("doc_id", "ids", "places")


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("pseudonyms", pseudonym_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encode_stage),
]
#: Fitted models, keyed hashes and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
