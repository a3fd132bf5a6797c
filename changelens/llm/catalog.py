"""Registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm import chat, language, lexical, merkle, mixing, pieces, pseudonyms, quality, simhash, token_files, toxicity, vectors, whitening
from changelens.llm.common import table
from changelens.session import work_dir

#: Key of the pseudonyms where spark.changelens.pseudonymKey is not set; whoever has it can undo them, so set your own.
KEY = b"demonstration key"
END_ID = 2


def _bucket(modulus: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "token-files")
    token_files.write_ids(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return token_files.read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(spark, docs, sf_dir))
    held = F.coalesce(_bucket(3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    """Learned from the labelled documents whose crc32 leaves 0 or 2 modulo 3."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.train(docs.where(_bucket(3) != 1), labels.where(_bucket(3) != 1))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = language.train(docs.where(_bucket(4) != 2))
    return language.predict(docs, net).withColumn("held_out", F.coalesce(_bucket(4) == 2, F.lit(False)))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.rotate(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ";")
    return found.withColumn("mask", mask)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.edits(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_tokens", F.sha2("id_list", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "tiled")


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymized(table(spark, sf_dir, "documents").select("doc_id", "text"), "found")


def pseudonymized(docs: DataFrame, found_col: str | None = None) -> DataFrame:
    """Under the key in the setting spark.changelens.pseudonymKey; the constant stands in where there is none, as in tests."""
    key = docs.sparkSession.conf.get("spark.changelens.pseudonymKey", None)
    return pseudonyms.pseudonymize(docs, key.encode() if key else KEY, found_col=found_col)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(docs.where(_bucket(3) != 1), labels.where(_bucket(3) != 1))
    held = F.coalesce(_bucket(3) == 1, F.lit(False))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
                         F.col("worst.start").alias("worst_start"), F.col("worst.end").alias("worst_end"), F.col("worst.score").alias("worst_score"))


QUERIES = {f.__name__: f for f in (
    op1_embedding_near_dedup, op2_token_files, op3_quality_classifier, op4_language_id, op5_mixing, op6_chat_perspectives,
    op7_simhash_near_dedup, op8_merkle_fingerprints, op9_sentencepiece, op10_pseudonyms, op11_ranked_search, op12_whitening, op13_toxicity)}

ORACLES = {
    "op6_chat_perspectives": """
WITH said AS (
  SELECT conv_id, turn, role, replace(coalesce(role, 'unknown'), '<|', '< |') AS name, replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS body
  FROM conversations),
seats AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role IS NOT NULL AND role <> 'system'),
lines AS (
  SELECT s.conv_id, p.perspective, s.turn, s.role, s.body, coalesce(s.role = p.perspective, false) AS own,
    CASE WHEN s.role = p.perspective THEN '<|assistant|>' WHEN s.role = 'system' THEN '<|' || s.name || '|>' ELSE '<|user name=' || s.name || '|>' END || chr(10) AS head
  FROM said s JOIN seats p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, coalesce(floor(turn / 1024), -1)::BIGINT AS part,
    coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, coalesce(floor(turn / 1024), -1) ORDER BY turn, role, body ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM lines),
parts AS (
  SELECT conv_id, perspective, part, count(*) AS n_turns, string_agg(head || body, '' ORDER BY turn, role, body) AS text,
    coalesce(string_agg((pos + length(head))::VARCHAR || '-' || (pos + length(head) + length(body))::VARCHAR, ';' ORDER BY turn, role, body) FILTER (WHERE own), '') AS mask
  FROM placed GROUP BY ALL)
SELECT conv_id, perspective, part, n_turns, text, mask,
  coalesce(sum(length(text)) OVER (PARTITION BY conv_id, perspective ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
FROM parts""",
    "op11_ranked_search": r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
items AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT item_id, term, count(*) AS times FROM items GROUP BY ALL),
total AS (SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM docs WHERE len(terms) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, n),
spread AS (SELECT r, doc_id, 25 + (75 * len(terms) * n) // l AS m FROM docs, total WHERE len(terms) > 0),
scored AS (
  SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN spread USING (r) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
WHERE rank <= 10""",
}
