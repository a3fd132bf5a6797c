"""Scores over changes and findings: risk, routing, quality, evaluation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.functions.text import contains_any, count_contained, let, once

# ---------------------------------------------------------------------------
# Triage words, thresholds and quality word lists.
# ---------------------------------------------------------------------------
RISK_WORDS = (
    "password", "secret", "token", "api_key", "auth", "crypto",
    "encrypt", "decrypt", "sql", "exec(", "eval(", "subprocess",
    "os.system", "pickle", "deserializ", "jwt", "oauth", "pem",
    "private_key", "chmod", "sudo", "root", "admin",
)
RISK_PATHS = ("auth", "security", "crypto", "payment", "billing", "admin", "config")
LOW_RISK_POINTS = 30
MAX_STEPS = 10
AGENTS_IN_ORDER = ("static_analysis", "security_audit", "dependency", "compliance", "remediation", "reflection")
TEST_PATHS = ("test_", "_test", "spec_", "_spec", "/tests/", "/test/")
EXAMPLE_PATHS = ("example", "sample", "demo", "fixture")
CREDENTIAL_WORDS = ("password", "secret", "api_key", "token")


def risk_points(changes: DataFrame, path_chars: int | None = None) -> Column:
    """Triage score in hundredths, so no sum drifts across a threshold (Q1).

    Sensitive places are looked for in the branch name and in the paths of all files of the diff; ``path_chars``
    looks at so many leading characters of the diff instead.
    """
    size = F.coalesce(F.col("additions"), F.lit(0)) + F.coalesce(F.col("deletions"), F.lit(0))
    files = F.coalesce(F.col("files_changed"), F.lit(0))
    hits = let(F.lower("diff"), lambda low: count_contained(low, RISK_WORDS))
    # lower-casing may change the length, so it comes after the cut
    places = F.array_join(F.regexp_extract_all("diff", F.lit(r"(?m)^diff --git (.*)$"), F.lit(1)), "\n") if path_chars is None else F.substring("diff", 1, path_chars)
    where = F.lower(F.concat_ws("\n" if path_chars is None else "", F.coalesce("head_branch", F.lit("")), places))
    word_points = let(hits, lambda h: F.when(h > 5, 30).when(h > 2, 20).when(h > 0, 10).otherwise(0))
    points = (
        F.when(size > 500, 30).when(size > 200, 20).when(size > 50, 10).otherwise(5)
        + F.when(files > 20, 20).when(files > 10, 10).otherwise(5)
        + word_points
        + let(where, lambda w: F.when(contains_any(w, RISK_PATHS), 20).otherwise(0))
    )
    return F.least(F.lit(100), points)


def with_risk(changes: DataFrame, path_chars: int | None = None) -> DataFrame:
    """Risk points and score of each change; the diff stays for the scan."""
    return once(changes, score_pts=risk_points(changes, path_chars)).withColumn("risk_score", F.col("score_pts") / 100)


def route(scored: DataFrame, max_steps: int = MAX_STEPS) -> DataFrame:
    """Agents to run for each change, in order, within the step cap (Q2)."""
    agents = F.array(*[F.lit(a) for a in AGENTS_IN_ORDER])
    depth = F.when(F.col("score_pts") < LOW_RISK_POINTS, 1).otherwise(len(AGENTS_IN_ORDER))
    # triage is the first step
    return scored.withColumn("agents", F.slice(agents, 1, F.least(depth, F.lit(max(0, max_steps - 1)))))


def is_confident(threshold: float = 0.4) -> Column:
    return F.coalesce("confidence_score", F.lit(0.8)) >= threshold


def confident(findings: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Drop findings whose confidence (0.8 when absent) is below the threshold (Q4)."""
    return findings.filter(is_confident(threshold))


def quality_score(findings: DataFrame) -> DataFrame:
    """Heuristic quality: score, false-positive flag and the last reason that applied (Q5)."""
    text = lambda name: F.lower(F.coalesce(F.col(name), F.lit("")))
    in_test = contains_any(text("file_path"), TEST_PATHS)
    in_example = contains_any(text("file_path"), EXAMPLE_PATHS)
    credential = contains_any(text("code_snippet"), CREDENTIAL_WORDS) & text("description").contains("hardcoded")
    vague = text("description").contains("may") & text("description").contains("possibly")
    base = F.coalesce(F.col("confidence_score"), F.lit(0.8))
    s1 = F.when(in_test, base * 0.5).otherwise(base)
    s2 = F.when(in_example, s1 * 0.6).otherwise(s1)
    s3 = F.when(credential, F.least(F.lit(1.0), s2 * 1.2)).otherwise(s2)
    s4 = F.when(vague, s3 * 0.7).otherwise(s3)
    return findings.withColumns({
        "quality_score": F.round(s4, 3),
        "is_likely_false_positive": in_test & (s1 < 0.5),
        "reasoning": F.when(vague, "Uncertain language in description reduces confidence")
        .when(credential, "High confidence: hardcoded credential pattern")
        .when(in_example, "Finding in example/sample file")
        .when(in_test, "Finding in test file - may be intentional test code")
        .otherwise("Heuristic evaluation"),
    })


def _rejected(threshold: float) -> Column:
    return F.col("is_likely_false_positive") | (F.col("quality_score") < threshold)


def reflect(scored: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Keep findings that pass the quality filter and note suggested revisions (Q6)."""
    kept = scored.filter(~_rejected(threshold)).withColumn("confidence_score", F.col("quality_score"))
    if "suggested_revision" in scored.columns:
        revised = (F.coalesce("suggested_revision", F.lit("")) != "") & (F.col("quality_score") < 0.7)
        note = F.concat(F.coalesce("description", F.lit("")), F.lit("\n\n**Reviewer Note:** "), F.col("suggested_revision"))
        kept = kept.withColumn("description", F.when(revised, note).otherwise(F.col("description")))
    return kept


def reflection_rates(scored: DataFrame, *keys: str, threshold: float = 0.4) -> DataFrame:
    """Findings, rejected findings and the false-positive rate (Q6)."""
    rejected = F.count_if(_rejected(threshold))
    return scored.groupBy(*keys).agg(
        F.count("*").alias("original_count"), rejected.alias("filtered_count"),
        F.round(F.coalesce(F.try_divide(rejected, F.count("*")), F.lit(0.0)), 4).alias("false_positive_rate"))


def heuristic_evaluation(findings: DataFrame) -> DataFrame:
    """Quality without a judge (Q7)."""
    given = lambda name: F.coalesce(F.col(name), F.lit("")) != ""
    score = F.coalesce(F.col("confidence_score"), F.lit(0.7))
    for test in (given("cwe_id"), given("code_snippet"), F.coalesce(F.length("suggestion"), F.lit(0)) > 50):
        score = F.when(test, F.least(F.lit(1.0), score + 0.05)).otherwise(score)
    score = F.when(F.coalesce(F.length("description"), F.lit(0)) < 50, score * 0.8).otherwise(score)
    return findings.withColumns({
        "quality_score": F.round(score, 3),
        "false_positive_likelihood": F.round(1 - score, 3),
        "method": F.lit("heuristic"),
    })


_JUDGED = "accuracy double, severity_appropriate double, actionability double, fp_likelihood double"


def judged_evaluation(replies: DataFrame, text: str = "reply") -> DataFrame:
    """Combined score from stored judge replies (Q8).

    A reply is used if the text from its first to its last brace is a JSON object.  Any other (none, null, malformed)
    leaves its finding to the heuristic of Q7, over whichever of its columns the rows have.
    """
    wanted = {"confidence_score": "double", "cwe_id": "string", "code_snippet": "string", "suggestion": "string", "description": "string"}
    added = {c: F.lit(None).cast(t) for c, t in wanted.items() if c not in replies.columns}
    plain = heuristic_evaluation(replies.withColumns(added)).withColumnsRenamed(
        {"quality_score": "_quality", "false_positive_likelihood": "_likelihood"}).drop("method", *added)
    found = once(plain, _json=F.regexp_extract(text, r"(?s)\{.*\}", 0))
    judged = F.col("_is_judged")
    body = F.col("_body")
    part = lambda name: F.coalesce(body[name], F.lit(0.7))
    overall = part("accuracy") * 0.4 + part("severity_appropriate") * 0.2 + part("actionability") * 0.4
    return once(found, _body=F.from_json("_json", _JUDGED), _is_judged=F.try_parse_json("_json").isNotNull()).withColumns({
        "quality_score": F.when(judged, F.round(overall, 3)).otherwise(F.col("_quality")),
        "false_positive_likelihood": F.when(judged, F.coalesce(body["fp_likelihood"], F.lit(0.2))).otherwise(F.col("_likelihood")),
        "method": F.when(judged, "llm_judge").otherwise("heuristic"),
    }).drop("_json", "_body", "_is_judged", "_quality", "_likelihood")


def user_scored(findings: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], inputs: Sequence[str], name: str = "quality_score") -> DataFrame:
    """Findings with a score of the user's own (P3): ``scorer`` gets batches of the named columns and returns one number per row."""
    def scores(rows: pd.DataFrame) -> pd.Series:
        return scorer(rows).astype("float64")

    return findings.withColumn(name, F.pandas_udf(scores, "double")(F.struct(*inputs)))
