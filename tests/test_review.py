"""Triage, routing, deduplication, reports, landed JSON."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from changelens.functions.text import duration_text, hmac_sha256
from changelens.operators import deps, findings, remedies, scoring
from changelens.plans import review
from changelens.sources import landed
from tests.test_rules import diff_of

RISKY = diff_of("password = 'x'\nsecret = 1\ntoken = 2\nexec(code)\neval(x)\nsubprocess.run(c)\npickle.loads(d)")
PR = "pr_id string, repo_full_name string, pr_number int, head_branch string, files_changed int, additions int, deletions int, diff string"


@pytest.fixture(scope="module")
def changes(spark):
    return spark.createDataFrame([
        ("small", "owner/repo", 1, "fix/typo", 2, 15, 5, diff_of("a\nb")), ("risky", "owner/repo", 2, "refactor/auth", 15, 600, 200, RISKY)], PR)


def test_triage_and_routing(changes):
    rows = {r.pr_id: r for r in scoring.route(scoring.with_risk(changes)).collect()}
    assert rows["small"].risk_score == 0.10 and rows["small"].agents == ["static_analysis"]
    assert rows["risky"].risk_score == 0.90 and rows["risky"].agents[1:3] == ["security_audit", "dependency"]
    capped = scoring.route(scoring.with_risk(changes), max_steps=3).filter("pr_id = 'risky'").first()
    assert capped.agents == ["static_analysis", "security_audit"]


def test_review_and_report(changes):
    final = review.review(changes)
    keys = final.groupBy("pr_id", "file_path", "line_start", F.substring("title", 1, 50)).count()
    assert final.count() == 4 and keys.filter("count > 1").count() == 0
    enriched = final.filter("title = 'Dangerous eval() usage'").first()
    assert "ast.literal_eval" in enriched.suggestion and enriched.patch.startswith("--- a/vulnerable_code")
    parts = review.reports(changes).orderBy("pr_id", "part").collect()
    reports = {p: "\n".join(r.report for r in parts if r.pr_id == p) for p in {r.pr_id for r in parts}}
    assert reports["risky"].startswith("# Code Review Report: owner/repo PR #2") and "### [HIGH]" in reports["risky"]
    assert "**Total Findings:** 0" in reports["small"]


def test_dedup_is_idempotent(changes):
    raw = review.raw_findings(changes).unionByName(review.raw_findings(changes))
    once = findings.first_wins(raw, findings.orchestrator_key(), ["emit_seq", "title"])
    assert findings.first_wins(once, findings.orchestrator_key(), ["emit_seq", "title"]).count() == once.count() < raw.count()


def test_hot_key_is_limited_before_the_shuffle(spark):
    rows = spark.range(100_000).select(F.concat(F.lit("hot"), F.floor(F.col("id") / 10**6).cast("string")).alias("pr_id"),
        F.lit("a.py").alias("file_path"), F.lit(1).alias("line_start"), F.lit("T").alias("title"), F.col("id").alias("emit_seq"))
    first = findings.first_wins(rows, findings.orchestrator_key(), ["emit_seq"])
    assert [r.emit_seq for r in first.collect()] == [0]
    assert "WindowGroupLimit" in first._jdf.queryExecution().executedPlan().toString()


def test_long_reports_come_in_parts(spark, changes):
    scored = scoring.with_risk(changes).select("pr_id", "repo_full_name", "pr_number", "score_pts", "risk_score")
    many = spark.range(300).select(
        F.lit("risky").alias("pr_id"), F.col("id").alias("emit_seq"), F.concat(F.lit("T"), F.col("id").cast("string")).alias("title"), F.lit("high").alias("severity"), F.lit("d").alias("description"),
        F.lit("f").alias("file_path"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), F.lit(None).cast("string").alias("suggestion"), F.lit("security_audit").alias("agent_type"))
    parts = findings.review_reports(scored, many, findings.agent_counts(many)).filter("pr_id = 'risky'").orderBy("part").collect()
    assert [p.part for p in parts] == list(range(301)) and "# Code Review Report" in parts[0].report
    assert parts[300].report.startswith("\n### [HIGH] T299\n")
    comments = findings.inline_comments(many).orderBy("comment_no").collect()
    assert len(comments) == 300 and [c.review_no for c in comments] == [i // 50 for i in range(300)]


def test_titles_are_compared_whole_unless_cut(spark):
    rows = spark.createDataFrame([("p", "f", 1, "t" * 60 + c, i) for i, c in enumerate("abA")], "pr_id string, file_path string, line_start int, title string, emit_seq int")
    kept = lambda key: sorted(r.emit_seq for r in findings.first_wins(rows, key, ["emit_seq"]).collect())
    assert kept(findings.orchestrator_key()) == [0, 1, 2] and kept(findings.orchestrator_key(50)) == [0]
    assert kept(findings.service_key()) == [0, 1] and kept(findings.service_key(title_length=40)) == [0]
    assert findings.storable(rows.withColumn("description", F.lit("d"))).first().title == "t" * 60 + "a"


def test_judge_replies_fall_back(spark):
    rows = spark.createDataFrame([("{\"accuracy\": 1.0}", 0.5), ("{oops}", 0.5), ("none", 0.5), (None, 0.5)], "reply string, confidence_score double")
    got = [(r.method, r.quality_score) for r in scoring.judged_evaluation(rows).collect()]
    assert got == [("llm_judge", 0.82)] + [("heuristic", 0.4)] * 3


def test_null_keys_group_together(spark):
    rows = spark.createDataFrame([("p", None, None, "t", 2), ("p", None, None, "t", 1), ("p", "f", None, "t", 3)], "pr_id string, file_path string, line_start int, title string, emit_seq int")
    assert sorted(r.emit_seq for r in findings.first_wins(rows, findings.orchestrator_key(), ["emit_seq"]).collect()) == [1, 3]


@pytest.mark.parametrize("secret", ["s", "a-longer-secret", "k" * 100])
def test_hmac(spark, secret):
    body = b'{"a": "\xc3\xa9"}'
    got = spark.createDataFrame([(bytearray(body),)], "raw binary").select(hmac_sha256(secret, F.col("raw"))).first()[0]
    assert got == hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()


def test_signature_cases(spark):
    body = b"{}"
    good = "sha256=" + hmac.new(b"k", body, hashlib.sha256).hexdigest()
    rows = spark.createDataFrame([(s, bytearray(b)) for s, b in (
        (good, body), (good[7:], body), ("sha256=00", body), ("", body), (None, body), (good, b"{ }"))], "signature string, raw binary")
    ok, bad = landed.quarantine(rows, "k")
    assert ok.count() == 1 and bad.count() == 5 and landed.quarantine(rows, "other")[0].count() == 0


def test_dispositions(spark):
    rows = spark.createDataFrame([
        ("ping", None, None, None), ("pull_request", "opened", "o/r", 1), ("pull_request", "closed", "o/r", 1), ("push", None, "o/r", None), ("pull_request", "opened", "o/r", None)],
        "e string, a string, r string, n int")
    got = [r[0] for r in rows.select(landed.disposition(F.col("e"), F.col("a"), F.col("r"), F.col("n"))).collect()]
    assert got == ["pong", "accepted", "ignored_closed", "ignored", "invalid"]


def test_manifest_quirks(spark):
    lines = {"requirements.txt": ["a==1.2", "b>=0.1,<2", "c~=1.0"], "package.json": ['"version": "1.0"', '"d": "^2.1.0",'], "go.mod": ["require e.org/f v1.2.3", "\tg.org/h v1.0.0"],
             "Pipfile": ['i = "*"', "j = '==1.0'"]}
    rows = spark.createDataFrame([(p, diff_of("\n".join(ls), p)) for p, ls in lines.items()], "pr_id string, diff string")
    got = {(r.name, r.version, r.ecosystem) for r in deps.manifest_dependencies(rows).collect()}
    assert got == {("a", "1.2", "PyPI"), ("b", "0.1", "PyPI"), ("version", "1.0", "npm"), ("d", "2.1.0", "npm"), ("e.org/f", "1.2.3", "Go"), ("i", "latest", "PyPI"), ("j", "==1.0", "PyPI")}


def test_version_ranges(spark):
    have = spark.createDataFrame([("PyPI", "p", v, 1) for v in ("1.2", "1.10", "2.0", "1.9.9")], "ecosystem string, name string, version string, uses int")
    ranges = spark.createDataFrame([("PyPI", "p", "1.9", "2.0", "x")], "ecosystem string, name string, introduced string, fixed string, id string")
    assert {r.version for r in deps.affected_dependencies(have, ranges).collect()} == {"1.10", "1.9.9"}


def test_numeric_severity(spark):
    rows = spark.sql("SELECT array(named_struct('type', 'CVSS_V3', 'score', s)) AS e FROM VALUES ('9.8'), ('1.9'), ('CVSS:3.1/AV:N') t(s)")
    got = [tuple(r) for r in rows.select(deps.advisory_severity(F.col("e")), deps.numeric_severity(F.col("e"))).collect()]
    assert got == [("critical", "critical"), ("critical", "low"), ("low", "unknown")]


def test_reviewer_note(spark):
    row = spark.createDataFrame([("t", "d", 0.5, False, "say more")], "title string, description string, quality_score double, is_likely_false_positive boolean, suggested_revision string")
    assert scoring.reflect(row).first().description == "d\n\n**Reviewer Note:** say more"


def test_duration_text(spark):
    rows = spark.createDataFrame([(None,), (5.25,), (59.9,), (75.0,), (3600.0,)], "s double").select(duration_text(F.col("s"))).collect()
    assert [r[0] for r in rows] == ["--", "5.3s", "59.9s", "1m 15s", "60m 0s"]


def test_unified_diff_counts():
    assert remedies.unified_diff("a", "b\nc") == "--- a/vulnerable_code\n+++ b/fixed_code\n@@ -1,1 +1,2 @@\n-a\n+b\n+c"
