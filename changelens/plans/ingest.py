"""Registered queries: landed JSON, signatures, transcripts, stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from changelens import schemas
from changelens.functions.text import hmac_sha256
from changelens.operators import findings as L
from changelens.plans.sqlbase import CTES, query
from changelens.session import work_dir
from changelens.sources import landed as S
from changelens.sources import views as V

QUERIES, ORACLES = {}, {}
SECRET = "webhook-test-secret"


def _docs(spark, sf):
    return V.table(spark, sf, "documents")


# --------------------------------------------------------------------------- webhooks
def webhooks(spark, sf):
    """Raw webhook bodies, one per event."""
    i, u = F.col("event_id"), F.col("user_id")
    body = F.to_json(F.struct(
        F.when(F.col("event_type") == "error", "closed").when(F.col("event_type") == "signup", "labeled").otherwise("opened").alias("action"),
        F.struct(
            F.when(i % 17 != 0, u).alias("number"), F.concat(F.lit("Title "), i.cast("string")).alias("title"),
            F.struct(F.concat(F.lit("dev"), (i % 9).cast("string")).alias("login")).alias("user"), F.struct(F.lit("main").alias("ref")).alias("base"),
            F.struct(F.concat(F.lit("topic/"), (i % 31).cast("string")).alias("ref")).alias("head"),
            F.when(i % 4 != 0, i % 40).alias("changed_files"), F.when(i % 3 != 0, i % 500).alias("additions")).alias("pull_request"),
        F.struct(F.concat(F.lit("org/repo"), (u % 5).cast("string")).alias("full_name")).alias("repository")))
    return V.table(spark, sf, "events").select(
        "event_id", F.when(i % 19 == 0, "ping").when(i % 23 == 0, "push").otherwise("pull_request").alias("event"), body.alias("body"))


CTES["webhook_rows"] = """
SELECT event_id, CASE WHEN event_id % 19 = 0 THEN 'ping' WHEN event_id % 23 = 0 THEN 'push' ELSE 'pull_request' END AS event_type,
  CASE event_type WHEN 'error' THEN 'closed' WHEN 'signup' THEN 'labeled' ELSE 'opened' END AS action,
  CASE WHEN event_id % 17 <> 0 THEN user_id END AS pr_number, 'Title ' || event_id AS pr_title, 'dev' || (event_id % 9) AS pr_author, 'main' AS base_branch,
  'topic/' || (event_id % 31) AS head_branch, 'org/repo' || (user_id % 5) AS repo_full_name, CASE WHEN event_id % 4 <> 0 THEN event_id % 40 ELSE 0 END AS files_changed,
  CASE WHEN event_id % 3 <> 0 THEN event_id % 500 ELSE 0 END AS additions, 0::BIGINT AS deletions FROM events"""
QUERIES["s3_webhook_flattening"] = lambda spark, sf: S.flatten_webhook(webhooks(spark, sf)).select(
    "event_id", "event_type", "action", F.coalesce("pr_number", F.lit(-1)).cast("bigint").alias("pr_number"), "pr_title", "pr_author", "base_branch", "head_branch",
    "repo_full_name", F.col("files_changed").cast("bigint"), F.col("additions").cast("bigint"), F.col("deletions").cast("bigint"))
ORACLES["s3_webhook_flattening"] = query("""
SELECT event_id, event_type, action, coalesce(pr_number, -1) AS pr_number, pr_title, pr_author, base_branch, head_branch, repo_full_name, files_changed, additions, deletions
FROM webhook_rows""")


def _dispositions(spark, sf):
    flat = S.flatten_webhook(webhooks(spark, sf))
    kind = S.disposition(F.col("event_type"), F.col("action"), F.col("repo_full_name"), F.col("pr_number"))
    return flat.select(kind.alias("disposition"), "repo_full_name").groupBy("disposition", "repo_full_name").agg(F.count("*").alias("events"))


QUERIES["f10_event_disposition"] = _dispositions
ORACLES["f10_event_disposition"] = query("""
SELECT CASE WHEN event_type = 'pull_request' AND action = 'opened' THEN CASE WHEN coalesce(pr_number, 0) <> 0 THEN 'accepted' ELSE 'invalid' END
  WHEN event_type = 'pull_request' AND action = 'closed' THEN 'ignored_closed' WHEN event_type = 'ping' THEN 'pong' ELSE 'ignored' END AS disposition,
  repo_full_name, count(*) AS events FROM webhook_rows GROUP BY ALL""")


def signed_bodies(spark, sf):
    d, raw = F.col("doc_id"), F.encode("text", "UTF-8")
    return _docs(spark, sf).select(
        "doc_id", raw.alias("raw"),
        F.when(d % 5 == 1, "sha256=0000").when(d % 5 == 2, F.lit(None)).when(d % 5 == 3, hmac_sha256(SECRET, raw))
        .otherwise(F.concat(F.lit("sha256="), hmac_sha256(SECRET, raw))).alias("signature"))


def _signatures(spark, sf):
    good, bad = S.quarantine(signed_bodies(spark, sf), SECRET)
    mark = lambda df, valid: df.select("doc_id", F.lit(valid).alias("valid"), hmac_sha256(SECRET, F.col("raw")).alias("hmac"))
    return mark(good, True).unionByName(mark(bad, False))


QUERIES["f11_signature_quarantine"] = _signatures
_KEY = SECRET.encode().ljust(64, b"\0")
_IPAD, _OPAD = bytes(b ^ 0x36 for b in _KEY).hex(), bytes(b ^ 0x5C for b in _KEY).hex()
ORACLES["f11_signature_quarantine"] = query(f"""
SELECT doc_id, doc_id % 5 IN (0, 4) AS valid, sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode(text)))) AS hmac FROM documents""")

# --------------------------------------------------------------------------- API pages and files


def file_pages(spark, sf):
    """File-list pages: the files of a page are the lines of a document."""
    files = F.transform(F.split("text", "\n"), lambda l, i: F.struct(
        F.concat(F.lit("src/"), i.cast("string"), F.lit(".py")).alias("filename"), F.when(i % 3 == 0, "added").otherwise("modified").alias("status"),
        F.when(i % 2 == 0, F.length(l)).alias("additions"), (i % 5).alias("deletions"), F.when(i % 4 != 1, l).alias("patch")))
    return _docs(spark, sf).select("doc_id", F.to_json(files).alias("page"))


QUERIES["s6_landed_file_pages"] = lambda spark, sf: S.page_files(file_pages(spark, sf)).select(
    "doc_id", "filename", "status", F.col("additions").cast("bigint"), F.col("deletions").cast("bigint"), F.col("changes").cast("bigint"), F.md5("patch").alias("patch_md5"), "blob_url")
CTES["page_lines"] = """
SELECT doc_id, generate_subscripts(ls, 1) - 1 AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)"""
ORACLES["s6_landed_file_pages"] = query("""
SELECT doc_id, 'src/' || i || '.py' AS filename, CASE WHEN i % 3 = 0 THEN 'added' ELSE 'modified' END AS status, CASE WHEN i % 2 = 0 THEN length(line) ELSE 0 END AS additions,
  i % 5 AS deletions, 0::BIGINT AS changes, md5(CASE WHEN i % 4 <> 1 THEN line ELSE '' END) AS patch_md5, '' AS blob_url FROM page_lines""")


def _metadata(spark, sf):
    o = F.col("o_orderkey")
    ref = lambda name, value: F.struct(value.alias("ref")).alias(name)
    text = F.to_json(F.struct(
        o.alias("number"), F.concat(F.lit("Order "), o.cast("string")).alias("title"), F.when(o % 3 != 0, F.col("o_orderpriority")).alias("body"),
        F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("state"), F.struct(F.concat(F.lit("dev"), F.col("o_custkey").cast("string")).alias("login")).alias("user"),
        ref("base", F.lit("main")), F.struct(F.concat(F.lit("t/"), (o % 9).cast("string")).alias("ref"), F.sha1(o.cast("string")).alias("sha")).alias("head"),
        F.when(o % 2 == 0, o % 40).alias("changed_files"), (o % 77).alias("additions")))
    return S.pr_metadata(V.table(spark, sf, "orders").select(text.alias("text")))


QUERIES["s7_landed_pr_metadata"] = lambda spark, sf: _metadata(spark, sf).select(
    F.col("number").cast("bigint"), "title", "body", "state", "author", "base_branch", "head_branch", "head_sha", F.col("files_changed").cast("bigint"),
    F.col("additions").cast("bigint"), F.col("deletions").cast("bigint"))
ORACLES["s7_landed_pr_metadata"] = query("""
SELECT o_orderkey AS number, 'Order ' || o_orderkey AS title, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority ELSE '' END AS body,
  CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS state, 'dev' || o_custkey AS author, 'main' AS base_branch, 't/' || (o_orderkey % 9) AS head_branch,
  sha1(o_orderkey::VARCHAR) AS head_sha, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 40 ELSE 0 END AS files_changed, o_orderkey % 77 AS additions, 0::BIGINT AS deletions FROM orders""")


def _decoded(spark, sf):
    d = F.col("doc_id")
    raw = F.when(d % 7 == 0, F.concat(F.unhex(F.lit("FF")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    return _docs(spark, sf).select("doc_id", F.when(d % 5 == 0, "none").otherwise("base64").alias("encoding"), F.base64(raw).alias("content")).select(
        "doc_id", F.md5(S.file_text(F.col("encoding"), F.col("content"))).alias("text_md5"))


QUERIES["s8_base64_contents"] = _decoded
ORACLES["s8_base64_contents"] = query("""
SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN md5(CASE WHEN doc_id % 7 = 0 THEN chr(65533) ELSE '' END || text) END AS text_md5 FROM documents""")


def scanner_reports(spark, sf):
    """Scanner reports: the results of a report are the lines of a document."""
    names = F.array(*[F.lit(x) for x in ("ERROR", "warning", "INFO", "CRITICAL", "odd")])
    result = lambda l, i: F.struct(
        F.concat(F.lit("check-"), (i % 4).cast("string")).alias("check_id"), F.concat(F.lit("src/"), i.cast("string")).alias("path"),
        F.struct((i + 1).alias("line")).alias("start"), F.struct((i + 2).alias("line")).alias("end"),
        F.struct(
            F.element_at(names, i % 5 + 1).alias("severity"), F.when(i % 6 != 0, F.concat(F.lit("message "), i.cast("string"))).alias("message"), l.alias("lines"),
            F.struct(
                F.when(i % 7 == 0, "HIGH").alias("severity"), F.when(i % 3 == 0, "high").when(i % 3 == 1, "LOW").alias("confidence"),
                F.when(i % 2 == 0, F.array(F.lit("CWE-1"), F.lit("CWE-2"))).alias("cwe"), F.when(i % 4 == 0, F.array(F.lit("A01"), F.lit("A02"))).alias("owasp"),
                F.when(i % 5 == 0, F.array(F.lit("https://ref"))).alias("references")).alias("metadata")).alias("extra"))
    report = F.to_json(F.struct(F.transform(F.split("text", "\n"), result).alias("results")))
    # half of the reports give the weakness as a text instead of a list
    text_cwe = F.regexp_replace(report, r'"cwe":\["CWE-1","CWE-2"\]', '"cwe":"CWE-1"')
    return _docs(spark, sf).select("doc_id", F.when(F.col("doc_id") % 2 == 0, report).otherwise(text_cwe).alias("report"))


QUERIES["s9_scanner_reports"] = lambda spark, sf: S.report_findings(scanner_reports(spark, sf)).select(
    "doc_id", "rule_id", "severity", "title", "description", "file_path", F.col("line_start").cast("bigint"), F.col("line_end").cast("bigint"), F.md5("code_snippet").alias("code_md5"),
    "suggestion", "confidence_score", "cwe_id", "owasp_category")
ORACLES["s9_scanner_reports"] = query("""
SELECT doc_id, 'check-' || (i % 4) AS rule_id, CASE WHEN i % 7 = 0 THEN 'high' ELSE ['high', 'medium', 'info', 'critical', 'medium'][i % 5 + 1] END AS severity,
  CASE WHEN i % 6 <> 0 THEN 'message ' || i ELSE 'Semgrep finding' END AS title,
  CASE WHEN i % 6 <> 0 THEN 'message ' || i ELSE '' END || CASE WHEN i % 5 = 0 THEN chr(10) || chr(10) || 'Reference: https://ref' ELSE '' END AS description,
  'src/' || i AS file_path, i + 1 AS line_start, i + 2 AS line_end, md5(line) AS code_md5, 'See Semgrep rule for remediation' AS suggestion,
  CASE i % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.5 ELSE 0.7 END::DOUBLE AS confidence_score, CASE WHEN i % 2 = 0 THEN 'CWE-1' END AS cwe_id, CASE WHEN i % 4 = 0 THEN 'A01' END AS owasp_category
FROM page_lines""")


def transcripts(spark, sf):
    """Assistant turns with one good, one multi-line and one broken finding appended."""
    c, t = F.col("conv_id"), F.col("turn")
    good = F.to_json(F.struct(
        F.when(c % 2 == 0, "high").otherwise("low").alias("severity"), F.concat(F.lit("Issue "), t.cast("string")).alias("title"),
        F.when(c % 3 == 0, "security").alias("category"), F.when(c % 4 == 0, (t % 10) / 10).alias("confidence_score"), t.alias("line_start"), (t + 2).alias("line_end"),
        F.when(c % 5 == 0, "x = 1").alias("code_snippet"), F.when(c % 6 == 0, "A03").alias("owasp_category"), F.when(c % 7 == 0, "rule-9").alias("rule_id"), F.when(t % 4 == 1, "+y").alias("patch")))
    return V.table(spark, sf, "conversations").filter("role = 'assistant'").select(
        "conv_id", "turn", F.concat("text", F.lit("\nFirst "), good, F.lit(' then {\n "severity":\n "info"\n} and {"severity": oops} end')).alias("text"))


QUERIES["s10_transcript_findings"] = lambda spark, sf: S.transcript_findings(transcripts(spark, sf), "text", "static_analysis").select(
    "conv_id", "turn", F.col("position").cast("bigint"), "severity", "category", "title", F.coalesce("line_start", F.lit(-1)).cast("bigint").alias("line_start"), "confidence_score",
    F.coalesce("line_end", F.lit(-1)).cast("bigint").alias("line_end"), "code_snippet", "owasp_category", "rule_id", "patch")
ORACLES["s10_transcript_findings"] = query("""
SELECT conv_id, turn, 0::BIGINT AS position, CASE WHEN conv_id % 2 = 0 THEN 'high' ELSE 'low' END AS severity, CASE WHEN conv_id % 3 = 0 THEN 'security' ELSE 'static_analysis' END AS category,
  'Issue ' || turn AS title, turn AS line_start, CASE WHEN conv_id % 4 = 0 THEN (turn % 10) / 10.0::DOUBLE ELSE 0.8::DOUBLE END AS confidence_score,
  turn + 2 AS line_end, CASE WHEN conv_id % 5 = 0 THEN 'x = 1' END AS code_snippet, CASE WHEN conv_id % 6 = 0 THEN 'A03' END AS owasp_category,
  CASE WHEN conv_id % 7 = 0 THEN 'rule-9' END AS rule_id, CASE WHEN turn % 4 = 1 THEN '+y' END AS patch FROM conversations WHERE role = 'assistant'
UNION ALL SELECT conv_id, turn, 1, 'info', 'static_analysis', NULL, -1, 0.8::DOUBLE, -1, NULL, NULL, NULL, NULL FROM conversations WHERE role = 'assistant'""")

# --------------------------------------------------------------------------- published events, stored tables


def _published(spark, sf):
    flat = S.flatten_webhook(webhooks(spark, sf)).filter("event_type = 'pull_request'").select(
        "event_type", "action", "pr_number", "pr_title", "repo_full_name", "files_changed", "additions", "deletions", "event_id")
    return S.event_record(flat.drop("event_id"), F.lit("2024-01-01T00:00:00+00:00"))


QUERIES["s2_published_events"] = _published
ORACLES["s2_published_events"] = query("""
SELECT repo_full_name || ':' || coalesce(pr_number, 0) AS key, json_object('event_type', event_type, 'action', action, 'pr_number', pr_number, 'pr_title', pr_title, 'repo_full_name',
  repo_full_name, 'files_changed', files_changed, 'additions', additions, 'deletions', deletions, 'published_at', '2024-01-01T00:00:00+00:00', 'schema_version', '1.0')::VARCHAR AS value
FROM webhook_rows WHERE event_type = 'pull_request'""")


def _round_trip(spark, sf):
    """Append findings to a table partitioned by month, read it back under the declared schema."""
    path = work_dir(spark, "findings-table")
    rows = V.finding_facts(spark, sf).withColumn("id", F.col("finding_id"))
    L.append_findings(schemas.conform(rows, schemas.FINDINGS), path, unit="month")
    stored = schemas.read_table(spark, path, schemas.FINDINGS)
    return stored.groupBy("severity", "category").agg(F.count("*").alias("findings"), F.count("file_path").alias("with_path"))


QUERIES["s4_stored_tables"] = _round_trip
ORACLES["s4_stored_tables"] = query("""
SELECT severity, category, count(*) AS findings, count(file_path) AS with_path FROM finding_facts GROUP BY ALL""")
