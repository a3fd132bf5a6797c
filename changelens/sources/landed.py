"""Landed JSON and text: webhook bodies, API pages, scanner reports, transcripts.

Texts arrive as rows of a table or files on storage; nothing here calls out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.functions.text import hmac_sha256, lookup, once

# ---------------------------------------------------------------------------
# Severity and confidence names of scanner reports.
# ---------------------------------------------------------------------------
REPORT_SEVERITIES = {"ERROR": "high", "WARNING": "medium", "INFO": "info", "CRITICAL": "critical"}
REVIEWED_ACTIONS = ("opened", "synchronize", "reopened")

_WEBHOOK = (
    "action string, pull_request struct<number: string, title: string, user: struct<login: string>, base: struct<ref: string>, "
    "head: struct<ref: string>, diff_url: string, html_url: string, body: string, changed_files: string, additions: string, deletions: string>, "
    "repository struct<full_name: string>"
)


def _whole(value: Column) -> Column:
    return value.try_cast("int")


def flatten_webhook(bodies: DataFrame, body: str = "body", event: str = "event") -> DataFrame:
    """Nested webhook payload to the flat columns of an event; absent counts are 0 (S3)."""
    keep = [c for c in bodies.columns if c not in (body, event)]
    p = F.from_json(body, _WEBHOOK)
    rows = once(bodies.select(*keep, F.col(event).alias("event_type"), body), p=p)
    pr = F.col("p.pull_request")
    return rows.select(
        *keep, "event_type", F.col("p.action").alias("action"), _whole(pr["number"]).alias("pr_number"), pr["title"].alias("pr_title"),
        pr["user"]["login"].alias("pr_author"), pr["base"]["ref"].alias("base_branch"), pr["head"]["ref"].alias("head_branch"),
        pr["diff_url"].alias("diff_url"), pr["html_url"].alias("html_url"), pr["body"].alias("body"),
        F.col("p.repository.full_name").alias("repo_full_name"),
        *[F.coalesce(_whole(pr[c]), F.lit(0)).alias(n) for c, n in (("changed_files", "files_changed"), ("additions", "additions"), ("deletions", "deletions"))],
    )


def disposition(event_type: Column, action: Column, repo: Column, number: Column) -> Column:
    """accepted, invalid, ignored_closed, pong or ignored."""
    pull = event_type == "pull_request"
    known = (F.coalesce(repo, F.lit("")) != "") & (F.coalesce(number, F.lit(0)) != 0)
    return (
        F.when(pull & action.isin(*REVIEWED_ACTIONS), F.when(known, "accepted").otherwise("invalid"))
        .when(pull & (action == "closed"), "ignored_closed").when(event_type == "ping", "pong").otherwise("ignored")
    )


def signature_valid(header: Column, body: Column, secret: str) -> Column:
    """True iff the header is ``sha256=`` and the HMAC of the raw body."""
    return F.coalesce(header == F.concat(F.lit("sha256="), hmac_sha256(secret, body)), F.lit(False))


def quarantine(bodies: DataFrame, secret: str, header: str = "signature", body: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Bodies with a valid signature, and the others."""
    checked = bodies.withColumn("_valid", signature_valid(F.col(header), F.col(body), secret))
    return checked.filter("_valid").drop("_valid"), checked.filter("NOT _valid").drop("_valid")


_FILE = "array<struct<filename: string, status: string, additions: int, deletions: int, changes: int, patch: string, blob_url: string, raw_url: string>>"


def page_files(pages: DataFrame, page: str = "page") -> DataFrame:
    """One row per file of landed file-list pages, absent values defaulted."""
    keep = [c for c in pages.columns if c != page]
    rows = pages.select(*keep, F.explode(F.from_json(page, _FILE)).alias("f"))
    return rows.select(
        *keep, "f.filename", "f.status",
        *[F.coalesce(f"f.{c}", F.lit(0)).alias(c) for c in ("additions", "deletions", "changes")],
        *[F.coalesce(f"f.{c}", F.lit("")).alias(c) for c in ("patch", "blob_url", "raw_url")])


_METADATA = (
    "number int, title string, body string, state string, user struct<login: string>, base struct<ref: string>, head struct<ref: string, sha: string>, "
    "diff_url string, html_url string, changed_files int, additions int, deletions int, created_at string, updated_at string"
)


def pr_metadata(landed: DataFrame, text: str = "text") -> DataFrame:
    """Flat columns of landed pull-request metadata."""
    keep = [c for c in landed.columns if c != text]
    rows = once(landed, p=F.from_json(text, _METADATA))
    return rows.select(
        *keep, "p.number", "p.title", F.coalesce("p.body", F.lit("")).alias("body"), "p.state",
        F.col("p.user.login").alias("author"), F.col("p.base.ref").alias("base_branch"), F.col("p.head.ref").alias("head_branch"),
        F.col("p.head.sha").alias("head_sha"), "p.diff_url", "p.html_url", F.coalesce("p.changed_files", F.lit(0)).alias("files_changed"),
        F.coalesce("p.additions", F.lit(0)).alias("additions"), F.coalesce("p.deletions", F.lit(0)).alias("deletions"), "p.created_at", "p.updated_at")


def file_text(encoding: Column, content: Column) -> Column:
    """Text of a landed file: base64 decoded with bad bytes replaced, null for other encodings."""
    return F.when(encoding == "base64", F.make_valid_utf8(F.unbase64(content).cast("string")))


_REPORT = (
    "results array<struct<check_id: string, path: string, start: struct<line: int>, `end`: struct<line: int>, extra: struct<severity: string, message: string, "
    "lines: string, metadata: struct<severity: string, confidence: string, fix: string, cwe: string, owasp: array<string>, references: array<string>>>>>"
)


def report_findings(reports: DataFrame, report: str = "report") -> DataFrame:
    """Findings of landed scanner reports (S9); ``cwe`` may be a text or a list."""
    keep = [c for c in reports.columns if c != report]
    rows = reports.select(*keep, F.explode(F.from_json(report, _REPORT)["results"]).alias("r"))
    extra, meta = F.col("r.extra"), F.col("r.extra.metadata")
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    message, reference = F.coalesce(extra["message"], F.lit("")), F.get(meta["references"], F.lit(0))
    level = F.upper(F.coalesce(meta["confidence"], F.lit("MEDIUM")))
    return rows.select(
        *keep, F.coalesce("r.check_id", F.lit("unknown")).alias("rule_id"),
        F.when(given(meta["severity"]), F.lower(meta["severity"])).otherwise(
            lookup(F.upper(F.coalesce(extra["severity"], F.lit("WARNING"))), REPORT_SEVERITIES, "medium")).alias("severity"),
        F.lit("static_analysis").alias("category"), F.lit("static_analysis").alias("agent_type"),
        F.coalesce(extra["message"], F.lit("Semgrep finding")).alias("title"),
        F.when(reference.isNotNull(), F.concat(message, F.lit("\n\nReference: "), reference)).otherwise(message).alias("description"),
        F.coalesce("r.path", F.lit("")).alias("file_path"), F.col("r.start.line").alias("line_start"), F.col("r.end.line").alias("line_end"),
        F.coalesce(extra["lines"], F.lit("")).alias("code_snippet"), F.coalesce(meta["fix"], F.lit("See Semgrep rule for remediation")).alias("suggestion"),
        F.when(level == "HIGH", 0.9).when(level == "LOW", 0.5).otherwise(0.7).alias("confidence_score"),
        F.when(meta["cwe"].startswith("["), F.get(F.from_json(meta["cwe"], "array<string>"), F.lit(0))).otherwise(meta["cwe"]).alias("cwe_id"),
        F.get(meta["owasp"], F.lit(0)).alias("owasp_category"))


_TOLD = ("severity string, category string, title string, description string, file_path string, line_start string, line_end string, code_snippet string, "
         "suggestion string, patch string, confidence_score string, cwe_id string, owasp_category string, rule_id string")


def transcript_findings(transcripts: DataFrame, text: str, agent_type: str) -> DataFrame:
    """Findings written as flat JSON objects within free text."""
    keep = [c for c in transcripts.columns if c != text]
    # the negated class spans line feeds, so an object may be written over several lines
    found = transcripts.select(*keep, F.posexplode(F.regexp_extract_all(text, F.lit(r'\{[^{}]*"severity"[^{}]*\}'), F.lit(0))).alias("position", "_json"))
    parsed = found.filter(F.try_parse_json("_json").isNotNull()).select(*keep, "position", F.from_json("_json", _TOLD).alias("f"))
    return parsed.select(
        *keep, "position", F.lit(agent_type).alias("agent_type"), F.col("f.severity"), F.coalesce("f.category", F.lit(agent_type)).alias("category"),
        "f.title", "f.description", "f.file_path", *[F.col(f"f.{c}").try_cast("int").alias(c) for c in ("line_start", "line_end")], "f.code_snippet", "f.suggestion", "f.patch",
        F.coalesce(F.col("f.confidence_score").try_cast("double"), F.lit(0.8)).alias("confidence_score"), "f.cwe_id", "f.owasp_category", "f.rule_id")


def event_record(events: DataFrame, published_at: Column) -> DataFrame:
    """Key and JSON value of published events, nulls written out."""
    stamped = events.withColumns({"published_at": published_at, "schema_version": F.lit("1.0")})
    return stamped.select(
        F.concat_ws(":", F.coalesce("repo_full_name", F.lit("unknown")), F.coalesce(F.col("pr_number").cast("string"), F.lit("0"))).alias("key"),
        F.to_json(F.struct(*stamped.columns), {"ignoreNullFields": "false"}).alias("value"))
