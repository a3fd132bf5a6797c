"""Schemas of the stored tables and of published events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    "strings": T.ArrayType(T.StringType()), "vector": T.ArrayType(T.FloatType()),
}


def _struct(required: str, optional: str = "") -> T.StructType:
    fields = []
    for text, nullable in ((required, False), (optional, True)):
        for item in filter(None, (x.strip() for x in text.split(";"))):
            name, kind = item.split(" ", 1)
            fields.append(T.StructField(name, _TYPES[kind], nullable))
    return T.StructType(fields)


PULL_REQUESTS = _struct(
    "id string; repo_full_name string; pr_number int; title string; author string; base_branch string; head_branch string; status string; "
    "files_changed int; additions int; deletions int; created_at timestamp; updated_at timestamp",
    "diff_url string; html_url string; body string; risk_score double; reviewed_at timestamp")
FINDINGS = _struct(
    "id string; pr_id string; agent_type string; severity string; category string; title string; description string; confidence_score double; "
    "false_positive boolean; created_at timestamp",
    "file_path string; line_start int; line_end int; code_snippet string; suggestion string; patch string; human_feedback string; cwe_id string; "
    "owasp_category string; rule_id string")
AGENT_RUNS = _struct(
    "id string; pr_id string; agent_type string; status string; started_at timestamp; steps_taken int; tokens_used int; findings_count int",
    "completed_at timestamp; error_message string; trace_id string; duration_seconds double")
USERS = _struct("id string; github_id string; login string; role string; created_at timestamp", "email string; name string; avatar_url string; last_login timestamp")
CODE_CHUNKS = _struct(
    "pr_id string; repo string; file_path string; language string; content string; chunk_index int; line_start int; line_end int",
    "symbols strings; vector vector")
PR_EVENT = _struct("", (
    "event_type string; action string; pr_number int; pr_title string; pr_author string; base_branch string; head_branch string; diff_url string; "
    "html_url string; body string; repo_full_name string; files_changed int; additions int; deletions int; published_at string; schema_version string"))

# Plain-string enumerations.
PR_STATUSES = ("pending", "queued", "reviewing", "completed", "failed", "skipped")
CATEGORIES = ("security", "compliance", "static_analysis", "dependency", "performance", "maintainability", "remediation")
AGENT_TYPES = ("static_analysis", "security_audit", "dependency", "compliance", "remediation", "reflection", "orchestrator")
RUN_STATUSES = ("pending", "running", "completed", "failed", "cancelled")
ROLES = ("admin", "reviewer", "viewer")


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table under its declared schema; partition columns are added by the reader."""
    return spark.read.schema(schema).parquet(path)


def conform(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast the columns of a schema; absent ones become null."""
    have = set(rows.columns)
    return rows.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
