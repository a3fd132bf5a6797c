"""Change-audit inputs derived from the test tables, narrowly: no shuffle in any view.

Each view has a twin among the CTEs of ``plans``; both follow the same formulas.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.functions.text import once
from changelens.sources.exemplars import SAMPLES

EXTENSIONS = ("py", "js", "ts", "go", "java", "sql", "rb", "md", "jsx", "tf")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index: Column) -> Column:
    listed = F.from_json(F.lit(json.dumps(list(values))), "array<string>")
    return F.element_at(listed, (index % len(values) + 1).cast("int"))


def _signed(lines: Column) -> Column:
    return F.transform(
        lines, lambda l, i: F.concat(F.when(i % 7 == 3, "-").when(i % 7 == 5, " ").otherwise("+"), l)
    )


def _added(lines: Column) -> Column:
    return F.transform(lines, lambda l: F.concat(F.lit("+"), l))


def _header(path: Column) -> Column:
    return F.array(
        F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path),
        F.concat(F.lit("--- a/"), path),
        F.concat(F.lit("+++ b/"), path),
        F.lit("@@ -1 +1 @@"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pull request per document: metadata and a three-file unified diff in one cell."""
    d = F.col("doc_id")
    text_path = F.concat(
        F.lit("src/"), F.col("source"), F.lit("/"), _pick(("test_", "auth/", "example_", "", "", ""), d),
        d.cast("string"), F.lit("."), _pick(EXTENSIONS, d),
    )
    code_path = F.concat(F.lit("app/"), (d % 9).cast("string"), F.lit("/handler."), _pick(EXTENSIONS, F.floor(d / 3)))
    manifest_path = _pick(("requirements.txt", "web/package.json", "svc/go.mod", "Pipfile"), d)
    name = F.concat(F.lit("pkg-"), (d % 37).cast("string"))
    version = F.concat_ws(".", (d % 3).cast("string"), (d % 10).cast("string"), (d % 7).cast("string"))
    second = F.concat(F.lit("lib-"), (d % 11).cast("string"))
    manifest = (
        F.when(d % 4 == 0, F.array(
            F.concat(name, F.lit("=="), version), F.concat(second, F.lit(">=0."), (d % 5).cast("string"), F.lit(",<9")),
            F.concat(name, F.lit("~="), version)))
        .when(d % 4 == 1, F.array(
            F.lit('{ "name": "web",'), F.lit('"version": "1.0",'), F.concat(F.lit('  "'), name, F.lit('": "^'), version, F.lit('",'))))
        .when(d % 4 == 2, F.array(
            F.concat(F.lit("require example.org/"), name, F.lit(" v"), version), F.concat(F.lit("\texample.org/"), second, F.lit(" v1.0.0"))))
        .otherwise(F.array(
            F.concat(name, F.lit(' = "=='), version, F.lit('"')), F.concat(second, F.lit(' = "*"'))))
    )
    sample = F.split(F.concat_ws("\n", _pick([p for p, _ in SAMPLES], d), _pick([n for _, n in SAMPLES], d),
                                 _pick([p for p, _ in SAMPLES], d * 7 + 3)), "\n")
    diff = F.array_join(
        F.concat(
            _header(text_path), _signed(F.split("text", "\n")),
            _header(code_path), _added(sample), F.array(F.lit("\\ No newline at end of file")),
            _header(manifest_path), _added(manifest),
        ),
        "\n",
    )
    derived = table(spark, sf_dir, "documents").select(
        d.cast("string").alias("pr_id"),
        F.concat(F.lit("org/"), F.col("source")).alias("repo_full_name"),
        d.alias("pr_number"),
        F.concat(_pick(("fix/typo-", "refactor/auth-", "feature/", "chore/config-", "fix/"), d), d.cast("string")).alias("head_branch"),
        (d % 25 + 1).alias("files_changed"),
        (F.col("n_chars") % 700).alias("additions"),
        (d % 90).alias("deletions"),
        "source", "text", d.alias("doc_id"),
    )
    # stands in for a stored column: built once, whatever is done with it afterwards
    return once(derived, diff=diff).drop("source", "text", "doc_id")


def finding_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored findings, one per line item; the pull request is the order."""
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(14,2)")).alias("finding_id"),
        F.col("l_orderkey").alias("pr_id"),
        F.when(F.col("l_returnflag") == "R", F.when(F.col("l_linestatus") == "O", "critical").otherwise("high"))
        .when(F.col("l_returnflag") == "A", F.when(F.col("l_linestatus") == "O", "medium").otherwise("low"))
        .otherwise(F.when(F.col("l_linestatus") == "O", "info").otherwise("medium")).alias("severity"),
        _pick(("security", "compliance", "static_analysis", "dependency"), F.col("l_suppkey")).alias("category"),
        _pick(("security_audit", "compliance", "static_analysis", "dependency"), F.col("l_suppkey")).alias("agent_type"),
        F.concat(_pick(("SQL injection in query", "Use of eval() is dangerous", "Weak random source", "Hardcoded password comparison",
                        "MD5 is cryptographically broken", "General note on style", "XSS through innerHTML"), part),
                 F.lit(" near block "), (part % 3).cast("string")).alias("title"),
        F.concat(_pick(("This may possibly be unsafe", "A hardcoded credential was found in this place; move it to a vault", "Short text"), line),
                 F.lit(" ("), F.col("l_returnflag"), F.lit(")")).alias("description"),
        F.when(line == 7, F.lit(None)).otherwise(
            F.concat(_pick(("src/tests/", "src/", "examples/", "src/core/"), part), (part % 5).cast("string"), F.lit(".py"))).alias("file_path"),
        F.when(part % 6 == 0, F.lit(None)).otherwise((line % 4) * 10).cast("int").alias("line_start"),
        _pick(("password = p", "x = 1", "api_key = k", ""), part + line).alias("code_snippet"),
        _pick(("Use parameterized queries", "Replace this call with a safer library call and add a regression test", ""), line + 1).alias("suggestion"),
        F.round(1 - F.col("l_discount") * 8, 2).alias("confidence_score"),
        _pick(("CWE-89", "CWE-95", "CWE-338", "CWE-327", "CWE-79", ""), part).alias("cwe_id"),
        ((part + line) % 5 == 0).alias("false_positive"),
        F.when(part % 3 == 0, F.concat(F.lit("checked "), F.col("l_returnflag"))).alias("human_feedback"),
        F.col("l_shipdate").alias("created_at"),
        line.alias("emit_seq"),
    )


def pr_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pull requests, one per order."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("pr_id"),
        F.concat(F.lit("org"), (F.col("o_custkey") % 7).cast("string"), F.lit("/repo"), (F.col("o_custkey") % 61).cast("string")).alias("repo_full_name"),
        key.alias("pr_number"),
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "P", _pick(("pending", "queued"), key))
        .otherwise(_pick(("reviewing", "failed", "skipped"), key)).alias("status"),
        F.round(F.col("o_totalprice") / 600000, 2).alias("risk_score"),
        F.col("o_orderdate").alias("created_at"),
    )


def run_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored agent runs, one per event."""
    e = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"),
        (F.col("event_id") % 997).alias("pr_id"),
        F.when(e == "click", "static_analysis").when(e == "view", "security_audit").when(e == "purchase", "dependency")
        .when(e == "signup", "compliance").otherwise("orchestrator").alias("agent_type"),
        F.when(e == "error", "failed").when(F.col("event_id") % 11 == 0, "running").otherwise("completed").alias("status"),
        F.col("ts").cast("timestamp").alias("started_at"),
        F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("duration_seconds"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens_used"),
        (F.col("event_id") % 6).alias("findings_count"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Served requests, one per event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_id") % 3 == 0, "POST").otherwise("GET").alias("method"),
        F.concat(F.lit("/"), F.col("event_type")).alias("endpoint"),
        F.when(F.col("event_type") == "error", 500).when(F.col("event_id") % 50 == 0, 503).otherwise(200).alias("status_code"),
        (F.col("value") / 25).alias("latency"),
    )


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published pull-request events as key and JSON value, ordered by ``event_id``."""
    i, u = F.col("event_id"), F.col("user_id")
    fields = F.struct(
        F.when(i % 13 == 0, "push").otherwise("pull_request").alias("event_type"),
        F.when(F.col("event_type") == "view", "synchronize").when(F.col("event_type") == "click", "opened")
        .when(F.col("event_type") == "error", "closed").otherwise("reopened").alias("action"),
        F.when(i % 17 != 0, u).alias("pr_number"),
        F.when(i % 3 != 0, F.concat(F.lit("Title "), i.cast("string"))).alias("pr_title"),
        F.when(i % 4 != 0, F.concat(F.lit("dev"), (i % 9).cast("string"))).alias("pr_author"),
        F.lit("main").alias("base_branch"),
        F.when(i % 5 != 0, F.concat(F.lit("topic/"), (i % 31).cast("string"))).alias("head_branch"),
        F.concat(F.lit("org/repo"), (u % 5).cast("string")).alias("repo_full_name"),
        F.when(i % 6 != 0, i % 40).alias("files_changed"),
        F.when(i % 2 == 0, i % 500).alias("additions"),
        (i % 90).alias("deletions"),
    )
    # a null body is written as an explicit JSON null: present, unlike an absent key
    value = F.to_json(fields)
    value = F.when(i % 7 == 0, F.regexp_replace(value, r"\}$", ',"body":null}')).otherwise(value)
    derived = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("org/repo"), (u % 5).cast("string"), F.lit(":"), u.cast("string")).alias("key"),
        "event_id", "event_type", "user_id")
    # stands in for a stored column, like the diff of ``changes``
    return once(derived, value=value).drop("event_id", "event_type", "user_id")
