"""DuckDB twins of the views: shared CTEs for the oracle queries."""

from __future__ import annotations

import re

from changelens.sources.exemplars import SAMPLES
from changelens.sources.views import EXTENSIONS


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def pick(values, index: str) -> str:
    return "([" + ", ".join(q(v) for v in values) + f"])[(({index}) % {len(values)} + 1)::INT]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def any_of(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


_POS, _NEG = [p for p, _ in SAMPLES], [n for _, n in SAMPLES]

CTES: dict[str, str] = {}

CTES["changes0"] = f"""
SELECT doc_id AS d, source, n_chars, text,
  'src/' || source || '/' || {pick(("test_", "auth/", "example_", "", "", ""), "doc_id")} || doc_id || '.' || {pick(EXTENSIONS, "doc_id")} AS p1,
  'app/' || (doc_id % 9) || '/handler.' || {pick(EXTENSIONS, "doc_id // 3")} AS p2,
  {pick(("requirements.txt", "web/package.json", "svc/go.mod", "Pipfile"), "doc_id")} AS p3,
  'pkg-' || (doc_id % 37) AS nm, 'lib-' || (doc_id % 11) AS lib,
  (doc_id % 3) || '.' || (doc_id % 10) || '.' || (doc_id % 7) AS ver
FROM documents"""

_HEAD = "['diff --git a/' || {p} || ' b/' || {p}, '--- a/' || {p}, '+++ b/' || {p}, '@@ -1 +1 @@']"

CTES["changes"] = f"""
SELECT d::VARCHAR AS pr_id, 'org/' || source AS repo_full_name, d AS pr_number,
  {pick(("fix/typo-", "refactor/auth-", "feature/", "chore/config-", "fix/"), "d")} || d AS head_branch,
  d % 25 + 1 AS files_changed, n_chars % 700 AS additions, d % 90 AS deletions,
  array_to_string(flatten([
    {_HEAD.format(p="p1")},
    list_transform(string_split(text, chr(10)), lambda l, i: CASE (i - 1) % 7 WHEN 3 THEN '-' WHEN 5 THEN ' ' ELSE '+' END || l),
    {_HEAD.format(p="p2")},
    list_transform(string_split({pick(_POS, "d")} || chr(10) || {pick(_NEG, "d")} || chr(10) || {pick(_POS, "d * 7 + 3")}, chr(10)), lambda l: '+' || l),
    ['\\ No newline at end of file'],
    {_HEAD.format(p="p3")},
    list_transform(CASE d % 4
      WHEN 0 THEN [nm || '==' || ver, lib || '>=0.' || (d % 5) || ',<9', nm || '~=' || ver]
      WHEN 1 THEN ['{{ "name": "web",', '"version": "1.0",', '  "' || nm || '": "^' || ver || '",']
      WHEN 2 THEN ['require example.org/' || nm || ' v' || ver, chr(9) || 'example.org/' || lib || ' v1.0.0']
      ELSE [nm || ' = "==' || ver || '"', lib || ' = "*"'] END, lambda l: '+' || l)
  ]), chr(10)) AS diff
FROM changes0"""

CTES["dl"] = """
SELECT *, coalesce(last_value(CASE WHEN starts_with(line, '+++ b/') THEN substr(line, 7) END IGNORE NULLS)
  OVER (PARTITION BY pr_id ORDER BY diff_line ROWS UNBOUNDED PRECEDING), 'unknown') AS diff_file
FROM (SELECT pr_id, generate_subscripts(ls, 1) AS diff_line, unnest(ls) AS line
      FROM (SELECT pr_id, string_split(diff, chr(10)) AS ls FROM changes))"""

CTES["added"] = """
SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY diff_line) AS added_no,
  CASE WHEN NOT starts_with(line, '+++') THEN row_number() OVER (PARTITION BY pr_id, starts_with(line, '+++') ORDER BY diff_line) END AS code_no,
  substr(line, 2) AS code, lower(substr(line, 2)) AS low,
  lead(substr(line, 2)) OVER (PARTITION BY pr_id ORDER BY diff_line) AS next_code
FROM dl WHERE starts_with(line, '+')"""

CTES["code_lines"] = """
SELECT *, string_agg(low, chr(10)) OVER (PARTITION BY pr_id ORDER BY code_no ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS next10,
  string_agg(low, chr(10)) OVER (PARTITION BY pr_id ORDER BY code_no ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING) AS next15
FROM added WHERE code_no IS NOT NULL"""

CTES["scored"] = """
SELECT *, least(100,
  CASE WHEN additions + deletions > 500 THEN 30 WHEN additions + deletions > 200 THEN 20 WHEN additions + deletions > 50 THEN 10 ELSE 5 END
  + CASE WHEN files_changed > 20 THEN 20 WHEN files_changed > 10 THEN 10 ELSE 5 END
  + CASE WHEN hits > 5 THEN 30 WHEN hits > 2 THEN 20 WHEN hits > 0 THEN 10 ELSE 0 END
  + CASE WHEN len(list_filter(['auth', 'security', 'crypto', 'payment', 'billing', 'admin', 'config'],
      lambda w: contains(lower(head_branch || substr(diff, 1, 500)), w))) > 0 THEN 20 ELSE 0 END) AS score_pts
FROM (SELECT *, len(list_filter(['password', 'secret', 'token', 'api_key', 'auth', 'crypto', 'encrypt', 'decrypt', 'sql', 'exec(', 'eval(',
      'subprocess', 'os.system', 'pickle', 'deserializ', 'jwt', 'oauth', 'pem', 'private_key', 'chmod', 'sudo', 'root', 'admin'],
      lambda w: contains(lower(diff), w))) AS hits FROM changes)"""

CTES["finding_facts"] = f"""
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_extendedprice::DECIMAL(14,2) AS finding_id,
  l_orderkey AS pr_id,
  CASE l_returnflag || l_linestatus WHEN 'RO' THEN 'critical' WHEN 'RF' THEN 'high' WHEN 'AO' THEN 'medium' WHEN 'AF' THEN 'low'
    WHEN 'NO' THEN 'info' ELSE 'medium' END AS severity,
  {pick(("security", "compliance", "static_analysis", "dependency"), "l_suppkey")} AS category,
  {pick(("security_audit", "compliance", "static_analysis", "dependency"), "l_suppkey")} AS agent_type,
  {pick(("SQL injection in query", "Use of eval() is dangerous", "Weak random source", "Hardcoded password comparison",
         "MD5 is cryptographically broken", "General note on style", "XSS through innerHTML"), "l_partkey")} || ' near block ' || (l_partkey % 3) AS title,
  {pick(("This may possibly be unsafe", "A hardcoded credential was found in this place; move it to a vault", "Short text"), "l_linenumber")}
    || ' (' || l_returnflag || ')' AS description,
  CASE WHEN l_linenumber <> 7 THEN {pick(("src/tests/", "src/", "examples/", "src/core/"), "l_partkey")} || (l_partkey % 5) || '.py' END AS file_path,
  CASE WHEN l_partkey % 6 <> 0 THEN (l_linenumber % 4) * 10 END AS line_start,
  {pick(("password = p", "x = 1", "api_key = k", ""), "l_partkey + l_linenumber")} AS code_snippet,
  {pick(("Use parameterized queries", "Replace this call with a safer library call and add a regression test", ""), "l_linenumber + 1")} AS suggestion,
  round(1 - l_discount * 8, 2) AS confidence_score,
  {pick(("CWE-89", "CWE-95", "CWE-338", "CWE-327", "CWE-79", ""), "l_partkey")} AS cwe_id,
  (l_partkey + l_linenumber) % 5 = 0 AS false_positive,
  CASE WHEN l_partkey % 3 = 0 THEN 'checked ' || l_returnflag END AS human_feedback,
  l_shipdate AS created_at, l_linenumber AS emit_seq
FROM lineitem"""

CTES["pr_facts"] = f"""
SELECT o_orderkey AS pr_id, 'org' || (o_custkey % 7) || '/repo' || (o_custkey % 61) AS repo_full_name, o_orderkey AS pr_number,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN {pick(("pending", "queued"), "o_orderkey")}
    ELSE {pick(("reviewing", "failed", "skipped"), "o_orderkey")} END AS status,
  round(o_totalprice / 600000, 2) AS risk_score, o_orderdate AS created_at
FROM orders"""

CTES["run_facts"] = """
SELECT event_id AS run_id, event_id % 997 AS pr_id,
  CASE event_type WHEN 'click' THEN 'static_analysis' WHEN 'view' THEN 'security_audit' WHEN 'purchase' THEN 'dependency'
    WHEN 'signup' THEN 'compliance' ELSE 'orchestrator' END AS agent_type,
  CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 11 = 0 THEN 'running' ELSE 'completed' END AS status,
  ts AS started_at, CASE WHEN event_id % 11 <> 0 THEN value END AS duration_seconds,
  json_extract_string(props, '$.k')::BIGINT AS tokens_used, event_id % 6 AS findings_count
FROM events"""

CTES["request_log"] = """
SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method, '/' || event_type AS endpoint,
  CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 50 = 0 THEN 503 ELSE 200 END AS status_code, value / 25 AS latency
FROM events"""

CTES["pr_events"] = """
SELECT event_id AS seq, ts, 'org/repo' || (user_id % 5) AS repo_full_name,
  CASE WHEN event_id % 17 <> 0 THEN user_id END AS pr_number,
  CASE WHEN event_id % 13 = 0 THEN 'push' ELSE 'pull_request' END AS event_type,
  CASE event_type WHEN 'view' THEN 'synchronize' WHEN 'click' THEN 'opened' WHEN 'error' THEN 'closed' ELSE 'reopened' END AS action,
  CASE WHEN event_id % 3 <> 0 THEN 'Title ' || event_id END AS pr_title,
  CASE WHEN event_id % 4 <> 0 THEN 'dev' || (event_id % 9) END AS pr_author,
  CASE WHEN event_id % 5 <> 0 THEN 'topic/' || (event_id % 31) END AS head_branch,
  CASE WHEN event_id % 6 <> 0 THEN event_id % 40 END AS files_changed,
  CASE WHEN event_id % 2 = 0 THEN event_id % 500 END AS additions, event_id % 90 AS deletions
FROM events"""


def query(sql: str) -> str:
    """Prefix the CTEs the statement needs, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if name not in order and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in order:
                    order.append(name)

    visit(sql)
    if not order:
        return sql.strip()
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n].strip()})" for n in order) + "\n" + sql.strip()
