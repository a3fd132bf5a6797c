"""Registered queries: rule packs, the review of whole changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from changelens.operators import findings as L
from changelens.operators import rules as R
from changelens.operators import scan as S
from changelens.operators import scoring as Q
from changelens.operators.diffs import AGENT_LANGUAGES, added_lines
from changelens.plans import review as P
from changelens.plans import lifecycle  # noqa: F401  (defines the enrichment CTEs)
from changelens.plans.dependency import advisories
from changelens.plans.sqlbase import CTES, any_of, q, query, strip
from changelens.sources import views as V

QUERIES, ORACLES = {}, {}


# --------------------------------------------------------------------------- oracle of the scan
def _regex(text, pattern):
    return f"regexp_matches({text}, {q(pattern)})"


def _select(pack, no, rank, cond, *, severity, title, description, agent, category, numbering="added_no", file="'unknown'", suggestion=None,
            confidence=0.8, cwe=None, owasp=None, rule_id=None, rule_major=False, snippet=None, source="added"):
    snippet = snippet or strip("code")
    major, minor = (str(no), numbering) if rule_major else (numbering, str(no))
    described = " || ".join(q(p) for p in description.split("{line}")).replace(" || ", f" || {numbering} || ") if "{line}" in description else q(description)
    return f"""SELECT pr_id, {q(agent)} AS agent_type, {q(severity)} AS severity, {q(category)} AS category, {q(title)} AS title, {described} AS description,
  {file} AS file_path, {numbering}::BIGINT AS line_start, {snippet} AS code_snippet, {q(suggestion)}::VARCHAR AS suggestion, {confidence}::DOUBLE AS confidence_score,
  {q(cwe)}::VARCHAR AS cwe_id, {q(owasp)}::VARCHAR AS owasp_category, {q(rule_id or f"{pack}-{no}")} AS rule_id, diff_line, diff_file,
  ({rank} * 10000000000000000 + ({major})::BIGINT * 100000000 + {minor})::BIGINT AS emit_seq, {q(pack)} AS pack
FROM {source} WHERE {cond}"""


def _pack_selects(pack, rank, make):
    out = []
    for no, rule in enumerate(pack.rules, 1):
        out.append(_select(pack.name, no, rank, **make(no, rule)))
    return out


def _code_test(rule):
    if rule.pattern == r"http://(?!localhost)":
        return "regexp_matches(regexp_replace(code, 'http://localhost', ' ', 'g'), 'http://')"
    if rule.pattern.startswith("@app"):
        head = rule.pattern.split(r".*\n")[0]
        return f"{_regex('code', head)} AND next_code IS NOT NULL AND NOT contains(next_code, '@login_required')"
    if rule.two_line:
        return f"coalesce({_regex('code || chr(10) || next_code', rule.pattern)}, false)"
    return _regex("code", rule.pattern)


_SECURITY = dict(agent="security_audit", category="security")
_COMPLIANCE = dict(agent="compliance", category="compliance", numbering="code_no", source="code_lines")

CTES["f_quick_static"] = "\nUNION ALL ".join(_pack_selects(R.QUICK_STATIC, 10, lambda no, r: dict(
    cond=_code_test(r), severity=r.severity, title=r.title, description=f"Found `{r.pattern}` pattern at line {{line}}", agent="static_analysis",
    category="static_analysis", numbering="diff_line", file="diff_file", confidence=0.85, cwe=r.cwe,
    suggestion=f"Review and replace the {r.pattern} usage with a safer alternative")))
CTES["f_language_static"] = "\nUNION ALL ".join(_pack_selects(R.LANGUAGE_STATIC, 11, lambda no, r: dict(
    cond=_code_test(r) + ("" if r.label == "any" else " AND (" + " OR ".join(
        f"ends_with(diff_file, {q(e)})" for e, l in AGENT_LANGUAGES.items() if l == r.label) + ")"),
    severity=r.severity, title=r.title, description=r.title, agent="static_analysis", category="static_analysis", cwe=r.cwe)))
CTES["f_secrets"] = "\nUNION ALL ".join(_pack_selects(R.SECRETS, 20, lambda no, r: dict(
    cond=f"{_regex('line', r.pattern)} AND NOT {any_of(f'lower(regexp_extract(line, {q(r.pattern)}))', R.PLACEHOLDERS)}",
    severity=r.severity, title=f"Exposed {r.title}", description=f"Hardcoded {r.title} found in diff at line {{line}}", numbering="diff_line",
    confidence=0.95, owasp=R.A02, suggestion=f"Remove hardcoded {r.title} and use environment variables",
    snippet=f"CASE WHEN length(line) > 100 THEN substr({strip('line')}, 1, 100) || '...' ELSE {strip('line')} END", **_SECURITY)))
CTES["f_owasp"] = "\nUNION ALL ".join(_pack_selects(R.OWASP, 21, lambda no, r: dict(
    cond=_code_test(r), severity="high", title=r.title, description=f"OWASP {r.label}: {r.title} at line {{line}}", owasp=r.label, rule_major=True,
    suggestion="Review and remediate per OWASP guidelines", **_SECURITY)))
CTES["f_crypto"] = "\nUNION ALL ".join(_pack_selects(R.CRYPTO, 22, lambda no, r: dict(
    cond=_code_test(r), severity=r.severity, title=r.title, description=r.title, owasp=R.A02, cwe=r.cwe, confidence=0.9,
    suggestion="Replace with modern, secure cryptographic algorithm", **_SECURITY)))
CTES["f_auth"] = "\nUNION ALL ".join(_pack_selects(R.AUTH, 23, lambda no, r: dict(
    cond=_code_test(r), severity=r.severity, title=r.title, description=r.title, **_SECURITY)))
CTES["f_injection"] = "\nUNION ALL ".join(_pack_selects(R.INJECTION, 24, lambda no, r: dict(
    cond=_code_test(r), severity=r.severity, title=r.title, description=r.title, rule_id=f"injection-{r.label}", **_SECURITY)))
_GDPR = []


def _gdpr(no, pack, local, cond, severity, text, article, control, suggestion):
    _GDPR.append(_select(pack, no, 40, cond, severity=severity, title=f"GDPR: {text}", description=f"{text}. GDPR {article}. SOC2 Control: {control}",
                         suggestion=suggestion, confidence=0.75, rule_id=f"{pack}-{local}", **_COMPLIANCE))


for _i, _f in enumerate(R.PII_FIELDS, 1):
    _gdpr(_i, "pii_logging", _i, f"{any_of('low', R.LOG_WORDS)} AND contains(low, {q(_f)})", "high", f"PII field '{_f}' may be logged in plain text",
          "Article 5(1)(f) - Data integrity and confidentiality", "CC6.7",
          "Redact or mask PII before logging. Use structured logging with field-level masking.")
for _i, _f in enumerate(R.PII_FIELDS, 1):
    _gdpr(20 + _i, "pii_storage", _i, f"{any_of('low', (f'store_{_f}', f'save_{_f}'))} AND NOT {any_of('low', R.PROTECTION_WORDS)}", "high",
          f"PII '{_f}' may be stored without encryption", "Article 32 - Security of processing", "CC6.1", "Encrypt PII at rest using AES-256 or equivalent")
_gdpr(41, "consent", 1, f"{any_of('low', R.PROCESSING_WORDS)} AND NOT {any_of('low', R.CONSENT_WORDS)}", "medium",
      "Data processing operation without visible consent verification", "Article 6 - Lawfulness of processing", "PI1.1",
      "Add explicit consent check before processing personal data")
_gdpr(42, "transfer", 1, _regex("low", R.TRANSFER_PATTERN), "medium", "Data transfer to external service may require GDPR Data Processing Agreement",
      "Article 28 - Processor", "CC9.1", "Ensure DPA exists with external processor and data minimization is applied")
CTES["f_gdpr"] = "\nUNION ALL ".join(_GDPR)
CTES["f_controls"] = "\nUNION ALL ".join(_pack_selects(R.CONTROLS, 41, lambda no, r: dict(
    cond=_regex("code", "(?i)" + r.pattern), severity=r.severity, title=f"SOC2 {r.label}: {r.title}",
    description=f"SOC2 Control {r.label} ({R.SOC2_CONTROLS[r.label]}): {r.title}", confidence=0.7,
    suggestion=f"Review {r.label}: {R.SOC2_CONTROLS[r.label]} requirements", **_COMPLIANCE)))
CTES["f_operations"] = "\nUNION ALL ".join(_select(
    "operations", no, 42, f"{_regex('code', rf'(?i)def\s+{op}\s*\(')} AND NOT {any_of(chr(99) + 'oalesce(next10, chr(32))', R.OPERATION_LOG_WORDS)}",
    severity="medium", title=f"SOC2 CC7.2: Sensitive operation '{op}' may lack audit logging",
    description=f"SOC2 Control CC7.2 ({R.SOC2_CONTROLS['CC7.2']}): Sensitive operation '{op}' may lack audit logging", confidence=0.7,
    suggestion="Add audit log entry recording who performed this action and when", rule_id=f"operations-{op}", **_COMPLIANCE)
    for no, op in enumerate(R.SENSITIVE_OPERATIONS, 1))
CTES["f_audit"] = "\nUNION ALL ".join(_select(
    "audit", no, 43, f"{_regex('code', rf'(?i)def\s+{fn}\s*\(')} AND NOT {any_of('coalesce(next15, chr(32))', R.AUDIT_WORDS)}",
    severity="medium", title=f"Missing Audit Log: {fn}", description=f"Function '{fn}' lacks audit logging", confidence=0.65,
    suggestion="Add structured audit log entry with user, action, timestamp, and result", rule_id=f"audit-{fn}", **_COMPLIANCE)
    for no, fn in enumerate(R.CRITICAL_FUNCTIONS, 1))
CTES["f_retention"] = "\nUNION ALL ".join(_pack_selects(R.RETENTION, 44, lambda no, r: dict(
    cond=_regex("code", "(?i)" + r.pattern), severity=r.severity, title=r.title, description=r.title,
    suggestion="Implement data retention policy with automatic deletion after defined period", **_COMPLIANCE)))

# --------------------------------------------------------------------------- rule packs
_SHOWN = ("pr_id", "agent_type", "severity", "category", "title", "description", "file_path", "line_start", "code_snippet", "suggestion",
          "confidence_score", "cwe_id", "owasp_category", "rule_id", "diff_line", "diff_file", "emit_seq")


def _shown(df):
    return df.select(*[F.col(c).cast("bigint") if c in ("line_start", "diff_line") else F.col(c) for c in _SHOWN])


def _scan(*groups):
    return lambda spark, sf: _shown(S.scan_changes(V.changes(spark, sf).select("pr_id", "diff"), groups, secret_chars=100))


def _register(name, groups, ctes):
    QUERIES[name] = _scan(*groups)
    ORACLES[name] = query("\nUNION ALL ".join(f"SELECT {', '.join(_SHOWN)} FROM {c}" for c in ctes))


_register("r1_quick_static", ["quick_static"], ["f_quick_static"])
_register("r2_language_static", ["language_static"], ["f_language_static"])
_register("r3_owasp", ["owasp"], ["f_owasp"])
_register("r4_secrets", ["secrets"], ["f_secrets"])
_register("r5_auth_patterns", ["auth"], ["f_auth"])
_register("r6_injection_vectors", ["injection"], ["f_injection"])
_register("r7_crypto_usage", ["crypto"], ["f_crypto"])
_register("r8_gdpr", S.GDPR_GROUPS, ["f_gdpr"])
_register("r9_soc2_controls", ["controls", "operations"], ["f_controls", "f_operations"])
_register("r9_audit_logging", ["audit"], ["f_audit"])
_register("r9_data_retention", ["retention"], ["f_retention"])
_MAIN = ("f_quick_static", "f_secrets", "f_owasp", "f_crypto", "f_gdpr", "f_controls", "f_operations", "f_audit")
CTES["f_main"] = "\nUNION ALL ".join(f"SELECT * FROM {c}" for c in _MAIN)
_register("r10_finding_assembly", S.MAIN_GROUPS, ["f_main"])

QUERIES["w3_following_context"] = lambda spark, sf: S.scan_changes(
    V.changes(spark, sf).select("pr_id", "diff"), ["operations", "audit"]).groupBy("rule_id").agg(
    F.count("*").alias("uncovered"), F.min("line_start").cast("bigint").alias("first_line"))
ORACLES["w3_following_context"] = query(
    "SELECT rule_id, count(*) AS uncovered, min(line_start) AS first_line FROM (SELECT * FROM f_operations UNION ALL SELECT * FROM f_audit) GROUP BY rule_id")

_LINE_PACKS = (R.QUICK_STATIC, R.LANGUAGE_STATIC, R.OWASP, R.SECRETS, R.AUTH, R.INJECTION, R.CRYPTO, R.CONTROLS, R.RETENTION)
_PACK_COLUMNS = "pack string, rule_no bigint, pattern string, title string, severity string, needs array<string>, ignore_case boolean, two_line boolean"
CTES["text_lines"] = """
SELECT doc_id, i AS line_no, ls[i] AS code, ls[i + 1] AS next_code FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"""


def _text_lines(spark, sf):
    lines = F.split("text", "\n")
    paired = F.transform(lines, lambda l, i: F.struct(l.alias("line"), F.concat(l, F.lit("\n"), F.get(lines, i + 1)).alias("pair")))
    return V.table(spark, sf, "documents").select("doc_id", F.posexplode(paired).alias("line_no", "l")).select("doc_id", "line_no", "l.line", "l.pair")


def _shown_hits(hits):
    return hits.select("doc_id", (F.col("line_no") + 1).cast("bigint").alias("line_no"), "pack", "rule_no", "severity")


def rule_table(spark, packs=_LINE_PACKS):
    """The packs as a table, as users may keep theirs."""
    return spark.createDataFrame([
        (p.name, no, r.pattern, r.title, r.severity, list(r.needs), p.ignore_case, r.two_line) for p in packs for no, r in enumerate(p.rules, 1)], _PACK_COLUMNS)


def _line_test(pack, rule):
    return _regex("code", "(?i)" + rule.pattern) if pack.ignore_case else _code_test(rule)


QUERIES["j9_line_rule_join"] = lambda spark, sf: _shown_hits(S.match_rules(_text_lines(spark, sf), "line", _LINE_PACKS, pair="pair"))
QUERIES["j9_rule_table"] = lambda spark, sf: S.match_rule_table(
    added_lines(V.changes(spark, sf).select("pr_id", "diff"), pair_when=lambda code: F.lit(True)), "code", rule_table(spark), pair="pair").select(
    "pr_id", F.col("diff_line").cast("bigint"), "pack", "rule_no", "title", "severity")
ORACLES["j9_rule_table"] = query("\nUNION ALL ".join(
    f"SELECT pr_id, diff_line, {q(p.name)} AS pack, {no}::BIGINT AS rule_no, {q(r.title)} AS title, {q(r.severity)} AS severity FROM added WHERE {_line_test(p, r)}"
    for p in _LINE_PACKS for no, r in enumerate(p.rules, 1)))
ORACLES["j9_line_rule_join"] = query("\nUNION ALL ".join(
    f"SELECT doc_id, line_no, {q(p.name)} AS pack, {no}::BIGINT AS rule_no, {q(r.severity)} AS severity FROM text_lines WHERE {_line_test(p, r)}"
    for p in _LINE_PACKS for no, r in enumerate(p.rules, 1)))
MY_RULES = R.Pack("my_rules", (
    R.Rule(r"yaml\.load\(", "Unsafe yaml loading", "high", ("yaml.load(",), "CWE-502"), R.Rule(r"return\s+None", "Returns nothing", "info", ()),))
QUERIES["p1_user_pack"] = lambda spark, sf: S.scan_changes(V.changes(spark, sf).select("pr_id", "diff"), [MY_RULES, "quick_static"]).select(
    "pr_id", "title", "severity", F.col("line_start").cast("bigint"), "rule_id")
ORACLES["p1_user_pack"] = query("SELECT pr_id, title, severity, line_start, rule_id FROM f_quick_static UNION ALL " + " UNION ALL ".join(
    f"SELECT pr_id, {q(r.title)}, {q(r.severity)}, added_no, 'my_rules-{no}' FROM added WHERE {_regex('code', r.pattern)}" for no, r in enumerate(MY_RULES.rules, 1)))

QUERIES["a13_categories_hit"] = lambda spark, sf: L.categories_hit(S.scan_changes(V.changes(spark, sf).select("pr_id", "diff"), ["owasp", "injection"]))
ORACLES["a13_categories_hit"] = query("""
SELECT pr_id, coalesce(string_agg(DISTINCT owasp_category, ';' ORDER BY owasp_category), '') AS owasp_hit,
  coalesce(string_agg(DISTINCT inj, ';' ORDER BY inj), '') AS injection_hit
FROM (SELECT pr_id, owasp_category, CASE WHEN starts_with(rule_id, 'injection-') THEN substr(rule_id, 11) END AS inj
  FROM (SELECT * FROM f_owasp UNION ALL SELECT * FROM f_injection)) GROUP BY pr_id""")

# --------------------------------------------------------------------------- triage and routing
QUERIES["q1_risk_score"] = lambda spark, sf: Q.with_risk(V.changes(spark, sf), 500).select("pr_id", F.col("score_pts").cast("bigint"), "risk_score")
ORACLES["q1_risk_score"] = query("SELECT pr_id, score_pts::BIGINT AS score_pts, score_pts / 100.0::DOUBLE AS risk_score FROM scored")
QUERIES["q2_depth_routing"] = lambda spark, sf: Q.route(Q.with_risk(V.changes(spark, sf), 500)).select("pr_id", F.array_join("agents", ">").alias("agents"))
ORACLES["q2_depth_routing"] = query("""
SELECT pr_id, CASE WHEN score_pts < 30 THEN 'static_analysis' ELSE 'static_analysis>security_audit>dependency>compliance>remediation>reflection' END AS agents
FROM scored""")

# --------------------------------------------------------------------------- whole reviews
CTES["f_raw"] = """
SELECT f.* EXCLUDE (pack), s.score_pts FROM (SELECT * FROM f_main UNION ALL SELECT * FROM f_stale UNION ALL SELECT * FROM f_advisory) f
JOIN scored s USING (pr_id) WHERE s.score_pts >= 30 OR f.agent_type = 'static_analysis'"""
CTES["f_final"] = """
SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY pr_id, file_path, line_start, substr(title, 1, 50) ORDER BY emit_seq, title) AS n
  FROM f_enriched WHERE score_pts >= 30 AND coalesce(confidence_score, 0.8) >= 0.4) WHERE n = 1
UNION ALL SELECT * FROM f_enriched WHERE score_pts < 30"""


_STORED = P.Widths(title=50, secret=100, places=500)


def _sources(spark, sf):
    return V.changes(spark, sf), advisories(spark, sf)


def _bigints(df, *names):
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


def _raw_rollup(df):
    return df.groupBy("pr_id", "agent_type").agg(F.count("*").alias("findings"), F.count_if(F.col("severity").isin("critical", "high")).alias("serious"))


QUERIES["u1_union_of_agents"] = lambda spark, sf: _raw_rollup(P.raw_findings(*_sources(spark, sf), _STORED))
ORACLES["u1_union_of_agents"] = query("""
SELECT pr_id, agent_type, count(*) AS findings, count(*) FILTER (severity IN ('critical', 'high')) AS serious FROM f_raw GROUP BY ALL""")


def _final(spark, sf):
    return P.review(*_sources(spark, sf), _STORED).select(
        "pr_id", "agent_type", "severity", "title", "description", "file_path", F.coalesce("line_start", F.lit(-1)).cast("bigint").alias("line_start"),
        "rule_id", "emit_seq", "suggestion", "patch", F.array_join("safer_libraries", ";").alias("safer_libraries"), "attack_scenario", "business_impact",
        F.col("remediation_explanation.impact").alias("impact"))


QUERIES["review_final_findings"] = _final
ORACLES["review_final_findings"] = query("""
SELECT pr_id, agent_type, severity, title, description, file_path, coalesce(line_start, -1) AS line_start, rule_id, emit_seq, suggestion, patch,
  safer_libraries, attack_scenario, business_impact, impact FROM f_final""")

QUERIES["a12_reflection_counts"] = lambda spark, sf: L.reflection_counts(P.raw_findings(*_sources(spark, sf), _STORED), title_length=_STORED.title)
ORACLES["a12_reflection_counts"] = query("""
SELECT pr_id, count(*) AS original_count, count(*) FILTER (coalesce(confidence_score, 0.8) >= 0.4) AS after_filter,
  count(DISTINCT (coalesce(file_path, '?'), coalesce(line_start, -1), substr(title, 1, 50))) FILTER (coalesce(confidence_score, 0.8) >= 0.4) AS final_count
FROM f_raw GROUP BY pr_id""")
QUERIES["a11_agent_result_counts"] = lambda spark, sf: L.agent_counts(P.raw_findings(*_sources(spark, sf), _STORED))
ORACLES["a11_agent_result_counts"] = query("""
SELECT pr_id, count(*) FILTER (agent_type = 'static_analysis') AS agent_static_analysis, count(*) FILTER (agent_type = 'security_audit') AS agent_security_audit,
  count(*) FILTER (agent_type = 'dependency') AS agent_dependency, count(*) FILTER (agent_type = 'compliance') AS agent_compliance,
  count(*) FILTER (severity IN ('critical', 'high')) AS enriched FROM f_raw GROUP BY pr_id""")
ORACLES["w4_first_wins_orchestrator_key"] = query("""
SELECT pr_id, count(*) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY pr_id, file_path, line_start, substr(title, 1, 50) ORDER BY emit_seq, title) AS n
  FROM f_raw WHERE coalesce(confidence_score, 0.8) >= 0.4) WHERE n = 1 GROUP BY pr_id""")
QUERIES["w4_first_wins_orchestrator_key"] = lambda spark, sf: L.first_wins(
    Q.confident(P.raw_findings(*_sources(spark, sf), _STORED)), L.orchestrator_key(50), ["emit_seq", "title"]).groupBy("pr_id").agg(F.count("*").alias("kept"))

QUERIES["q12_review_report"] = lambda spark, sf: P.reports(*_sources(spark, sf), _STORED)
ORACLES["q12_review_report"] = query(r"""
SELECT s.pr_id, 0::BIGINT AS part,
  '# Code Review Report: ' || s.repo_full_name || ' PR #' || s.pr_number || chr(10) || chr(10) || '**Risk Score:** ' || printf('%.2f', s.score_pts / 100.0)
  || '/1.0' || chr(10) || '**Total Findings:** ' || coalesce(f.total, 0) || chr(10) || chr(10) || '## Severity Summary'
  || coalesce(f.summary, '') || chr(10) || chr(10) || '## Agent Results' || chr(10) || '- **triage**: {''risk_score'': ' || (s.score_pts / 100.0)::DOUBLE || '}'
  || chr(10) || '- **static_analysis**: {''findings_count'': ' || coalesce(r.a1, 0) || '}'
  || CASE WHEN s.score_pts >= 30 THEN chr(10) || '- **security_audit**: {''findings_count'': ' || coalesce(r.a2, 0) || '}'
     || chr(10) || '- **dependency**: {''findings_count'': ' || coalesce(r.a3, 0) || '}'
     || chr(10) || '- **compliance**: {''findings_count'': ' || coalesce(r.a4, 0) || '}'
     || CASE WHEN coalesce(r.serious, 0) > 0 THEN chr(10) || '- **remediation**: {''enriched_count'': ' || r.serious || '}' ELSE '' END ELSE '' END
  || CASE WHEN coalesce(f.total, 0) > 0 THEN chr(10) || chr(10) || '## Critical & High Findings' ELSE '' END AS report
FROM scored s
LEFT JOIN (SELECT pr_id, count(*) AS total,
    CASE WHEN count(*) FILTER (severity = 'critical') > 0 THEN chr(10) || '- **CRITICAL**: ' || count(*) FILTER (severity = 'critical') ELSE '' END
    || CASE WHEN count(*) FILTER (severity = 'high') > 0 THEN chr(10) || '- **HIGH**: ' || count(*) FILTER (severity = 'high') ELSE '' END
    || CASE WHEN count(*) FILTER (severity = 'medium') > 0 THEN chr(10) || '- **MEDIUM**: ' || count(*) FILTER (severity = 'medium') ELSE '' END
    || CASE WHEN count(*) FILTER (severity = 'low') > 0 THEN chr(10) || '- **LOW**: ' || count(*) FILTER (severity = 'low') ELSE '' END
    || CASE WHEN count(*) FILTER (severity = 'info') > 0 THEN chr(10) || '- **INFO**: ' || count(*) FILTER (severity = 'info') ELSE '' END AS summary
  FROM f_final GROUP BY pr_id) f USING (pr_id)
LEFT JOIN (SELECT pr_id, count(*) FILTER (agent_type = 'static_analysis') AS a1, count(*) FILTER (agent_type = 'security_audit') AS a2,
    count(*) FILTER (agent_type = 'dependency') AS a3, count(*) FILTER (agent_type = 'compliance') AS a4, count(*) FILTER (severity IN ('critical', 'high')) AS serious
  FROM f_raw GROUP BY pr_id) r USING (pr_id)
UNION ALL SELECT pr_id, row_number() OVER (PARTITION BY pr_id ORDER BY emit_seq, title) AS part, chr(10) || '### [' || upper(severity) || '] ' || title || chr(10) || '**File:** `'
  || coalesce(file_path, 'None') || '` (lines ' || coalesce(line_start::VARCHAR, 'None') || '-' || coalesce(line_start::VARCHAR, 'None') || ')' || chr(10) || chr(10)
  || description || CASE WHEN coalesce(suggestion, '') <> '' THEN chr(10) || chr(10) || '**Suggestion:** ' || suggestion ELSE '' END AS report
FROM f_final WHERE severity IN ('critical', 'high')""")

QUERIES["q13_comment_outbox"] = lambda spark, sf: P.outbox(*_sources(spark, sf), _STORED)
ORACLES["q13_comment_outbox"] = query(r"""
SELECT s.pr_id, s.repo_full_name, s.pr_number, CASE WHEN score_pts > 70 THEN 'red' WHEN score_pts > 30 THEN 'amber' ELSE 'green' END AS band,
  '## ' || CASE WHEN score_pts > 70 THEN '🔴' WHEN score_pts > 30 THEN '🟡' ELSE '🟢' END || ' Automated Code Review Report' || chr(10) || chr(10)
  || '**Risk Score:** ' || printf('%.2f', score_pts / 100.0) || '/1.0' || chr(10) || chr(10) || '### Finding Summary' || chr(10) || '| Severity | Count |' || chr(10)
  || '|----------|-------|' || chr(10) || '| 🔴 Critical | ' || coalesce(c, 0) || ' |' || chr(10) || '| 🟠 High | ' || coalesce(h, 0) || ' |' || chr(10)
  || '| 🟡 Medium | ' || coalesce(m, 0) || ' |' || chr(10) || chr(10) || '### Top Findings' || chr(10) || coalesce(entries, '') AS body
FROM scored s LEFT JOIN (SELECT pr_id, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS m,
    string_agg(CASE WHEN n <= 5 AND severity IN ('critical', 'high') THEN chr(10) || '- **[' || upper(severity) || ']** ' || title
      || CASE WHEN coalesce(file_path, '') <> '' THEN ' (`' || file_path || '`)' ELSE '' END END, '' ORDER BY n) AS entries
  FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY emit_seq, title) AS n FROM f_final) GROUP BY pr_id) f USING (pr_id)""")
QUERIES["q13_inline_comments"] = lambda spark, sf: _bigints(L.inline_comments(P.stored(P.review(*_sources(spark, sf), _STORED, folded=True), "final-findings")), "comment_no", "line")
ORACLES["q13_inline_comments"] = query("""
SELECT pr_id, (n - 1) // 50 AS review_no, n AS comment_no, file_path AS path, coalesce(line_start, 1) AS line, 'RIGHT' AS side, description AS body
FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY emit_seq, title) AS n FROM f_final)""")


def flagship(spark, sf):
    """Findings by severity of the exposed-secret scan."""
    return S.scan_changes(V.changes(spark, sf).select("pr_id", "diff"), ["secrets"]).groupBy("severity").agg(
        F.count("*").alias("findings"), F.countDistinct("pr_id").alias("changes"))


QUERIES["secrets_by_severity"] = flagship
ORACLES["secrets_by_severity"] = query("SELECT severity, count(*) AS findings, count(DISTINCT pr_id) AS changes FROM f_secrets GROUP BY severity")
