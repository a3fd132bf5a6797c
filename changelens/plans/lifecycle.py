"""Registered queries: scoring, deduplication, enrichment, updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from changelens.functions.text import risk_band
from changelens.operators import findings as L
from changelens.operators import remedies as M
from changelens.operators import scoring as Q
from changelens.operators.rules import SOC2_CONTROLS
from changelens.plans.sqlbase import CTES, any_of, pick, q, query
from changelens.sources import views as V

QUERIES, ORACLES = {}, {}
_ORDER = ["emit_seq", "finding_id"]


def _values(rows):
    return ", ".join("(" + ", ".join(q(v) for v in row) + ")" for row in rows)


# --------------------------------------------------------------------------- enrichment in SQL
_KIND = "CASE " + " ".join(
    f"WHEN contains(lower(title), {q(k)}) OR contains(lower(coalesce(description, '')), {q(k)}) THEN {q(t)}" for k, t in M.PATCH_KEYWORDS) + " END"
CTES["patches"] = f"""
SELECT *, '--- a/vulnerable_code' || chr(10) || '+++ b/fixed_code' || chr(10) || '@@ -1,' || len(string_split(before, chr(10))) || ' +1,'
  || len(string_split(after, chr(10))) || ' @@' || chr(10) || '-' || replace(before, chr(10), chr(10) || '-') || chr(10) || '+' || replace(after, chr(10), chr(10) || '+') AS diff_text
FROM (VALUES {_values(M.PATCHES)}) t(kind, before, after, explanation)"""
CTES["explanations"] = f"SELECT * FROM (VALUES {_values(M.EXPLANATIONS)}) t(cwe, name, impact_text, attack, business)"
CTES["libraries"] = "SELECT * FROM (VALUES " + _values(
    (t, l, ";".join(v)) for t, by in M.SAFER_LIBRARIES.items() for l, v in by.items()) + ") t(kind, lang, libs)"
CTES["f_enriched"] = f"""
SELECT f.* EXCLUDE (suggestion, kind), CASE WHEN deep AND p.kind IS NOT NULL THEN coalesce(f.suggestion, '') || chr(10) || chr(10) || '**Fixed Code:**' || chr(10) || '```' || chr(10)
    || p.after || chr(10) || '```' || chr(10) || chr(10) || '**Explanation:** ' || p.explanation ELSE f.suggestion END AS suggestion,
  CASE WHEN deep THEN p.diff_text END AS patch, CASE WHEN deep THEN coalesce(l.libs, '') END AS safer_libraries,
  CASE WHEN deep THEN coalesce(x.attack, {q(M.DEFAULT_EXPLANATION[1])}) END AS attack_scenario,
  CASE WHEN deep THEN coalesce(x.business, {q(M.DEFAULT_EXPLANATION[2])}) END AS business_impact,
  CASE WHEN deep THEN coalesce(x.impact_text, {q(M.DEFAULT_EXPLANATION[0])}) END AS impact
FROM (SELECT *, {_KIND} AS kind, score_pts >= 30 AND severity IN ('critical', 'high') AS deep FROM f_raw) f
LEFT JOIN patches p ON f.kind = p.kind LEFT JOIN explanations x ON f.cwe_id = x.cwe LEFT JOIN libraries l ON f.kind = l.kind AND l.lang = 'python'"""


# --------------------------------------------------------------------------- scores
QUERIES["q3_risk_bands"] = lambda spark, sf: V.pr_facts(spark, sf).groupBy(
    risk_band(F.col("risk_score")).alias("band")).agg(F.count("*").alias("prs"))
ORACLES["q3_risk_bands"] = query("""
SELECT CASE WHEN risk_score > 0.7 THEN 'red' WHEN risk_score > 0.3 THEN 'amber' ELSE 'green' END AS band, count(*) AS prs FROM pr_facts GROUP BY 1""")
QUERIES["q4_confidence_filter"] = lambda spark, sf: Q.confident(V.finding_facts(spark, sf)).groupBy("severity").agg(
    F.count("*").alias("kept"), F.round(F.min("confidence_score"), 3).alias("lowest"))
ORACLES["q4_confidence_filter"] = query("""
SELECT severity, count(*) AS kept, round(min(confidence_score), 3) AS lowest FROM finding_facts WHERE coalesce(confidence_score, 0.8) >= 0.4 GROUP BY 1""")

_IN_TEST, _IN_EXAMPLE = any_of("lower(coalesce(file_path, ''))", Q.TEST_PATHS), any_of("lower(coalesce(file_path, ''))", Q.EXAMPLE_PATHS)
_CRED = f"({any_of('lower(code_snippet)', Q.CREDENTIAL_WORDS)} AND contains(lower(description), 'hardcoded'))"
_VAGUE = "(contains(lower(description), 'may') AND contains(lower(description), 'possibly'))"
CTES["quality"] = f"""
SELECT * EXCLUDE (s1, s2, s3), round(CASE WHEN {_VAGUE} THEN s3 * 0.7::DOUBLE ELSE s3 END, 3) AS quality_score, {_IN_TEST} AND s1 < 0.5 AS is_likely_false_positive,
  CASE WHEN {_VAGUE} THEN 'Uncertain language in description reduces confidence' WHEN {_CRED} THEN 'High confidence: hardcoded credential pattern'
    WHEN {_IN_EXAMPLE} THEN 'Finding in example/sample file' WHEN {_IN_TEST} THEN 'Finding in test file - may be intentional test code' ELSE 'Heuristic evaluation' END AS reasoning,
  CASE WHEN cwe_id = '' THEN 'Name the unsafe call.' ELSE '' END AS suggested_revision
FROM (SELECT *, CASE WHEN {_CRED} THEN least(1.0::DOUBLE, s2 * 1.2::DOUBLE) ELSE s2 END AS s3
  FROM (SELECT *, CASE WHEN {_IN_EXAMPLE} THEN s1 * 0.6::DOUBLE ELSE s1 END AS s2
    FROM (SELECT *, CASE WHEN {_IN_TEST} THEN confidence_score * 0.5::DOUBLE ELSE confidence_score END AS s1 FROM finding_facts)))"""


def _scored(spark, sf):
    return Q.quality_score(V.finding_facts(spark, sf)).withColumn(
        "suggested_revision", F.when(F.col("cwe_id") == "", "Name the unsafe call.").otherwise(""))


QUERIES["q5_quality_score"] = lambda spark, sf: _scored(spark, sf).groupBy("quality_score", "is_likely_false_positive", "reasoning").agg(F.count("*").alias("findings"))
ORACLES["q5_quality_score"] = query("SELECT quality_score, is_likely_false_positive, reasoning, count(*) AS findings FROM quality GROUP BY ALL")
QUERIES["q6_reflection_rate"] = lambda spark, sf: Q.reflection_rates(_scored(spark, sf), "category")
ORACLES["q6_reflection_rate"] = query("""
SELECT category, count(*) AS original_count, count(*) FILTER (is_likely_false_positive OR quality_score < 0.4) AS filtered_count,
  round(count(*) FILTER (is_likely_false_positive OR quality_score < 0.4) / count(*), 4) AS false_positive_rate FROM quality GROUP BY category""")
QUERIES["q6_reflection_filter"] = lambda spark, sf: Q.reflect(_scored(spark, sf)).groupBy("description").agg(
    F.count("*").alias("kept"), F.sum(F.round(F.col("confidence_score") * 1000).cast("bigint")).alias("score_points"))
ORACLES["q6_reflection_filter"] = query("""
SELECT CASE WHEN suggested_revision <> '' AND quality_score < 0.7 THEN description || chr(10) || chr(10) || '**Reviewer Note:** ' || suggested_revision ELSE description END AS description,
  count(*) AS kept, sum(round(quality_score * 1000)::BIGINT)::BIGINT AS score_points FROM quality WHERE NOT (is_likely_false_positive OR quality_score < 0.4) GROUP BY 1""")
QUERIES["q7_heuristic_evaluation"] = lambda spark, sf: Q.heuristic_evaluation(V.finding_facts(spark, sf)).groupBy(
    "quality_score", "false_positive_likelihood", "method").agg(F.count("*").alias("findings"))
_S = "confidence_score"
for _test in ("cwe_id <> ''", "code_snippet <> ''", "length(suggestion) > 50"):
    _S = f"(CASE WHEN {_test} THEN least(1.0::DOUBLE, {_S} + 0.05::DOUBLE) ELSE {_S} END)"
_S = f"(CASE WHEN length(description) < 50 THEN {_S} * 0.8::DOUBLE ELSE {_S} END)"
ORACLES["q7_heuristic_evaluation"] = query(f"""
SELECT round({_S}, 3) AS quality_score, round(1 - {_S}, 3) AS false_positive_likelihood, 'heuristic' AS method, count(*) AS findings FROM finding_facts GROUP BY ALL""")


def judge_replies(spark, sf):
    """Stored judge replies: assistant turns with a JSON verdict in the text."""
    c, t = F.col("conv_id"), F.col("turn")
    verdict = F.to_json(F.struct(
        F.when(c % 3 != 0, (c % 10) / 10).alias("accuracy"), F.when(t % 2 == 1, (t % 10) / 10).alias("severity_appropriate"),
        ((c + t) % 10 / 10).alias("actionability"), F.when(c % 4 != 0, (c % 5) / 10).alias("fp_likelihood")))
    return V.table(spark, sf, "conversations").filter("role = 'assistant'").select(
        "conv_id", "turn", F.when(c % 7 == 0, F.col("text")).when(c % 7 == 1, F.concat("text", F.lit(' {"accuracy": 0.9, oops}'))).otherwise(
            F.concat("text", F.lit("\nVerdict: "), verdict, F.lit(" done."))).alias("reply"),
        ((t % 10) / 10).alias("confidence_score"), F.when(c % 2 == 0, "CWE-89").alias("cwe_id"), F.col("text").alias("description"))


QUERIES["q8_judge_scores"] = lambda spark, sf: Q.judged_evaluation(judge_replies(spark, sf)).drop("reply", "confidence_score", "cwe_id", "description")
ORACLES["q8_judge_scores"] = query("""
SELECT conv_id, turn, CASE WHEN conv_id % 7 < 2 THEN round(plain, 3) ELSE round(coalesce(CASE WHEN conv_id % 3 <> 0 THEN (conv_id % 10) / 10.0::DOUBLE END, 0.7::DOUBLE) * 0.4::DOUBLE
    + coalesce(CASE WHEN turn % 2 = 1 THEN (turn % 10) / 10.0::DOUBLE END, 0.7::DOUBLE) * 0.2::DOUBLE + ((conv_id + turn) % 10) / 10.0::DOUBLE * 0.4::DOUBLE, 3) END AS quality_score,
  CASE WHEN conv_id % 7 < 2 THEN round(1 - plain, 3) WHEN conv_id % 4 <> 0 THEN (conv_id % 5) / 10.0::DOUBLE ELSE 0.2::DOUBLE END AS false_positive_likelihood,
  CASE WHEN conv_id % 7 < 2 THEN 'heuristic' ELSE 'llm_judge' END AS method
FROM (SELECT *, CASE WHEN length(text) < 50 THEN given * 0.8::DOUBLE ELSE given END AS plain FROM (
  SELECT *, CASE WHEN conv_id % 2 = 0 THEN least(1.0::DOUBLE, (turn % 10) / 10.0::DOUBLE + 0.05::DOUBLE) ELSE (turn % 10) / 10.0::DOUBLE END AS given
  FROM conversations WHERE role = 'assistant'))""")

# --------------------------------------------------------------------------- enrichment
QUERIES["q9_patch_lookup"] = lambda spark, sf: M.with_patch(V.finding_facts(spark, sf)).groupBy(
    "title", "vulnerability_type", "patch_available", "patch_explanation").agg(F.count("*").alias("findings"))
ORACLES["q9_patch_lookup"] = query(f"""
SELECT title, coalesce(f.kind, 'unknown') AS vulnerability_type, p.kind IS NOT NULL AS patch_available,
  CASE WHEN p.kind IS NOT NULL THEN p.explanation WHEN suggestion <> '' THEN suggestion ELSE description END AS patch_explanation, count(*) AS findings
FROM (SELECT *, {_KIND} AS kind FROM finding_facts) f LEFT JOIN patches p ON f.kind = p.kind GROUP BY ALL""")
QUERIES["q10_unified_diff"] = lambda spark, sf: M.with_patch(V.finding_facts(spark, sf)).filter("patch_available").groupBy(
    "vulnerability_type", "patch").agg(F.count("*").alias("findings"))
ORACLES["q10_unified_diff"] = query(f"""
SELECT f.kind AS vulnerability_type, p.diff_text AS patch, count(*) AS findings
FROM (SELECT *, {_KIND} AS kind FROM finding_facts) f JOIN patches p ON f.kind = p.kind GROUP BY ALL""")
QUERIES["q11_enrichment"] = lambda spark, sf: M.enrich(V.finding_facts(spark, sf)).groupBy(
    "severity", "suggestion", "patch", F.array_join("safer_libraries", ";").alias("safer_libraries"), "attack_scenario", "business_impact").agg(F.count("*").alias("findings"))
ORACLES["q11_enrichment"] = query(CTES["f_enriched"].join(["SELECT severity, suggestion, patch, safer_libraries, attack_scenario, business_impact, count(*) AS findings FROM (", ") GROUP BY ALL"])
                                  .replace("score_pts >= 30 AND ", "").replace("FROM f_raw", "FROM finding_facts"))
QUERIES["j4_weakness_explanations"] = lambda spark, sf: M.with_explanation(V.finding_facts(spark, sf)).groupBy(
    "cwe_id", "vulnerability_name", "impact", "attack_scenario", "business_impact").agg(F.count("*").alias("findings"))
ORACLES["j4_weakness_explanations"] = query(f"""
SELECT cwe_id, coalesce(name, title) AS vulnerability_name, coalesce(impact_text, {q(M.DEFAULT_EXPLANATION[0])}) AS impact,
  coalesce(attack, {q(M.DEFAULT_EXPLANATION[1])}) AS attack_scenario, coalesce(business, {q(M.DEFAULT_EXPLANATION[2])}) AS business_impact, count(*) AS findings
FROM finding_facts LEFT JOIN explanations ON cwe_id = cwe GROUP BY ALL""")
_TYPES, _LANGS = ("SQL Injection", "weak-crypto", "XSS", "ssrf", "Weak_Random", "unheard of"), ("Python", "java", "go")
QUERIES["j5_safer_libraries"] = lambda spark, sf: V.table(spark, sf, "part").select(
    V._pick(_TYPES, F.col("p_partkey")).alias("kind"), V._pick(_LANGS, F.col("p_size")).alias("lang")).select(
    "kind", "lang", F.array_join(M.safer_libraries(F.col("kind"), F.col("lang")), ";").alias("libs")).groupBy("kind", "lang", "libs").agg(F.count("*").alias("uses"))
ORACLES["j5_safer_libraries"] = query(f"""
SELECT t.kind, t.lang, coalesce(a.libs, b.libs, '') AS libs, count(*) AS uses
FROM (SELECT {pick(_TYPES, "p_partkey")} AS kind, {pick(_LANGS, "p_size")} AS lang FROM part) t
LEFT JOIN libraries a ON a.kind = replace(replace(lower(t.kind), ' ', '_'), '-', '_') AND a.lang = lower(t.lang)
LEFT JOIN libraries b ON b.kind = replace(replace(lower(t.kind), ' ', '_'), '-', '_') AND b.lang = 'python' GROUP BY ALL""")
_CONTROL_IDS = (*SOC2_CONTROLS, "CC5.5")
QUERIES["j6_control_names"] = lambda spark, sf: V.table(spark, sf, "part").select(
    V._pick(_CONTROL_IDS, F.col("p_partkey")).alias("control_id")).select(
    "control_id", M.control_name(F.col("control_id")).alias("control_name")).groupBy("control_id", "control_name").agg(F.count("*").alias("uses"))
ORACLES["j6_control_names"] = query(f"""
SELECT control_id, coalesce(m.name, 'Unknown') AS control_name, count(*) AS uses FROM (SELECT {pick(_CONTROL_IDS, "p_partkey")} AS control_id FROM part)
LEFT JOIN (VALUES {_values(SOC2_CONTROLS.items())}) m(id, name) ON control_id = m.id GROUP BY ALL""")

# --------------------------------------------------------------------------- append, deduplicate, delete
QUERIES["s5_storable_findings"] = lambda spark, sf: L.storable(
    V.finding_facts(spark, sf).withColumns({
        "title": F.when(F.col("line_start") == 10, "").otherwise(F.repeat("title", 40)),
        "severity": F.when(F.col("severity") != "info", F.col("severity")),
        "confidence_score": F.when(F.col("confidence_score") > 0.3, F.col("confidence_score"))}), title_length=500).groupBy("severity", "title").agg(
    F.count("*").alias("stored"), F.sum(F.round(F.col("confidence_score") * 100).cast("bigint")).alias("confidence_points"))
ORACLES["s5_storable_findings"] = query("""
SELECT CASE WHEN severity <> 'info' THEN severity ELSE 'medium' END AS severity, substr(repeat(title, 40), 1, 500) AS title, count(*) AS stored,
  sum(round(CASE WHEN confidence_score > 0.3 THEN confidence_score ELSE 0.8::DOUBLE END * 100)::BIGINT)::BIGINT AS confidence_points
FROM finding_facts WHERE line_start IS DISTINCT FROM 10 GROUP BY ALL""")
QUERIES["w4_first_wins"] = lambda spark, sf: L.first_wins(V.finding_facts(spark, sf), L.orchestrator_key(50), _ORDER).select("finding_id")
ORACLES["w4_first_wins"] = query("""
SELECT finding_id FROM (SELECT *, row_number() OVER (PARTITION BY pr_id, file_path, line_start, substr(title, 1, 50) ORDER BY emit_seq, finding_id) AS n FROM finding_facts) WHERE n = 1""")
QUERIES["w5_first_wins_service_key"] = lambda spark, sf: L.first_wins(V.finding_facts(spark, sf), L.service_key(title_length=40), _ORDER).select("finding_id")
ORACLES["w5_first_wins_service_key"] = query("""
SELECT finding_id FROM (SELECT *, row_number() OVER (PARTITION BY pr_id, file_path, line_start, lower(substr(title, 1, 40)) ORDER BY emit_seq, finding_id) AS n FROM finding_facts) WHERE n = 1""")
QUERIES["w5_first_wins_reflection_key"] = lambda spark, sf: L.first_wins(
    Q.reflect(_scored(spark, sf)), L.service_key("", 40), _ORDER).groupBy("pr_id").agg(F.count("*").alias("kept"))
ORACLES["w5_first_wins_reflection_key"] = query("""
SELECT pr_id, count(*) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY pr_id, coalesce(file_path, ''), line_start, lower(substr(title, 1, 40)) ORDER BY emit_seq, finding_id) AS n
  FROM quality WHERE NOT (is_likely_false_positive OR quality_score < 0.4)) WHERE n = 1 GROUP BY pr_id""")


def _split(spark, sf):
    facts = V.finding_facts(spark, sf)
    return facts.filter("created_at >= '1998-01-01'"), facts.filter("created_at < '1998-01-01'")


QUERIES["j7_new_minus_existing"] = lambda spark, sf: L.unseen(*_split(spark, sf), _ORDER, title_length=40).select("finding_id")
ORACLES["j7_new_minus_existing"] = query("""
SELECT finding_id FROM (SELECT *, row_number() OVER (PARTITION BY pr_id, file_path, line_start, lower(substr(title, 1, 40)) ORDER BY emit_seq, finding_id) AS n
  FROM finding_facts f WHERE created_at >= '1998-01-01' AND NOT EXISTS (SELECT 1 FROM finding_facts e WHERE e.created_at < '1998-01-01' AND e.pr_id = f.pr_id
    AND e.file_path IS NOT DISTINCT FROM f.file_path AND e.line_start IS NOT DISTINCT FROM f.line_start AND lower(substr(e.title, 1, 40)) = lower(substr(f.title, 1, 40)))) WHERE n = 1""")
QUERIES["u3_except_existing_prs"] = lambda spark, sf: L.only_in(*_split(spark, sf))
ORACLES["u3_except_existing_prs"] = query("""
SELECT pr_id FROM finding_facts WHERE created_at >= '1998-01-01' EXCEPT SELECT pr_id FROM finding_facts WHERE created_at < '1998-01-01'""")


def _cascade(spark, sf):
    kept, gone = L.delete_changes(V.finding_facts(spark, sf), V.pr_facts(spark, sf).filter("status = 'failed'"))
    count = lambda df, name: df.groupBy("severity").agg(F.count("*").alias(name))
    return count(kept, "kept").join(count(gone, "removed"), "severity", "full_outer").select(
        "severity", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("removed", F.lit(0)).alias("removed"))


QUERIES["j8_cascade_delete"] = _cascade
ORACLES["j8_cascade_delete"] = query("""
SELECT severity, count(*) FILTER (NOT gone) AS kept, count(*) FILTER (gone) AS removed
FROM (SELECT severity, pr_id IN (SELECT pr_id FROM pr_facts WHERE status = 'failed') AS gone FROM finding_facts) GROUP BY severity""")

# --------------------------------------------------------------------------- updates


def pr_updates(spark, sf):
    """Status updates of pull requests, several per request, from the events."""
    e = F.col("event_id")
    return V.table(spark, sf, "events").select(
        (e % 5000).alias("pr_id"), e.alias("seq"), F.when(e % 3 != 0, V._pick(("queued", "reviewing", "completed"), e)).alias("status"),
        F.when(e % 4 == 0, (e % 100) / 100).alias("risk_score"))


QUERIES["f12_patch_rows"] = lambda spark, sf: L.patch_rows(
    V.pr_facts(spark, sf), pr_updates(spark, sf), "pr_id", ["status", "risk_score"], "seq").select("pr_id", "status", "risk_score")
ORACLES["f12_patch_rows"] = query(f"""
SELECT p.pr_id, coalesce(u.status, p.status) AS status, coalesce(u.risk_score, p.risk_score) AS risk_score FROM pr_facts p LEFT JOIN (
  SELECT event_id % 5000 AS pr_id,
    arg_max({pick(("queued", "reviewing", "completed"), "event_id")}, event_id) FILTER (event_id % 3 <> 0) AS status,
    arg_max((event_id % 100) / 100.0::DOUBLE, event_id) FILTER (event_id % 4 = 0) AS risk_score FROM events GROUP BY 1
  ) u ON p.pr_id = u.pr_id""")


def _feedback(spark, sf):
    label = V.table(spark, sf, "labels").select(
        F.col("doc_id").alias("pr_id"), (F.col("quality") == 0).alias("false_positive"),
        F.when(F.col("toxic") == 1, "rude").alias("human_feedback"), F.lit(1).alias("seq"))
    return L.apply_feedback(V.finding_facts(spark, sf), label, "pr_id", [F.desc("seq"), "human_feedback"]).groupBy(
        "false_positive", "human_feedback").agg(F.count("*").alias("findings"))


QUERIES["f12_feedback"] = _feedback
ORACLES["f12_feedback"] = query("""
SELECT CASE WHEN l.doc_id IS NULL THEN f.false_positive ELSE l.quality = 0 END AS false_positive,
  CASE WHEN l.doc_id IS NULL THEN f.human_feedback WHEN l.toxic = 1 THEN 'rude' END AS human_feedback, count(*) AS findings
FROM finding_facts f LEFT JOIN labels l ON f.pr_id = l.doc_id GROUP BY ALL""")
QUERIES["f12_trigger_reviews"] = lambda spark, sf: L.trigger_reviews(
    V.table(spark, sf, "events").select((F.col("event_id") * 2).alias("pr_id"), "event_id"), V.pr_facts(spark, sf)).groupBy("disposition").agg(F.count("*").alias("requests"))
ORACLES["f12_trigger_reviews"] = query("""
SELECT CASE WHEN p.pr_id IS NULL THEN 'not_found' WHEN p.status = 'reviewing' THEN 'conflict' ELSE 'queued' END AS disposition, count(*) AS requests
FROM events e LEFT JOIN pr_facts p ON p.pr_id = e.event_id * 2 GROUP BY 1""")
QUERIES["w7_latest_per_key"] = lambda spark, sf: L.latest_per_key(pr_updates(spark, sf), ["pr_id"], [F.desc("seq")]).select("pr_id", "seq", "status")
ORACLES["w7_latest_per_key"] = query(f"""
SELECT pr_id, seq, CASE WHEN seq % 3 <> 0 THEN {pick(("queued", "reviewing", "completed"), "seq")} END AS status
FROM (SELECT event_id % 5000 AS pr_id, max(event_id) AS seq FROM events GROUP BY 1)""")
QUERIES["w6_top_per_group"] = lambda spark, sf: L.top_per_group(
    V.finding_facts(spark, sf), ["category"], [F.desc("confidence_score"), "finding_id"], 20).select("category", F.col("rank").cast("bigint"), "finding_id")
ORACLES["w6_top_per_group"] = query("""
SELECT category, rank, finding_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY confidence_score DESC, finding_id) AS rank FROM finding_facts) WHERE rank <= 20""")
QUERIES["f9_pr_highlights"] = lambda spark, sf: L.highlights(V.finding_facts(spark, sf)).select("pr_id", F.col("highlight").cast("bigint"), "finding_id", "severity")
ORACLES["f9_pr_highlights"] = query("""
SELECT pr_id, n AS highlight, finding_id, severity FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY severity = 'high', emit_seq, finding_id) AS n
  FROM finding_facts WHERE severity IN ('critical', 'high')) WHERE n <= 3""")


def _finished(spark, sf):
    """Reviews of two in three pull requests, one in ten of them failed."""
    prs, key = V.pr_facts(spark, sf), F.col("pr_id")
    begun = F.col("created_at").cast("timestamp")
    outcomes = prs.filter(key % 3 != 0).select(
        "pr_id", ((key % 100) / 100).alias("risk_score"), (key % 10).cast("int").alias("steps_taken"), begun.alias("started_at"),
        F.timestamp_seconds(F.unix_seconds(begun) + key % 600).alias("completed_at"), F.when(key % 10 == 0, F.repeat(F.lit("rate limit "), 120)).alias("error"))
    return L.finish_reviews(prs, outcomes, V.finding_facts(spark, sf), error_length=1000)


QUERIES["f12_review_results"] = lambda spark, sf: _finished(spark, sf)[0].select(
    "pr_id", "status", "risk_score", F.date_format("reviewed_at", "yyyy-MM-dd HH:mm:ss").alias("reviewed_at"))
ORACLES["f12_review_results"] = query("""
SELECT pr_id, CASE WHEN pr_id % 3 = 0 THEN status WHEN pr_id % 10 = 0 THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN pr_id % 3 <> 0 AND pr_id % 10 <> 0 THEN (pr_id % 100) / 100.0::DOUBLE ELSE risk_score END AS risk_score,
  CASE WHEN pr_id % 3 <> 0 AND pr_id % 10 <> 0 THEN strftime(created_at::TIMESTAMP + to_seconds(pr_id % 600), '%Y-%m-%d %H:%M:%S') END AS reviewed_at FROM pr_facts""")
QUERIES["f12_review_runs"] = lambda spark, sf: _finished(spark, sf)[1].select(
    "pr_id", "agent_type", "status", F.col("steps_taken").cast("bigint"), "findings_count", "duration_seconds", "error_message")
ORACLES["f12_review_runs"] = query("""
SELECT pr_id, 'orchestrator' AS agent_type, CASE WHEN pr_id % 10 = 0 THEN 'failed' ELSE 'completed' END AS status, pr_id % 10 AS steps_taken,
  CASE WHEN pr_id % 10 = 0 THEN 0 ELSE coalesce(n, 0) END AS findings_count, (pr_id % 600)::DOUBLE AS duration_seconds,
  CASE WHEN pr_id % 10 = 0 THEN substr(repeat('rate limit ', 120), 1, 1000) END AS error_message
FROM pr_facts LEFT JOIN (SELECT pr_id, count(*) AS n FROM finding_facts GROUP BY pr_id) USING (pr_id) WHERE pr_id % 3 <> 0""")


def _own_score(rows):
    """A scorer as a user writes one: a pandas frame of the named columns in, one number per row out."""
    return (rows["confidence_score"] * 1000).round() + rows["description"].str.contains("hardcoded") * 100


QUERIES["p3_user_scorer"] = lambda spark, sf: Q.user_scored(
    V.finding_facts(spark, sf), _own_score, ["confidence_score", "description"], "points").groupBy("severity").agg(F.sum("points").alias("points"), F.count("*").alias("findings"))
ORACLES["p3_user_scorer"] = query("""
SELECT severity, sum(round(confidence_score * 1000) + CASE WHEN contains(description, 'hardcoded') THEN 100 ELSE 0 END)::DOUBLE AS points, count(*) AS findings
FROM finding_facts GROUP BY severity""")
