"""Registered queries: dependency audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from changelens.operators import deps as E
from changelens.plans.sqlbase import CTES, q, query, strip
from changelens.sources import views as V

QUERIES, ORACLES = {}, {}


def advisories(spark, sf):
    """Advisory snapshot, one per part: exact version and score entries."""
    p = F.col("p_partkey")
    entry = lambda kind, score: F.struct(F.lit(kind).alias("type"), score.alias("score"))
    size = F.col("p_size").cast("string")
    return V.table(spark, sf, "part").select(
        F.when(p % 4 == 1, "npm").when(p % 4 == 2, "Go").otherwise("PyPI").alias("ecosystem"),
        F.concat(F.when(p % 4 == 2, "example.org/pkg-").otherwise("pkg-"), (p % 37).cast("string")).alias("name"),
        F.concat(F.when(p % 4 == 3, "==").otherwise(""), F.concat_ws(".", (p % 3).cast("string"), (p % 10).cast("string"), (p % 7).cast("string"))).alias("version"),
        F.concat(F.lit("ADV-"), p.cast("string")).alias("id"), F.col("p_name").alias("summary"),
        F.when(p % 5 == 0, F.array().cast("array<struct<type:string,score:string>>"))
        .when(p % 5 == 1, F.array(entry("CVSS_V3", F.concat((p % 10).cast("string"), F.lit(".5")))))
        .when(p % 5 == 2, F.array(entry("CVSS_V3", F.lit("CVSS:3.1/AV:N/AC:L"))))
        .when(p % 5 == 3, F.array(entry("OTHER", F.lit("9.9"))))
        .otherwise(F.array(entry("OTHER", F.lit("x")), entry("CVSS_V2", size))).alias("severity"),
        F.when(p % 7 == 0, F.array().cast("array<string>")).otherwise(
            F.array(F.concat(F.lit("CVE-"), p.cast("string")), F.concat(F.lit("GHSA-"), (p % 100).cast("string")))).alias("aliases"),
    )


def advisory_ranges(spark, sf):
    """Advisory version ranges, one per part; every fourth has no fix."""
    p = F.col("p_partkey")
    return V.table(spark, sf, "part").select(
        F.when(p % 4 == 1, "npm").when(p % 4 == 2, "Go").otherwise("PyPI").alias("ecosystem"),
        F.concat(F.when(p % 4 == 2, "example.org/pkg-").otherwise("pkg-"), (p % 37).cast("string")).alias("name"),
        F.concat(F.lit("ADV-"), p.cast("string")).alias("id"),
        F.concat_ws(".", (p % 3).cast("string"), (p % 10).cast("string")).alias("introduced"),
        F.when(p % 4 != 0, F.concat((p % 3 + 1).cast("string"), F.lit(".0"))).alias("fixed"))


def packages(spark, sf):
    """Packages with a licence read from the document text where it names one."""
    text, d = F.col("text"), F.col("doc_id")
    return V.table(spark, sf, "documents").select(
        F.col("source").alias("project"), F.concat(F.lit("pkg-"), d.cast("string")).alias("package"),
        F.when(text.contains("Apache License"), "Apache-2.0").when(text.contains("MIT License"), "MIT")
        .when(text.contains("GNU General Public License"), "GPL-3.0")
        .when(d % 6 == 0, "AGPL-3.0").when(d % 6 == 2, "SSPL-1.0").when(d % 6 == 3, "GPL-2.0").when(d % 6 == 4, "BSD-3-Clause").when(d % 6 == 5, "MIT").alias("license"))


CTES["deps"] = f"""
SELECT * FROM (SELECT pr_id, diff_line, file, k,
  CASE k WHEN 'requirements' THEN regexp_extract(t, {q(E.REQUIREMENT)}, 1) WHEN 'package.json' THEN regexp_extract(t, {q(E.NODE_PACKAGE)}, 1)
    WHEN 'go.mod' THEN regexp_extract(t, {q(E.GO_REQUIRE)}, 1) ELSE regexp_extract(t, {q(E.PIPFILE)}, 1) END AS name,
  CASE WHEN k = 'requirements' THEN regexp_extract(t, {q(E.REQUIREMENT)}, 2) END AS operator,
  CASE k WHEN 'requirements' THEN split_part(regexp_extract(t, {q(E.REQUIREMENT)}, 3), ',', 1) WHEN 'package.json' THEN regexp_extract(t, {q(E.NODE_PACKAGE)}, 2)
    WHEN 'go.mod' THEN regexp_extract(t, {q(E.GO_REQUIRE)}, 2) ELSE replace(regexp_extract(t, {q(E.PIPFILE)}, 2), '*', 'latest') END AS version,
  CASE k WHEN 'package.json' THEN 'npm' WHEN 'go.mod' THEN 'Go' ELSE 'PyPI' END AS ecosystem
FROM (SELECT pr_id, diff_line, {strip("diff_file")} AS file, {strip("code")} AS t,
  CASE WHEN contains(diff_file, 'requirements') OR ends_with(diff_file, '.txt') THEN 'requirements' WHEN contains(diff_file, 'package.json') THEN 'package.json'
    WHEN contains(diff_file, 'go.mod') THEN 'go.mod' WHEN contains(diff_file, 'Pipfile') THEN 'Pipfile' END AS k FROM added WHERE code_no IS NOT NULL)
WHERE k IS NOT NULL) WHERE name <> ''"""
CTES["advisories"] = """
SELECT CASE p_partkey % 4 WHEN 1 THEN 'npm' WHEN 2 THEN 'Go' ELSE 'PyPI' END AS ecosystem,
  CASE p_partkey % 4 WHEN 2 THEN 'example.org/pkg-' ELSE 'pkg-' END || (p_partkey % 37) AS name,
  CASE p_partkey % 4 WHEN 3 THEN '==' ELSE '' END || (p_partkey % 3) || '.' || (p_partkey % 10) || '.' || (p_partkey % 7) AS version,
  'ADV-' || p_partkey AS id, p_name AS summary,
  CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'CVE-' || p_partkey || ', GHSA-' || (p_partkey % 100) END AS aliases,
  CASE p_partkey % 5 WHEN 0 THEN 'unknown' WHEN 3 THEN 'medium' ELSE
    CASE WHEN contains(substr(score, 1, 3), '9') OR contains(substr(score, 1, 4), '10') THEN 'critical'
      WHEN regexp_matches(substr(score, 1, 3), '[78]') THEN 'high' WHEN regexp_matches(substr(score, 1, 3), '[456]') THEN 'medium' ELSE 'low' END END AS severity,
  p_partkey
FROM (SELECT *, CASE p_partkey % 5 WHEN 1 THEN (p_partkey % 10) || '.5' WHEN 2 THEN 'CVSS:3.1/AV:N/AC:L' ELSE p_size::VARCHAR END AS score FROM part)"""
_DEP_TAIL = """NULL::BIGINT AS line_start, d.name || '==' || d.version AS code_snippet"""
CTES["f_advisory"] = f"""
SELECT d.pr_id, 'dependency' AS agent_type, a.severity, 'dependency' AS category, 'CVE in ' || d.name || ' ' || d.version || ': ' || a.id AS title,
  'Package ' || d.name || ' version ' || d.version || ' has a known vulnerability: ' || coalesce(a.summary, '') || '. CVE ID: ' || a.id || '. Aliases: ' || a.aliases AS description,
  d.file AS file_path, {_DEP_TAIL}, 'Upgrade ' || d.name || ' to a version that patches ' || a.id AS suggestion, 0.95::DOUBLE AS confidence_score,
  NULL::VARCHAR AS cwe_id, NULL::VARCHAR AS owasp_category, 'advisory-' || a.id AS rule_id, d.diff_line, d.file AS diff_file,
  (30 * 10000000000000000 + d.diff_line * 100000000)::BIGINT AS emit_seq, 'advisory' AS pack
FROM deps d JOIN advisories a USING (ecosystem, name, version)"""
CTES["f_stale"] = f"""
SELECT d.pr_id, 'dependency' AS agent_type, 'low' AS severity, 'dependency' AS category, 'Potentially outdated: ' || d.name || ' ' || d.version AS title,
  'Pre-1.0 version - may be unstable' AS description, 'dependency file' AS file_path, {_DEP_TAIL},
  'Consider upgrading to the latest stable version' AS suggestion, 0.6::DOUBLE AS confidence_score, NULL::VARCHAR AS cwe_id, NULL::VARCHAR AS owasp_category,
  'stale-version' AS rule_id, d.diff_line, d.file AS diff_file, (31 * 10000000000000000 + d.diff_line * 100000000)::BIGINT AS emit_seq, 'stale' AS pack
FROM deps d WHERE try_cast(split_part(version, '.', 1) AS INT) = 0"""


def _deps(spark, sf):
    return E.manifest_dependencies(V.changes(spark, sf).select("pr_id", "diff"))


QUERIES["e1_manifest_dependencies"] = lambda spark, sf: _deps(spark, sf).withColumn("diff_line", F.col("diff_line").cast("bigint"))
ORACLES["e1_manifest_dependencies"] = query("SELECT pr_id, diff_line, file, name, operator, version, ecosystem FROM deps")
_SHOWN = ("pr_id", "severity", "title", "description", "file_path", "code_snippet", "suggestion", "confidence_score", "rule_id", "emit_seq")
QUERIES["e2_stale_versions"] = lambda spark, sf: E.stale_findings(_deps(spark, sf)).select(*_SHOWN)
ORACLES["e2_stale_versions"] = query(f"SELECT {', '.join(_SHOWN)} FROM f_stale")
QUERIES["j2_dependency_advisories"] = lambda spark, sf: E.advisory_findings(_deps(spark, sf), advisories(spark, sf)).select(*_SHOWN)
ORACLES["j2_dependency_advisories"] = query(f"SELECT {', '.join(_SHOWN)} FROM f_advisory")
QUERIES["x13_advisory_severity"] = lambda spark, sf: advisories(spark, sf).groupBy(E.advisory_severity(F.col("severity")).alias("level")).agg(
    F.count("*").alias("advisories"))
ORACLES["x13_advisory_severity"] = query("SELECT severity AS level, count(*) AS advisories FROM advisories GROUP BY 1")


def _affected(spark, sf):
    uses = _deps(spark, sf).groupBy("ecosystem", "name", "version").agg(F.count("*").alias("uses"))
    return E.affected_dependencies(uses, advisory_ranges(spark, sf), E.part_key).groupBy("ecosystem", "name", "version").agg(
        F.first("uses").alias("uses"), F.count("*").alias("advisories"), F.min("id").alias("first_id"))


QUERIES["j10_version_range_join"] = _affected
_KEY = "list_transform(string_split({v}, '.'), lambda p: coalesce(try_cast(regexp_extract(p, '^(\\d+)', 1) AS INT), 0))"
ORACLES["j10_version_range_join"] = query(f"""
SELECT d.ecosystem, d.name, d.version, any_value(d.uses) AS uses, count(*) AS advisories, min(r.id) AS first_id
FROM (SELECT ecosystem, name, version, count(*) AS uses, {_KEY.format(v="version")} AS v FROM deps GROUP BY ALL) d
JOIN (SELECT CASE p_partkey % 4 WHEN 1 THEN 'npm' WHEN 2 THEN 'Go' ELSE 'PyPI' END AS ecosystem,
    CASE p_partkey % 4 WHEN 2 THEN 'example.org/pkg-' ELSE 'pkg-' END || (p_partkey % 37) AS name, 'ADV-' || p_partkey AS id,
    [p_partkey % 3, p_partkey % 10] AS introduced, CASE WHEN p_partkey % 4 <> 0 THEN [p_partkey % 3 + 1, 0] END AS fixed FROM part) r
  ON d.ecosystem = r.ecosystem AND d.name = r.name AND d.v >= r.introduced AND (r.fixed IS NULL OR d.v < r.fixed)
GROUP BY 1, 2, 3""")



def odd_versions(spark, sf):
    """Versions of every spelling, one per part, for few packages that have many of them."""
    p = F.col("p_partkey")
    n, minor, number = (p % 3).cast("string"), (p % 5).cast("string"), (p % 4).cast("string")
    shapes = [F.concat_ws(".", n, minor), F.concat_ws(".", n, minor, F.lit("0")), F.concat(F.lit("v"), n, F.lit("."), minor, F.lit(".0.0")), F.concat(n, F.lit("."), minor, F.lit("-rc"), number),
              F.concat(n, F.lit("."), minor, F.lit(".0b"), number), F.concat(n, F.lit("."), minor, F.lit(".post"), number), F.concat(F.lit("202401011234"), number, F.lit("."), minor),
              F.concat(n, F.lit("."), minor, F.lit("+build"), number), F.lit("latest"), F.concat_ws(".", n, minor, number)]
    version = F.element_at(F.array(*shapes), (p % len(shapes)).cast("int") + 1)
    return V.table(spark, sf, "part").select(F.lit("PyPI").alias("ecosystem"), F.concat(F.lit("pkg-"), (p % 2).cast("string")).alias("name"), version.alias("version"))


def odd_ranges(spark, sf):
    """Ranges between such versions, one per supplier; every fifth goes on without end."""
    k = F.col("s_suppkey")
    low = F.when(k % 3 == 0, F.concat((k % 3).cast("string"), F.lit("."), (k % 5).cast("string"), F.lit("-rc2"))).when(k % 3 == 1, F.concat_ws(".", (k % 3).cast("string"), F.lit("0"))).otherwise((k % 3).cast("string"))
    high = F.when(k % 5 == 0, None).when(k % 5 == 1, F.lit("2.4.0")).when(k % 5 == 2, F.lit("20240101123412")).when(k % 5 == 3, F.lit("2.0.0-rc1")).otherwise(F.lit("1.3.post2"))
    return V.table(spark, sf, "supplier").select(F.lit("PyPI").alias("ecosystem"), F.concat(F.lit("pkg-"), (k % 2).cast("string")).alias("name"), F.concat(F.lit("ADV-"), k.cast("string")).alias("id"),
                                                 low.alias("introduced"), high.alias("fixed"))


QUERIES["j10_version_order"] = lambda spark, sf: E.affected_dependencies(odd_versions(spark, sf).distinct(), odd_ranges(spark, sf)).select("name", "version", "id")


def _placed(v):
    """Six whole numbers that order the spellings above: three parts, stage, kind and number of a pre- or post-release."""
    nth = lambda i: f"coalesce(try_cast(list_extract(string_split(regexp_extract({v}, '^v?([0-9.]*[0-9])', 1), '.'), {i}) AS BIGINT), 0)"
    tail = f"regexp_extract({v}, '(rc|b|post)([0-9]+)$', 1)"
    return f"""[{nth(1)}, {nth(2)}, {nth(3)}, CASE WHEN contains({v}, '+') THEN 1 WHEN {tail} IN ('rc', 'b') THEN 0 WHEN {tail} = 'post' THEN 2 ELSE 1 END,
  CASE WHEN contains({v}, '+') THEN 0 WHEN {tail} = 'rc' THEN 4 WHEN {tail} = 'b' THEN 2 ELSE 0 END, CASE WHEN contains({v}, '+') THEN 0 ELSE coalesce(try_cast(regexp_extract({v}, '(rc|b|post)([0-9]+)$', 2) AS BIGINT), 0) END]"""


ORACLES["j10_version_order"] = query(f"""
WITH v AS (SELECT DISTINCT 'pkg-' || (p % 2) AS name, [n || '.' || minor, n || '.' || minor || '.0', 'v' || n || '.' || minor || '.0.0', n || '.' || minor || '-rc' || num, n || '.' || minor || '.0b' || num,
    n || '.' || minor || '.post' || num, '202401011234' || num || '.' || minor, n || '.' || minor || '+build' || num, 'latest', n || '.' || minor || '.' || num][p % 10 + 1] AS version
  FROM (SELECT p_partkey AS p, (p_partkey % 3)::VARCHAR AS n, (p_partkey % 5)::VARCHAR AS minor, (p_partkey % 4)::VARCHAR AS num FROM part)),
r AS (SELECT 'pkg-' || (k % 2) AS name, 'ADV-' || k AS id, CASE k % 3 WHEN 0 THEN (k % 3) || '.' || (k % 5) || '-rc2' WHEN 1 THEN (k % 3) || '.0' ELSE (k % 3)::VARCHAR END AS introduced,
    CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN '2.4.0' WHEN 2 THEN '20240101123412' WHEN 3 THEN '2.0.0-rc1' ELSE '1.3.post2' END AS fixed FROM (SELECT s_suppkey AS k FROM supplier))
SELECT v.name, v.version, r.id FROM v JOIN r USING (name)
WHERE v.version <> 'latest' AND {_placed("v.version")} >= {_placed("r.introduced")} AND (r.fixed IS NULL OR {_placed("v.version")} < {_placed("r.fixed")})""")

CTES["packages"] = """
SELECT source AS project, 'pkg-' || doc_id AS package, CASE WHEN contains(text, 'Apache License') THEN 'Apache-2.0' WHEN contains(text, 'MIT License') THEN 'MIT'
  WHEN contains(text, 'GNU General Public License') THEN 'GPL-3.0' WHEN doc_id % 6 = 0 THEN 'AGPL-3.0' WHEN doc_id % 6 = 2 THEN 'SSPL-1.0'
  WHEN doc_id % 6 = 3 THEN 'GPL-2.0' WHEN doc_id % 6 = 4 THEN 'BSD-3-Clause' WHEN doc_id % 6 = 5 THEN 'MIT' END AS license FROM documents"""
QUERIES["e3_license_issues"] = lambda spark, sf: E.license_issues(packages(spark, sf))
ORACLES["e3_license_issues"] = query("""
SELECT project, package, coalesce(license, 'Unknown') AS license,
  CASE WHEN license IS NULL THEN 'License unknown - manual review required' ELSE license || ' is a restrictive copyleft license' END AS issue,
  CASE WHEN license IS NULL THEN 'low' WHEN license = 'AGPL-3.0' THEN 'high' ELSE 'medium' END AS severity
FROM packages WHERE license IS NULL OR license IN ('GPL-2.0', 'GPL-3.0', 'AGPL-3.0', 'SSPL-1.0', 'Commons Clause')""")
QUERIES["e3_license_totals"] = lambda spark, sf: E.license_totals(packages(spark, sf), "project")
ORACLES["e3_license_totals"] = query("""
SELECT project, count(*) AS total_deps, count(*) FILTER (license IN ('GPL-2.0', 'GPL-3.0', 'AGPL-3.0', 'SSPL-1.0', 'Commons Clause')) AS restrictive,
  count(*) FILTER (license IS NULL) AS unknown FROM packages GROUP BY project""")
QUERIES["e4_license_conflicts"] = lambda spark, sf: E.license_conflicts(packages(spark, sf), "project")
ORACLES["e4_license_conflicts"] = query("""
SELECT DISTINCT a.project, a.license, b.license AS conflicts_with FROM packages a JOIN packages b USING (project)
JOIN (VALUES """ + ", ".join(f"({q(k)}, {q(v)})" for k, vs in E.LICENSE_CONFLICTS.items() for v in vs) + """) m(l, c) ON a.license = m.l AND b.license = m.c""")
