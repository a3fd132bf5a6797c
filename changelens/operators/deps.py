"""Dependency audit: manifests, advisories, stale versions, licences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.functions.text import contains_any, once, strip
from changelens.operators.diffs import added_lines
from changelens.operators.scan import FINDING_COLUMNS, emit_position

# ---------------------------------------------------------------------------
# Manifest line patterns, licence lists.
# ---------------------------------------------------------------------------
REQUIREMENT = r"^([a-zA-Z0-9_\-\.]+)\s*([><=!]+)\s*([0-9][^\s;#]*)"
NODE_PACKAGE = r'^"([a-zA-Z0-9_\-@/\.]+)":\s*"[\^~]?([0-9][^"]*)"'
GO_REQUIRE = r"^require\s+([^\s]+)\s+v([0-9][^\s]*)"
PIPFILE = r"""^([a-zA-Z0-9_\-]+)\s*=\s*["']([^"']+)["']"""
MANIFEST_WORDS = ("requirements", ".txt", "package.json", "go.mod", "Pipfile")
EXACT_VERSION = ("ecosystem", "name", "version")
RESTRICTIVE_LICENSES = ("GPL-2.0", "GPL-3.0", "AGPL-3.0", "SSPL-1.0", "Commons Clause")
LICENSE_CONFLICTS = {
    "GPL-2.0": ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause"],
    "GPL-3.0": ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause"],
    "AGPL-3.0": ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0"],
    "LGPL-2.1": [],
    "LGPL-3.0": [],
}


def manifest_dependencies(changes: DataFrame) -> DataFrame:
    """Dependencies named on added manifest lines; the first file type that fits decides."""
    lines = added_lines(changes.filter(contains_any(F.col("diff"), MANIFEST_WORDS))).filter(F.col("code_no").isNotNull())
    columns = [c for c in changes.columns if c != "diff"]
    path, text = strip(F.col("diff_file")), strip(F.col("code"))
    kind = (
        F.when(path.contains("requirements") | path.endswith(".txt"), "requirements")
        .when(path.contains("package.json"), "package.json").when(path.contains("go.mod"), "go.mod").when(path.contains("Pipfile"), "Pipfile")
    )
    typed = once(
        lines.filter(contains_any(F.col("diff_file"), MANIFEST_WORDS)).select(*columns, "diff_line", "diff_file", "code"),
        file=path, _t=text, _k=kind)
    patterns = {"requirements": (REQUIREMENT, 1, 3), "package.json": (NODE_PACKAGE, 1, 2), "go.mod": (GO_REQUIRE, 1, 2), "Pipfile": (PIPFILE, 1, 2)}

    def pick(group):
        return F.coalesce(*[
            F.when(F.col("_k") == name, F.regexp_extract("_t", pattern, groups[group])) for name, (pattern, *groups) in patterns.items()])

    parsed = once(typed, name=pick(0), _version=pick(1)).filter(F.col("name") != "")
    version = F.col("_version")
    return once(
        parsed,
        operator=F.when(F.col("_k") == "requirements", F.regexp_extract("_t", REQUIREMENT, 2)),
        version=F.when(F.col("_k") == "requirements", F.split_part(version, F.lit(","), F.lit(1)))
        .when(F.col("_k") == "Pipfile", F.replace(version, F.lit("*"), F.lit("latest"))).otherwise(version),
        ecosystem=F.when(F.col("_k") == "package.json", "npm").when(F.col("_k") == "go.mod", "Go").otherwise("PyPI"),
    ).select(*columns, "diff_line", "file", "name", "operator", "version", "ecosystem")


def advisory_severity(entries: Column) -> Column:
    """Severity from an advisory's score entries: the first CVSS entry decides.

    Only the leading characters of the score text are looked at, so a vector
    string such as ``CVSS:3.1/...`` maps to low; see ``numeric_severity``.
    """
    cvss = F.get(F.filter(entries, lambda s: s["type"].contains("CVSS")), F.lit(0))["score"]
    head3, head4 = F.substring(cvss, 1, 3), F.substring(cvss, 1, 4)
    return (
        F.when(F.coalesce(F.size(entries), F.lit(0)) < 1, "unknown")
        .when(F.coalesce(F.size(F.filter(entries, lambda s: s["type"].contains("CVSS"))), F.lit(0)) < 1, "medium")
        .when(head3.contains("9") | head4.contains("10"), "critical")
        .when(contains_any(head3, ("7", "8")), "high").when(contains_any(head3, ("4", "5", "6")), "medium").otherwise("low")
    )


def numeric_severity(entries: Column) -> Column:
    """Severity from the true number, for score entries that hold one."""
    score = F.try_to_number(F.get(F.filter(entries, lambda s: s["type"].contains("CVSS")), F.lit(0))["score"], F.lit("99.9")).cast("double")
    return (
        F.when(score.isNull(), "unknown").when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").otherwise("low")
    )


def _advisory_head() -> Column:
    """What the titles of all findings of an exact version begin with."""
    return F.concat(F.lit("CVE in "), F.col("name"), F.lit(" "), F.col("version"), F.lit(": "))


def _advisory_fields() -> dict[str, Column]:
    """The fields of an advisory's finding that are the same in every change."""
    return {
        "agent_type": F.lit("dependency"), "severity": advisory_severity(F.col("severity")), "category": F.lit("dependency"),
        "title": F.concat(_advisory_head(), F.col("id")),
        "description": F.concat(
            F.lit("Package "), F.col("name"), F.lit(" version "), F.col("version"), F.lit(" has a known vulnerability: "),
            F.coalesce("summary", F.lit("")), F.lit(". CVE ID: "), F.col("id"), F.lit(". Aliases: "),
            F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), ", ")),
        "line_start": F.lit(None).cast("int"), "line_end": F.lit(None).cast("int"), "code_snippet": F.concat_ws("==", "name", "version"),
        "suggestion": F.concat(F.lit("Upgrade "), F.col("name"), F.lit(" to a version that patches "), F.col("id")),
        "confidence_score": F.lit(0.95), "cwe_id": F.lit(None).cast("string"), "owasp_category": F.lit(None).cast("string"),
        "rule_id": F.concat(F.lit("advisory-"), F.col("id")),
    }


def _advisory_place() -> dict[str, Column]:
    """The fields of an advisory's finding that the change gives; several advisories of one dependency share the position, the title breaks the tie."""
    return {"file_path": F.col("file"), "diff_line": F.col("diff_line"), "diff_file": F.col("file"), "emit_seq": emit_position(F.lit(30), F.col("diff_line"), F.lit(0))}


def _carried(dependencies: DataFrame) -> list[str]:
    return [c for c in dependencies.columns if c not in ("diff_line", "file", "name", "operator", "version", "ecosystem")]


def folded_advisories(dependencies: DataFrame, advisories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``advisory_findings`` before its join, as spans and members of ``findings.Folded``, whose key is ``EXACT_VERSION``."""
    named = lambda fields: [v.alias(k) for k, v in fields.items()]
    spans = dependencies.select(*_carried(dependencies), *named(_advisory_place()), _advisory_head().alias("head"), *EXACT_VERSION)
    return spans, advisories.select(*EXACT_VERSION, *named(_advisory_fields()))


def advisory_findings(dependencies: DataFrame, advisories: DataFrame, per_change: int | None = None) -> DataFrame:
    """One finding per dependency and advisory of exactly that version.

    ``per_change`` keeps the first dependencies of a change, as a rate-limited
    lookup would; by default all are checked.
    """
    if per_change is not None:
        first = Window.partitionBy("pr_id").orderBy("diff_line")
        dependencies = dependencies.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= per_change).drop("_n")
    hit = dependencies.join(advisories, [*EXACT_VERSION])
    fields = _advisory_fields() | _advisory_place()
    return hit.select(*_carried(dependencies), *[fields[c].alias(c) for c in (*FINDING_COLUMNS, "diff_line", "diff_file", "emit_seq")])


def stale_findings(dependencies: DataFrame) -> DataFrame:
    """Dependencies still before major version 1."""
    columns = _carried(dependencies)
    stale = dependencies.filter(F.split_part("version", F.lit("."), F.lit(1)).try_cast("int") == 0)
    nothing = F.lit(None).cast("string")
    return stale.select(
        *columns,
        F.lit("dependency").alias("agent_type"), F.lit("low").alias("severity"), F.lit("dependency").alias("category"),
        F.concat(F.lit("Potentially outdated: "), F.col("name"), F.lit(" "), F.col("version")).alias("title"),
        F.lit("Pre-1.0 version - may be unstable").alias("description"), F.lit("dependency file").alias("file_path"),
        F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"),
        F.concat_ws("==", "name", "version").alias("code_snippet"),
        F.lit("Consider upgrading to the latest stable version").alias("suggestion"), F.lit(0.6).alias("confidence_score"),
        nothing.alias("cwe_id"), nothing.alias("owasp_category"), F.lit("stale-version").alias("rule_id"),
        "diff_line", F.col("file").alias("diff_file"),
        emit_position(F.lit(31), F.col("diff_line"), F.lit(0)).alias("emit_seq"),
    )


#: Names of pre-releases in their order, and other spellings of them.
_EARLY = {"dev": "0dev", "snapshot": "0dev", "a": "1a", "alpha": "1a", "b": "2b", "beta": "2b", "m": "3m", "milestone": "3m", "c": "4rc", "rc": "4rc", "pre": "4rc", "preview": "4rc"}


def version_key(version: Column) -> Column:
    """A struct whose order is that of versions; null where the text begins with no number.

    Numeric parts compare by value whatever their length, and missing ones count as zero: 1.0 and 1.0.0 are equal.  Then come pre-releases (a hyphen, or one of the known
    names, with or without separator), the release, post-releases.  Among pre-releases dev, alpha, beta, milestone, rc, then other words by the alphabet; numbers in
    them by value, before words.  A leading v or = and a build after + do not count; any other ending counts as the release.
    """
    text = F.regexp_replace(F.regexp_replace(F.lower(strip(version)), r"^[=v\s]+", ""), r"\+.*$", "")
    release = F.regexp_extract(text, r"^(\d+(?:\.\d+)*)", 1)
    rest = F.substring(text, F.length(release) + 1, F.length(text))
    number = lambda d: F.concat(F.lpad(F.length(F.ltrim(d, F.lit("0"))).cast("string"), 4, "0"), F.ltrim(d, F.lit("0")))
    known = F.create_map(*[F.lit(x) for pair in _EARLY.items() for x in pair])
    parts = F.transform(F.split(F.regexp_replace(release, r"(\.0+)+$", ""), r"\."), number)
    tail = F.transform(F.regexp_extract_all(rest, F.lit(r"(\d+|[a-z]+)"), F.lit(1)), lambda t: F.when(
        t.rlike(r"^\d"), F.concat(F.lit("0"), number(t))).otherwise(F.concat(F.lit("1"), F.coalesce(F.try_element_at(known, t), F.concat(F.lit("5"), t)))))
    early = rest.rlike(r"^[-._]?(" + "|".join(_EARLY) + r")(?![a-z])") | rest.rlike(r"^-(?!post)")
    stage = F.when(rest.rlike(r"^[-._]?post"), 2).when(early, 0).otherwise(1)
    return F.when(release != "", F.struct(parts.alias("parts"), stage.alias("stage"), F.when(stage == 1, F.array().cast("array<string>")).otherwise(tail).alias("tail")))


def _power(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), level.cast("int"))


def _nodes(low: Column, high: Column, levels: Column) -> Column:
    """The fewest aligned blocks of sizes 2^level that tile [low, high), at most two of each size."""
    def of(level: Column) -> Column:
        size = _power(level)
        first, last = F.floor((low + size - 1) / size).cast("bigint"), F.floor(high / size).cast("bigint")
        odd = (first % 2 == 1) & (first < last)
        left = F.when(odd, F.struct(level.cast("int").alias("level"), first.alias("block")))
        right = F.when((last % 2 == 1) & (F.when(odd, first + 1).otherwise(first) < last), F.struct(level.cast("int").alias("level"), (last - 1).alias("block")))
        return F.array(left, right)

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), levels), of)), lambda n: n.isNotNull())


def part_key(version: Column) -> Column:
    """A plainer order for parts that are whole numbers of 32 bits: the number at the start of each part, 0 without one; of equal beginnings the shorter text is smaller."""
    return F.transform(F.split(version, r"\."), lambda p: F.coalesce(F.regexp_extract(p, r"^(\d+)", 1).try_cast("int"), F.lit(0)))


def affected_dependencies(dependencies: DataFrame, ranges: DataFrame, key: Callable[[Column], Column] = version_key) -> DataFrame:
    """Dependencies whose version lies in [introduced, fixed) of an advisory, in the order of ``key``.

    Versions and bounds of a package are numbered in their order.  A range is then a few aligned blocks of numbers and a version is in one block of each size, so
    both meet on equality: no version is compared with a range that does not hold it, however many of both a package has.  A range with an unreadable
    start holds nothing, as does one whose end is unreadable; without an end it goes on.
    """
    package = ["ecosystem", "name"]
    versions = dependencies.select(*package, "version").distinct().withColumn("_v", key(F.col("version"))).filter("_v IS NOT NULL")
    bounds = ranges.withColumns({"_low": key(F.col("introduced")), "_high": key(F.col("fixed"))}).filter("_low IS NOT NULL AND (fixed IS NULL OR _high IS NOT NULL)")
    points = versions.select(*package, "_v").unionByName(bounds.select(*package, F.col("_low").alias("_v"))).unionByName(bounds.filter("_high IS NOT NULL").select(*package, F.col("_high").alias("_v")))
    ordered = Window.partitionBy(*package).orderBy("_v")
    numbered = points.distinct().withColumn("_n", F.row_number().over(ordered).cast("bigint") - 1).withColumn("_count", F.count("*").over(Window.partitionBy(*package)))
    levels = F.length(F.bin("_count")).cast("int")
    placed = versions.join(numbered, [*package, "_v"]).select(*package, "version", F.explode(F.transform(
        F.sequence(F.lit(0), levels), lambda k: F.struct(k.alias("level"), F.floor(F.col("_n") / _power(k)).cast("bigint").alias("block")))).alias("_node"))
    low = numbered.select(*package, F.col("_v").alias("_low"), F.col("_n").alias("_from"), "_count")
    high = numbered.select(*package, F.col("_v").alias("_high"), F.col("_n").alias("_to"))
    tiled = bounds.join(low, [*package, "_low"]).join(high, [*package, "_high"], "left")
    tiled = tiled.withColumn("_node", F.explode(_nodes(F.col("_from"), F.coalesce("_to", "_count"), levels))).drop("_low", "_high", "_from", "_to", "_count")
    hits = placed.join(tiled, [*package, "_node"]).drop("_node")
    return dependencies.join(hits, [*package, "version"])


def license_issues(packages: DataFrame) -> DataFrame:
    """Restrictive and unknown licences with their severity."""
    named = packages.withColumn("license", F.coalesce("license", F.lit("Unknown")))
    restrictive = F.col("license").isin(*RESTRICTIVE_LICENSES)
    return named.filter(restrictive | (F.col("license") == "Unknown")).withColumns({
        "issue": F.when(restrictive, F.concat(F.col("license"), F.lit(" is a restrictive copyleft license")))
        .otherwise("License unknown - manual review required"),
        "severity": F.when(~restrictive, "low").when(F.col("license").contains("AGPL"), "high").otherwise("medium"),
    })


def license_totals(packages: DataFrame, *keys: str) -> DataFrame:
    """Packages, restrictive and unknown licences per project."""
    license_id = F.coalesce("license", F.lit("Unknown"))
    return packages.groupBy(*keys).agg(
        F.count("*").alias("total_deps"), F.count_if(license_id.isin(*RESTRICTIVE_LICENSES)).alias("restrictive"),
        F.count_if(license_id == "Unknown").alias("unknown"))


def license_conflicts(packages: DataFrame, project: str) -> DataFrame:
    """Conflicting licence pairs within a project.

    Licences are made distinct per project first and matched through the
    conflict matrix, so no pair of packages is ever formed.
    """
    used = packages.select(project, "license").filter(F.col("license").isNotNull()).distinct()
    matrix = F.create_map(*[x for k, v in LICENSE_CONFLICTS.items() for x in (
        F.lit(k), F.array(*[F.lit(i) for i in v]).cast("array<string>"))])
    wanted = used.select(project, "license", F.explode(F.try_element_at(matrix, F.col("license"))).alias("conflicts_with"))
    return wanted.join(used.withColumnRenamed("license", "conflicts_with"), [project, "conflicts_with"])
