"""The rule scan: lines in, canonical findings out, in one narrow pass.

For every line the literal prefilters of the packs are tested first; only where
one passes are that pack's expressions evaluated, as one array of rule keys
that is exploded.  No shuffle, no join over lines, no Python.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.functions.text import contains_any, java, literal_rows, matches, once, quote, sql_contains_any, sql_matches, strip
from changelens.operators import rules as R
from changelens.operators.diffs import AGENT_LANGUAGES, added_lines

FINDING_COLUMNS = (
    "agent_type", "severity", "category", "title", "description", "file_path", "line_start", "line_end",
    "code_snippet", "suggestion", "confidence_score", "cwe_id", "owasp_category", "rule_id",
)

_RULE_SCHEMA = (
    "pack string, agent_type string, category string, severity string, title string, description string, "
    "suggestion string, confidence_score double, cwe_id string, owasp_category string, rule_id string, "
    "numbering string, rule_major boolean, rank bigint, rule_no bigint"
)


@dataclass(frozen=True)
class Group:
    """Rules sharing a prefilter: ``tests[i]`` decides the rule described by ``rows[i]``.

    Guard and tests are SQL over the columns of ``diffs.added_lines``.  ``needs``
    are lower-case literals, one of which is in every line that passes the
    guard; the scan drops all other lines before anything else.
    """

    guard: str
    tests: tuple[str, ...]
    rows: tuple[dict, ...]
    needs: tuple[str, ...]
    deep: bool = True
    pair_needs: tuple[str, ...] | None = ()  # literals of the two-line rules; None where one has none


def _pair_needs(packs: Sequence[R.Pack]) -> tuple[str, ...] | None:
    rules = [r for p in packs for r in p.rules if r.two_line]
    return None if any(not r.needs for r in rules) else tuple(n.lower() for r in rules for n in r.needs)


def _needs(pack: R.Pack) -> tuple[str, ...]:
    return tuple(dict.fromkeys(n for r in pack.rules for n in r.needs))


def _folds_case(pack: R.Pack) -> bool:
    return pack.ignore_case or any(r.pattern.startswith("(?i)") for r in pack.rules)


def prefilter(pack: R.Pack, text: str, low: str) -> str:
    """False only on lines that no rule of the pack can match."""
    if any(not r.needs for r in pack.rules):
        return "true"
    return sql_contains_any(low if _folds_case(pack) else text, _needs(pack))


def rule_test(rule: R.Rule, pack: R.Pack, text: str, pair: str) -> str:
    pattern = ("(?i)" if pack.ignore_case else "") + rule.pattern
    return f"coalesce({sql_matches(pair, pattern)}, false)" if rule.two_line else sql_matches(text, pattern)


def _row(pack, rank, no, rule, **values):
    base = dict(
        pack=pack, severity=rule.severity, cwe_id=rule.cwe, owasp_category=None, rule_id=f"{pack}-{no}",
        rule_major=False, rank=rank, rule_no=no, title=rule.title, description=rule.title, suggestion=None,
    )
    return base | values


def group_for(name: str | R.Pack, position: int = 0) -> Group:
    """The named group, or a pack of the user's own, over the columns of ``diffs.added_lines``; ``position`` orders several own packs."""
    plain = "code_no IS NOT NULL"

    def pack_group(pack, describe, text="code", extra=None, deep=True, guard=None):
        base = prefilter(pack, text, "low")
        tests, rows = [], []
        for no, rule in enumerate(pack.rules, 1):
            test = rule_test(rule, pack, text, "pair")
            tests.append(f"{test} AND {extra(rule)}" if extra else test)
            rows.append(describe(no, rule))
        needs = () if any(not r.needs for r in pack.rules) else _needs(pack)
        return Group(f"{base} AND {guard}" if guard else base, tuple(tests), tuple(rows), needs, deep, _pair_needs([pack]))

    if isinstance(name, R.Pack):
        return pack_group(name, lambda no, r: _row(
            name.name, 50 + position, no, r, agent_type="security_audit", category="security", numbering="added", confidence_score=0.8,
            owasp_category=r.label))

    if name == "quick_static":
        return pack_group(R.QUICK_STATIC, lambda no, r: _row(
            name, 10, no, r, agent_type="static_analysis", category="static_analysis", numbering="diff",
            description=f"Found `{r.pattern}` pattern at line {{line}}", confidence_score=0.85,
            suggestion=f"Review and replace the {r.pattern} usage with a safer alternative"), deep=False)
    if name == "secrets":
        def not_placeholder(rule):
            found = f"lower(regexp_extract(line, {quote(java(rule.pattern))}, 0))"
            return f"NOT exists({_sql_array(R.PLACEHOLDERS)}, w -> contains({found}, w))"
        return pack_group(R.SECRETS, lambda no, r: _row(
            name, 20, no, r, agent_type="security_audit", category="security", numbering="diff",
            title=f"Exposed {r.title}", owasp_category=R.A02, confidence_score=0.95,
            description=f"Hardcoded {r.title} found in diff at line {{line}}",
            suggestion=f"Remove hardcoded {r.title} and use environment variables"), text="line", extra=not_placeholder)
    if name == "owasp":
        return pack_group(R.OWASP, lambda no, r: _row(
            name, 21, no, r, agent_type="security_audit", category="security", numbering="added",
            owasp_category=r.label, rule_major=True, confidence_score=0.8,
            description=f"OWASP {r.label}: {r.title} at line {{line}}",
            suggestion="Review and remediate per OWASP guidelines"))
    if name == "crypto":
        return pack_group(R.CRYPTO, lambda no, r: _row(
            name, 22, no, r, agent_type="security_audit", category="security", numbering="added",
            owasp_category=R.A02, confidence_score=0.9,
            suggestion="Replace with modern, secure cryptographic algorithm"))
    if name == "auth":
        return pack_group(R.AUTH, lambda no, r: _row(
            name, 23, no, r, agent_type="security_audit", category="security", numbering="added", confidence_score=0.8))
    if name == "injection":
        return pack_group(R.INJECTION, lambda no, r: _row(
            name, 24, no, r, agent_type="security_audit", category="security", numbering="added", confidence_score=0.8,
            rule_id=f"injection-{r.label}"))
    if name == "language_static":
        return pack_group(R.LANGUAGE_STATIC, lambda no, r: _row(
            name, 11, no, r, agent_type="static_analysis", category="static_analysis", numbering="added", confidence_score=0.8),
            extra=lambda r: "true" if r.label == "any" else _file_is(r.label), deep=False)
    if name == "controls":
        return pack_group(R.CONTROLS, lambda no, r: _row(
            name, 41, no, r, agent_type="compliance", category="compliance", numbering="code", confidence_score=0.7,
            title=f"SOC2 {r.label}: {r.title}",
            description=f"SOC2 Control {r.label} ({R.SOC2_CONTROLS.get(r.label, 'Unknown')}): {r.title}",
            suggestion=f"Review {r.label}: {R.SOC2_CONTROLS.get(r.label)} requirements"), guard=plain)
    if name == "retention":
        return pack_group(R.RETENTION, lambda no, r: _row(
            name, 44, no, r, agent_type="compliance", category="compliance", numbering="code", confidence_score=0.8,
            suggestion="Implement data retention policy with automatic deletion after defined period"), guard=plain)
    if name == "pii_logging":
        return _privacy_group(name, 0, f"{plain} AND {sql_contains_any('low', R.LOG_WORDS)}", R.LOG_WORDS, [sql_contains_any("low", [f]) for f in R.PII_FIELDS], [
            ("high", f"PII field '{f}' may be logged in plain text", "Article 5(1)(f) - Data integrity and confidentiality", "CC6.7",
             "Redact or mask PII before logging. Use structured logging with field-level masking.") for f in R.PII_FIELDS])
    if name == "pii_storage":
        verbs = ("store_", "save_")
        guard = f"{plain} AND {sql_contains_any('low', verbs)} AND NOT {sql_contains_any('low', R.PROTECTION_WORDS)}"
        return _privacy_group(name, 20, guard, verbs, [sql_contains_any("low", [v + f for v in verbs]) for f in R.PII_FIELDS], [
            ("high", f"PII '{f}' may be stored without encryption", "Article 32 - Security of processing", "CC6.1",
             "Encrypt PII at rest using AES-256 or equivalent") for f in R.PII_FIELDS])
    if name == "consent":
        guard = f"{plain} AND {sql_contains_any('low', R.PROCESSING_WORDS)}"
        return _privacy_group(name, 40, guard, R.PROCESSING_WORDS, [f"NOT {sql_contains_any('low', R.CONSENT_WORDS)}"], [
            ("medium", "Data processing operation without visible consent verification", "Article 6 - Lawfulness of processing",
             "PI1.1", "Add explicit consent check before processing personal data")])
    if name == "transfer":
        return _privacy_group(name, 41, f"{plain} AND contains(low, 'requests.')", ("requests.",), [sql_matches("low", R.TRANSFER_PATTERN)], [
            ("medium", "Data transfer to external service may require GDPR Data Processing Agreement", "Article 28 - Processor",
             "CC9.1", "Ensure DPA exists with external processor and data minimization is applied")])
    if name == "operations":
        return _context_group(name, 42, R.SENSITIVE_OPERATIONS, 10, R.OPERATION_LOG_WORDS, lambda op: dict(
            title=f"SOC2 CC7.2: Sensitive operation '{op}' may lack audit logging", confidence_score=0.7,
            description=f"SOC2 Control CC7.2 ({R.SOC2_CONTROLS['CC7.2']}): Sensitive operation '{op}' may lack audit logging",
            suggestion="Add audit log entry recording who performed this action and when"))
    if name == "audit":
        return _context_group(name, 43, R.CRITICAL_FUNCTIONS, 15, R.AUDIT_WORDS, lambda fn: dict(
            title=f"Missing Audit Log: {fn}", confidence_score=0.65, description=f"Function '{fn}' lacks audit logging",
            suggestion="Add structured audit log entry with user, action, timestamp, and result"))
    raise KeyError(name)


def _sql_array(words) -> str:
    return "array(" + ", ".join(quote(w) for w in words) + ")"


def _file_is(language: str) -> str:
    return "(" + " OR ".join(f"endswith(diff_file, {quote(e)})" for e, l in AGENT_LANGUAGES.items() if l == language) + ")"


def _privacy_group(name, first, guard, needs, tests, texts) -> Group:
    rows = [dict(
        pack=name, agent_type="compliance", category="compliance", severity=severity, title=f"GDPR: {text}",
        description=f"{text}. GDPR {article}. SOC2 Control: {control}", suggestion=suggestion, confidence_score=0.75,
        cwe_id=None, owasp_category=None, rule_id=f"{name}-{no}", numbering="code", rule_major=False, rank=40,
        rule_no=first + no,
    ) for no, (severity, text, article, control, suggestion) in enumerate(texts, 1)]
    return Group(guard, tuple(tests), tuple(rows), tuple(needs))


def _context_group(name, rank, functions, lines, words, describe) -> Group:
    """Definitions of the functions without one of the words in the lines that follow."""
    covered = f"exists(slice(following, 1, {lines}), l -> {sql_contains_any('lower(l)', words)})"
    tests, rows = [], []
    for no, fn in enumerate(functions, 1):
        tests.append(sql_matches("code", rf"(?i)def\s+{fn}\s*\(") + f" AND NOT {covered}")
        rows.append(dict(
            pack=name, agent_type="compliance", category="compliance", severity="medium", cwe_id=None,
            owasp_category=None, rule_id=f"{name}-{fn}", numbering="code", rule_major=False, rank=rank, rule_no=no,
        ) | describe(fn))
    return Group("code_no IS NOT NULL AND contains(low, 'def')", tuple(tests), tuple(rows), ("def",))


GDPR_GROUPS = ("pii_logging", "pii_storage", "consent", "transfer")
MAIN_GROUPS = ("quick_static", "secrets", "owasp", "crypto", *GDPR_GROUPS, "controls", "operations", "audit")
LIBRARY_GROUPS = ("language_static", "auth", "injection", "retention")

_DEFINITIONS = r"(?i)def\s+(?:" + "|".join(dict.fromkeys(R.SENSITIVE_OPERATIONS + R.CRITICAL_FUNCTIONS)) + r")\s*\("


def scan_changes(changes: DataFrame, groups: Sequence[str | R.Pack] = MAIN_GROUPS, deep_when: Column | None = None, secret_chars: int | None = None) -> DataFrame:
    """Findings of the named groups, and of packs of the user's own, over the added lines of each diff.

    ``deep_when`` limits all but the static groups to changes where it holds;
    every other column of ``changes`` is passed through.  ``secret_chars`` shows
    only so much of a line that holds a secret.
    """
    wanted = {g for g in groups if isinstance(g, str)}
    picked = [group_for(g, i) for i, g in enumerate(groups)]
    pairs = [g.pair_needs for g in picked if g.pair_needs != ()]
    pair_words = None if None in pairs else _shortest(n for p in pairs for n in p)
    columns = [c for c in changes.columns if c != "diff"]
    source = changes
    if deep_when is not None:
        source = changes.withColumn("_deep", deep_when)
    lines = added_lines(
        source,
        context=15,
        context_when=(lambda code: code.rlike(r"(?i)def\s") & matches(code, _DEFINITIONS)) if wanted & {"operations", "audit"} else None,
        pair_when=None if not pairs else (lambda code: F.lit(True)) if pair_words is None else (lambda code: contains_any(F.lower(code), pair_words)),
    )
    rows, keyed = [], []
    for group in picked:
        first = len(rows) + 1
        rows.extend(group.rows)
        guard = f"_deep AND {group.guard}" if group.deep and deep_when is not None else group.guard
        keyed.append((guard, group.tests, first))
    if all(g.needs for g in picked):
        lines = lines.filter(sql_contains_any("low", _shortest(n for g in picked for n in g.needs)))
    hits = lines.select(
        *columns, "diff_line", "diff_file", "added_no", "code_no", "line", "code", _explode_hits(keyed))
    described = hits.select("*", F.element_at(literal_rows(rows, _RULE_SCHEMA), F.col("_hit")).alias("r"))
    number = F.when(F.col("r.numbering") == "diff", F.col("diff_line")).when(
        F.col("r.numbering") == "added", F.col("added_no")).otherwise(F.col("code_no"))
    stripped = strip(F.when(F.col("r.pack") == "secrets", F.col("line")).otherwise(F.col("code")))
    major = F.when(F.col("r.rule_major"), F.col("r.rule_no")).otherwise(number).cast("bigint")
    minor = F.when(F.col("r.rule_major"), number).otherwise(F.col("r.rule_no")).cast("bigint")
    return described.select(
        *columns,
        F.col("r.agent_type"), F.col("r.severity"), F.col("r.category"), F.col("r.title"),
        F.replace(F.col("r.description"), F.lit("{line}"), number.cast("string")).alias("description"),
        F.when(F.col("r.pack") == "quick_static", F.col("diff_file")).otherwise("unknown").alias("file_path"),
        number.alias("line_start"), number.alias("line_end"),
        (stripped if secret_chars is None else F.when(
            (F.col("r.pack") == "secrets") & (F.length("line") > secret_chars), F.concat(F.substring(stripped, 1, secret_chars), F.lit("..."))).otherwise(stripped)).alias("code_snippet"),
        F.col("r.suggestion"), F.col("r.confidence_score"), F.col("r.cwe_id"), F.col("r.owasp_category"), F.col("r.rule_id"),
        "diff_line", "diff_file",
        emit_position(F.col("r.rank"), major, minor).alias("emit_seq"),
    )


def _shortest(literals) -> list[str]:
    """The literals in lower case, without those that contain another one."""
    folded = sorted({n.lower() for n in literals}, key=len)
    return [n for i, n in enumerate(folded) if not any(m in n for m in folded[:i])]


def _explode_hits(keyed: list[tuple[str, Sequence[str], int]]) -> Column:
    """Rule keys of a line, one row each; tests are numbered from the given key on.

    The lambda keeps the hundred expressions out of one generated method, which
    would pass the size the JVM compiles; only prefiltered lines come here.
    """
    arrays = []
    for guard, tests, first in keyed:
        keys = ", ".join(f"CASE WHEN {t} THEN {k} END" for k, t in enumerate(tests, first))
        arrays.append(f"CASE WHEN {guard} THEN array({keys}) ELSE array() END")
    return F.expr(f"explode(filter(flatten(array({', '.join(arrays)})), k -> k IS NOT NULL))").alias("_hit")


def emit_position(rank: Column, major: Column, minor: Column) -> Column:
    """One number ordering findings of a change as the agents emit them."""
    return rank.cast("bigint") * 10**16 + major.cast("bigint") * 10**8 + minor.cast("bigint")


def match_rules(lines: DataFrame, text: str, packs: Sequence[R.Pack], prefiltered: bool = True, pair: str | None = None) -> DataFrame:
    """Line-by-rule join for any packs: one row per line and matching rule.

    ``pair`` names the column with the line, a line feed and the next line (null on a last line), on which two-line rules are matched.
    """
    if pair is None and any(r.two_line for p in packs for r in p.rules):
        raise ValueError("two-line rules need the column with a line and its successor")
    passed = [c for c in lines.columns if c != pair]
    lines = once(lines, _low=F.lower(text))
    rows, keyed = [], []
    for pack in packs:
        guard = prefilter(pack, text, "_low") if prefiltered else "true"
        keyed.append((guard, [rule_test(r, pack, text, pair) for r in pack.rules], len(rows) + 1))
        rows.extend(dict(pack=pack.name, rule_no=no, title=r.title, severity=r.severity) for no, r in enumerate(pack.rules, 1))
    if prefiltered and all(r.needs for p in packs for r in p.rules):
        lines = lines.filter(sql_contains_any("_low", _shortest(n for p in packs for n in _needs(p))))
    hits = lines.select(*passed, _explode_hits(keyed))
    rule = F.element_at(literal_rows(rows, "pack string, rule_no bigint, title string, severity string"), F.col("_hit"))
    return hits.select(*passed, rule.alias("r")).select(*passed, "r.*")


def packs_of(rules: DataFrame) -> list[R.Pack]:
    """Packs from a table of rules: pack, rule_no, pattern, severity and, where they have them, title, needs, ignore_case, two_line.

    The definitions come to the driver, as they become expressions of the plan; they grow with what users write, not with the data.
    Rules are numbered through in the order of ``rule_no``.
    """
    by_pack: dict[tuple[str, bool], list[R.Rule]] = {}
    have = set(rules.columns)
    optional = {"title": "string", "needs": "array<string>", "ignore_case": "boolean", "two_line": "boolean"}
    table = rules.withColumns({c: F.lit(None).cast(t) for c, t in optional.items() if c not in have})
    for r in table.orderBy("pack", "rule_no").collect():
        by_pack.setdefault((r.pack, bool(r.ignore_case)), []).append(
            R.Rule(r.pattern, r.title or r.pattern, r.severity, tuple(r.needs or ()), two_line=bool(r.two_line)))
    return [R.Pack(name, tuple(found), fold) for (name, fold), found in by_pack.items()]


def match_rule_table(lines: DataFrame, text: str, rules: DataFrame, pair: str | None = None, per_pass: int = 400) -> DataFrame:
    """``match_rules`` with the rules of a table.

    All rules become literals of one pass over the lines, which a join on a regular expression could not do; a
    table with more than about ``per_pass`` rules takes several passes, a pack staying in one.
    """
    passes: list[list[R.Pack]] = [[]]
    for pack in packs_of(rules):
        if passes[-1] and sum(len(p.rules) for p in passes[-1]) + len(pack.rules) > per_pass:
            passes.append([])
        passes[-1].append(pack)
    found = [match_rules(lines, text, packs, pair=pair) for packs in passes]
    return reduce(DataFrame.unionByName, found)
