"""The whole review of changes, from diff text to final findings and reports."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.operators import deps, findings, remedies, scan, scoring
from changelens.operators.findings import Folded
from changelens.session import materialize

_CARRIED = ("pr_id", "score_pts")


@dataclass(frozen=True)
class Widths:
    """Leading characters that count of a title as key, of a shown line with a secret, of a diff searched for places; None takes all."""

    title: int | None = None
    secret: int | None = None
    places: int | None = None


WHOLE = Widths()


def raw_findings(changes: DataFrame, advisories: DataFrame | None = None, widths: Widths = WHOLE, folded: bool = False) -> DataFrame | Folded:
    """Union of all agents' findings; deep agents only where the risk score asks for them.

    ``folded`` leaves the advisories of a dependency folded: a popular version with many of them gives as many findings in every change.
    """
    scored = scoring.with_risk(changes, widths.places).select(*_CARRIED, "diff")
    found = scan.scan_changes(scored, deep_when=F.col("score_pts") >= scoring.LOW_RISK_POINTS, secret_chars=widths.secret)
    # a few lines per change, read by two checks: written once instead of reading the diffs again
    manifests = materialize(deps.manifest_dependencies(scored.filter(F.col("score_pts") >= scoring.LOW_RISK_POINTS)), "manifests")
    found = found.unionByName(deps.stale_findings(manifests))
    if advisories is None:
        return found
    if folded:
        return Folded(found, *deps.folded_advisories(manifests, advisories), deps.EXACT_VERSION)
    return found.unionByName(deps.advisory_findings(manifests, advisories))


def final_findings(raw: DataFrame | Folded, widths: Widths = WHOLE) -> DataFrame | Folded:
    """Filtered by confidence, first of each key, enriched in place.

    Changes of low risk end after the static agent: their findings skip the
    filter and the deduplication, as they skip the agent that does both.
    Folded findings are of changes with all agents, and stay folded.
    """
    deep = F.col("score_pts") >= scoring.LOW_RISK_POINTS
    if isinstance(raw, Folded):
        first = findings.first_of_folded(replace(raw, members=raw.members.filter(scoring.is_confident())), widths.title)
        return replace(first, rows=final_findings(first.rows, widths), members=remedies.enrich(first.members))
    kept = raw.filter(~deep | scoring.is_confident())
    # the position makes every finding of a low-risk change a key of its own, so one pass serves both kinds
    key = [*findings.orchestrator_key(widths.title), F.when(~deep, F.col("emit_seq"))]
    # no field of the key is enriched, so rows are shuffled without what enrichment adds
    return remedies.enrich(findings.first_wins(kept, key, ["emit_seq", "title"]), where=deep)


def stored(found: DataFrame | Folded, purpose: str) -> DataFrame | Folded:
    """``materialize`` for findings that may be folded."""
    return replace(found, rows=materialize(found.rows, purpose)) if isinstance(found, Folded) else materialize(found, purpose)


def review(changes: DataFrame, advisories: DataFrame | None = None, widths: Widths = WHOLE, folded: bool = False) -> DataFrame | Folded:
    """All final findings; ``folded`` for results that only count or number them."""
    final = final_findings(raw_findings(changes, advisories, widths, folded=True), widths)
    return final if folded or isinstance(final, DataFrame) else final.unfold()


def reports(changes: DataFrame, advisories: DataFrame | None = None, widths: Widths = WHOLE) -> DataFrame:
    """Markdown reports of all changes in numbered parts, those without findings included."""
    raw = stored(raw_findings(changes, advisories, widths, folded=True), "raw-findings")
    heads = scoring.with_risk(changes, widths.places).select("pr_id", "repo_full_name", "pr_number", "score_pts", "risk_score")
    return findings.review_reports(heads, stored(final_findings(raw, widths), "final-findings"), findings.agent_counts(raw))


def outbox(changes: DataFrame, advisories: DataFrame | None = None, widths: Widths = WHOLE) -> DataFrame:
    heads = scoring.with_risk(changes, widths.places).select("pr_id", "repo_full_name", "pr_number", "risk_score")
    return findings.comment_outbox(heads, stored(review(changes, advisories, widths, folded=True), "final-findings"))
