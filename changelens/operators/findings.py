"""Finding lifecycle: append, deduplicate, update, delete, report, outbox."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.functions.text import SEVERITIES, risk_band, severity_rank
from changelens.session import materialize

# ---------------------------------------------------------------------------
# Defaults of a stored finding.
# ---------------------------------------------------------------------------
FINDING_DEFAULTS = {"agent_type": "orchestrator", "severity": "medium", "category": "static_analysis", "confidence_score": 0.8}
REPORT_ORDER = ("static_analysis", "security_audit", "dependency", "compliance")


def storable(findings: DataFrame, title_length: int | None = None) -> DataFrame:
    """Rows fit to be stored: titled and described, defaults filled (S5); titles are cut only where a column's width is given."""
    kept = findings.filter((F.coalesce("title", F.lit("")) != "") & (F.coalesce("description", F.lit("")) != ""))
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in FINDING_DEFAULTS.items() if c in findings.columns}
    missing = {c: F.lit(v) for c, v in FINDING_DEFAULTS.items() if c not in findings.columns}
    cut = {} if title_length is None else {"title": F.substring("title", 1, title_length)}
    return kept.withColumns(filled | missing | cut)


def append_findings(findings: DataFrame, path: str, created_at: str = "created_at", unit: str = "day") -> None:
    """Append storable findings to a table partitioned by day, or by a coarser ``unit`` such as month.

    Rebalancing brings the rows of a partition together, so tasks do not each
    write a file for every day, and splits one too large for one task.
    """
    dated = storable(findings).withColumn(unit, F.to_date(F.date_trunc(unit, F.col(created_at))))
    dated.hint("rebalance", unit).write.mode("append").partitionBy(unit).parquet(path)


def _title(length: int | None) -> Column:
    title = F.coalesce("title", F.lit(""))
    return title if length is None else F.substring(title, 1, length)


def orchestrator_key(title_length: int | None = None) -> list[Column]:
    """File, line and title (W4); ``title_length`` compares only so much of the titles."""
    return [F.col("file_path"), F.col("line_start"), _title(title_length)]


def service_key(missing_path: str | None = None, title_length: int | None = None) -> list[Column]:
    """File, line and lower-cased title (W5); ``title_length`` compares only so much of the titles."""
    path = F.col("file_path") if missing_path is None else F.coalesce("file_path", F.lit(missing_path))
    return [path, F.col("line_start"), F.lower(_title(title_length))]


def first_wins(findings: DataFrame, key: Sequence[Column], order: Sequence[Column | str], scope: Sequence[str] = ("pr_id",)) -> DataFrame:
    """The first finding of each key within its change.

    ``row_number() = 1`` lets Spark keep one row per key before the shuffle, so
    a key holding most of the rows still moves one row per task.
    """
    first = Window.partitionBy(*scope, *key).orderBy(*order)
    return findings.withColumn("_first", F.row_number().over(first)).filter("_first = 1").drop("_first")


@dataclass(frozen=True)
class Folded:
    """Findings of which many are the same in every change: a row of ``spans`` stands for all ``members`` of its ``key``.

    ``rows`` are findings as usual.  ``spans`` have the fields that the change gives and ``head``, with which the titles of their members begin; ``members``
    have the other fields, with no line.  Their number is that of changes plus that of members, where the findings are as many as their product, so
    findings are compared, counted and numbered as they are here and unfolded last, by a join with nothing to shuffle after it.
    """

    rows: DataFrame
    spans: DataFrame
    members: DataFrame
    key: tuple[str, ...]

    def unfold(self, members: DataFrame | None = None) -> DataFrame:
        """All findings one by one, or those of some ``members`` only."""
        return self.rows.unionByName(self.spans.join(self.members if members is None else members, [*self.key]).select(*self.rows.columns))


def _is_serious() -> Column:
    return F.col("severity").isin("critical", "high")


def first_of_folded(found: Folded, title_length: int | None = None) -> Folded:
    """``first_wins`` under ``orchestrator_key`` before the findings are unfolded; its ``rows`` are still to be compared with one another.

    Members of one key that share a title share all of their key in each change, as do spans of one key in one file, so the first of either stays.  Titles of
    different spans of a change differ if no head begins with another one and none is cut, and they are in the order of their spans if these have
    places of their own.  Spans of other changes, cut heads and members without a title become ``rows``, few as they are.
    """
    key = [*found.key]
    upto = Window.partitionBy(*key).orderBy("title").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    titled = F.col("title").isNotNull()
    # dealt by key once for both windows; the further order settles which of several with one title stays
    members = first_wins(found.members.repartition(*key), [_title(title_length)], ["title", "description", "severity"], scope=key).withColumns({
        "_place": F.count("title").over(upto), "_serious_place": F.count_if(titled & _is_serious()).over(upto)})
    members = materialize(members, "members")
    change = Window.partitionBy("pr_id")
    by_head, by_place = change.orderBy("head", *key), change.orderBy("emit_seq")
    # of heads in their order, one that others begin with stands right before one of these
    mixed = F.lead("head").over(by_head).startswith(F.col("head")) & ~F.lead(F.struct(*key)).over(by_head).eqNullSafe(F.struct(*key))
    shared = F.lead("emit_seq").over(by_place) == F.col("emit_seq")
    spans = first_wins(found.spans.repartition("pr_id"), [F.col("file_path"), *[F.col(k) for k in key]], ["emit_seq"])
    spans = spans.withColumn("_mixed", F.coalesce(mixed, F.lit(False)) | F.coalesce(shared, F.lit(False)))
    cut = F.lit(False) if title_length is None else F.length("head") > title_length
    spans = materialize(spans.withColumn("_apart", F.max("_mixed").over(change) | cut).drop("_mixed"), "spans")
    apart, plain, untitled = spans.filter("_apart"), spans.filter("NOT _apart"), members.filter(~titled)
    rows = found.rows
    if not apart.isEmpty():
        rows = Folded(rows, apart, members, found.key).unfold()
    if not untitled.isEmpty():
        rows = Folded(rows, plain, untitled, found.key).unfold()
    return Folded(rows, plain, members.filter(titled), found.key)


def _numbered(final: DataFrame | Folded, name: str, serious: bool = False) -> DataFrame:
    """All findings, or the critical and high ones, with their number in the change as emitted."""
    rows = final if isinstance(final, DataFrame) else final.rows
    rows = rows.filter(_is_serious()) if serious else rows
    emitted = Window.partitionBy("pr_id").orderBy("emit_seq", "title")
    if isinstance(final, DataFrame):
        return rows.withColumn(name, F.row_number().over(emitted))
    key, members = [*final.key], final.members.filter(_is_serious()) if serious else final.members
    sized = final.spans.join(members.groupBy(*key).agg(F.count("*").alias("_n")), key)
    # a row counts once, a span as often as it has members
    ends = F.sum("_n").over(emitted.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    one = {"_n": F.lit(1).cast("bigint"), "_span": F.lit(False)}
    sized = sized.withColumnRenamed("head", "title").withColumn("_span", F.lit(True))
    single = rows.withColumns(one).unionByName(sized.select("pr_id", "emit_seq", "title", "_n", "_span"), allowMissingColumns=True)
    single = single.withColumn(name, ends).filter("NOT _span").drop("_n", "_span")
    starts = sized.unionByName(rows.select("pr_id", "emit_seq", "title").withColumns(one), allowMissingColumns=True).withColumn("_before", ends - F.col("_n"))
    each = starts.filter("_span").drop("title").join(members, key).withColumn(name, F.col("_before") + F.col("_serious_place" if serious else "_place"))
    return single.unionByName(each.select(*single.columns))


def _counted(found: DataFrame | Folded, **tests: Column) -> DataFrame:
    """How many findings of each change pass each test."""
    counts = [F.count_if(test).alias(name) for name, test in tests.items()]
    if isinstance(found, DataFrame):
        return found.groupBy("pr_id").agg(*counts)
    key = [*found.key]
    spanned = found.spans.select("pr_id", *key).join(found.members.groupBy(*key).agg(*counts), key).select("pr_id", *tests)
    return found.rows.groupBy("pr_id").agg(*counts).unionByName(spanned).groupBy("pr_id").agg(*[F.sum(name).alias(name) for name in tests])


def unseen(new: DataFrame, existing: DataFrame, order: Sequence[Column | str], title_length: int | None = None) -> DataFrame:
    """New findings not stored yet, first of each key within the batch."""
    names = ("_path", "_line", "_title")
    keyed = new.withColumns(dict(zip(names, service_key(title_length=title_length))))
    stored = existing.select("pr_id", *[k.alias(n) for k, n in zip(service_key(title_length=title_length), names)]).distinct().alias("e")
    fresh = keyed.alias("n").join(
        stored,
        (F.col("n.pr_id") == F.col("e.pr_id")) & F.col("n._path").eqNullSafe(F.col("e._path"))
        & F.col("n._line").eqNullSafe(F.col("e._line")) & (F.col("n._title") == F.col("e._title")),
        "left_anti",
    )
    return first_wins(fresh, [F.col(n) for n in names], order).drop(*names)


def delete_changes(children: DataFrame, deleted: DataFrame, key: str = "pr_id") -> tuple[DataFrame, DataFrame]:
    """Rows that stay and rows removed when pull requests are deleted."""
    gone = deleted.select(key).distinct()
    return children.join(gone, key, "left_anti"), children.join(gone, key, "left_semi")


def latest_per_key(updates: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last update of each key."""
    last = Window.partitionBy(*keys).orderBy(*order)
    return updates.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def patch_rows(base: DataFrame, updates: DataFrame, key: str, fields: Sequence[str], seq: str) -> DataFrame:
    """Apply the updates of each row in the order of ``seq`` (F12): a field takes its last non-null value, whichever update gave it."""
    last = [F.max(F.when(F.col(f).isNotNull(), F.struct(F.col(seq).alias("seq"), F.col(f).alias("value"))))["value"].alias(f"_u_{f}") for f in fields]
    latest = updates.groupBy(key).agg(*last)
    return base.join(latest, key, "left").withColumns(
        {f: F.coalesce(F.col(f"_u_{f}"), F.col(f)) for f in fields}).drop(*[f"_u_{f}" for f in fields])


def apply_feedback(findings: DataFrame, feedback: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """Latest feedback sets both the flag and the text, the text even to null."""
    latest = latest_per_key(feedback, [key], order).select(
        key, F.col("false_positive").alias("_fp"), F.col("human_feedback").alias("_text"), F.lit(True).alias("_given"))
    return findings.join(latest, key, "left").withColumns({
        "false_positive": F.when(F.col("_given"), F.col("_fp")).otherwise(F.col("false_positive")),
        "human_feedback": F.when(F.col("_given"), F.col("_text")).otherwise(F.col("human_feedback")),
    }).drop("_fp", "_text", "_given")


def trigger_reviews(requests: DataFrame, prs: DataFrame, key: str = "pr_id") -> DataFrame:
    """Disposition of review requests: queued, conflict or not_found."""
    state = prs.select(key, F.col("status").alias("_status"))
    return requests.join(state, key, "left").withColumn(
        "disposition", F.when(F.col("_status").isNull(), "not_found").when(F.col("_status") == "reviewing", "conflict").otherwise("queued")
    ).drop("_status")


def top_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows of each group; the limit is applied before the shuffle as well."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)


def highlights(findings: DataFrame, k: int = 3) -> DataFrame:
    """The first critical, then high findings of each change."""
    serious = findings.filter(F.col("severity").isin("critical", "high"))
    return top_per_group(serious, ["pr_id"], [severity_rank(F.col("severity")), "emit_seq", "finding_id"], k, "highlight")


def _python_count(name: str, column: Column) -> Column:
    return F.concat(F.lit("{'" + name + "': "), column.cast("string"), F.lit("}"))


def review_summary(prs: DataFrame, final: DataFrame | Folded, agent_counts: DataFrame) -> DataFrame:
    """Head of each report: score, totals by severity, agent results (Q12)."""
    totals = _counted(final, total=F.lit(True), **{f"n_{s}": F.col("severity") == s for s in SEVERITIES})
    base = prs.join(totals, "pr_id", "left").join(agent_counts, "pr_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    severities = F.filter(F.array(*[
        F.when(zero(f"n_{s}") > 0, F.concat(F.lit(f"- **{s.upper()}**: "), zero(f"n_{s}").cast("string"))) for s in SEVERITIES
    ]), lambda l: l.isNotNull())
    # Python prints 0.3 for a score of thirty hundredths and 1.0 for one hundred
    score_text = F.col("risk_score").cast("string")
    deep = F.col("score_pts") >= 30
    agents = F.filter(F.array(
        F.concat(F.lit("- **triage**: {'risk_score': "), score_text, F.lit("}")),
        *[F.when(deep | F.lit(a == "static_analysis"), F.concat(F.lit(f"- **{a}**: "), _python_count("findings_count", zero(f"agent_{a}"))))
          for a in REPORT_ORDER],
        F.when(deep & (zero("enriched") > 0), F.concat(F.lit("- **remediation**: "), _python_count("enriched_count", zero("enriched")))),
    ), lambda l: l.isNotNull())
    lines = F.concat(
        F.array(
            F.concat(F.lit("# Code Review Report: "), F.col("repo_full_name"), F.lit(" PR #"), F.col("pr_number").cast("string")), F.lit(""),
            F.concat(F.lit("**Risk Score:** "), F.format_string("%.2f", F.col("risk_score")), F.lit("/1.0")),
            F.concat(F.lit("**Total Findings:** "), zero("total").cast("string")), F.lit(""), F.lit("## Severity Summary")),
        severities, F.array(F.lit(""), F.lit("## Agent Results")), agents,
        F.when(zero("total") > 0, F.array(F.lit(""), F.lit("## Critical & High Findings"))).otherwise(F.array().cast("array<string>")),
    )
    return base.select("pr_id", F.array_join(lines, "\n").alias("head"))


def review_reports(prs: DataFrame, final: DataFrame | Folded, agent_counts: DataFrame) -> DataFrame:
    """Markdown report of each change in numbered parts (Q12).

    Part 0 is the head; part n is the n-th critical or high finding as emitted.  The parts of a change
    joined by line feeds are its report.  The shape is the same however many findings there are, and no
    group is ever collected into one row: a sink that wants one text writes the parts one after another.
    """
    heads = review_summary(prs, final, agent_counts)
    text = lambda c, default: F.coalesce(F.col(c).cast("string"), F.lit(default))
    block = F.concat(
        F.lit("\n### ["), F.upper("severity"), F.lit("] "), F.col("title"), F.lit("\n**File:** `"), text("file_path", "None"),
        F.lit("` (lines "), text("line_start", "None"), F.lit("-"), text("line_end", "None"), F.lit(")\n\n"), F.col("description"),
        F.when(F.coalesce("suggestion", F.lit("")) != "", F.concat(F.lit("\n\n**Suggestion:** "), F.col("suggestion"))).otherwise(""),
    )
    blocks = _numbered(final, "part", serious=True).select("pr_id", F.col("part").cast("bigint").alias("part"), block.alias("report"))
    return heads.select("pr_id", F.lit(0).cast("bigint").alias("part"), F.col("head").alias("report")).unionByName(blocks)


def reflection_counts(raw: DataFrame, threshold: float = 0.4, title_length: int | None = None) -> DataFrame:
    """Findings of each change before reflection, after its confidence filter and after its deduplication.

    One pass: a finding counts once per key, so the number of keys with a confident finding is the number kept.
    """
    keyed = raw.withColumn("_sure", F.coalesce("confidence_score", F.lit(0.8)) >= threshold)
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(orchestrator_key(title_length))])
    per_key = keyed.groupBy("pr_id", key.alias("_key")).agg(F.count("*").alias("n"), F.count_if("_sure").alias("s"))
    return per_key.groupBy("pr_id").agg(
        F.sum("n").alias("original_count"), F.sum("s").alias("after_filter"), F.count_if(F.col("s") > 0).alias("final_count"))


def categories_hit(findings: DataFrame) -> DataFrame:
    """The risk categories and injection kinds found in each change, each once and in order."""
    kind = F.nullif(F.regexp_extract("rule_id", "^injection-(.*)", 1), F.lit(""))
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ";")  # noqa: E731  (a fixed list of categories bounds the sets)
    return findings.groupBy("pr_id").agg(listed("owasp_category").alias("owasp_hit"), listed(kind).alias("injection_hit"))


def only_in(new: DataFrame, existing: DataFrame, key: str = "pr_id") -> DataFrame:
    """Keys of new rows that no existing row has (U3); each side moves one row per key."""
    return new.select(key).distinct().join(existing.select(key).distinct(), key, "left_anti")


def finish_reviews(prs: DataFrame, outcomes: DataFrame, final: DataFrame, error_length: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pull requests and run rows after their reviews ended.

    ``outcomes`` has one row per ended review: pr_id, risk_score, steps_taken, started_at, completed_at and ``error``, null where it went well.
    A review that went well sets status, score and time of its pull request and the run's counts; a failed one sets the status
    alone and leaves its message, cut to ``error_length`` if given, in the run.
    """
    well = F.col("error").isNull()
    counts = final.groupBy("pr_id").agg(F.count("*").alias("_n"))
    message = F.col("error") if error_length is None else F.substring("error", 1, error_length)
    runs = outcomes.join(counts, "pr_id", "left").select(
        "pr_id", F.lit("orchestrator").alias("agent_type"), F.when(well, "completed").otherwise("failed").alias("status"), "started_at", "completed_at",
        F.when(well, F.coalesce("steps_taken", F.lit(0))).otherwise(0).alias("steps_taken"), F.when(well, F.coalesce("_n", F.lit(0))).otherwise(0).alias("findings_count"),
        ((F.unix_millis("completed_at") - F.unix_millis("started_at")) / 1000).alias("duration_seconds"),
        F.when(~well, message).alias("error_message"))
    ended = outcomes.select("pr_id", F.lit(True).alias("_ended"), well.alias("_well"), F.col("risk_score").alias("_risk"), F.col("completed_at").alias("_at"))
    have = set(prs.columns)
    reviewed = F.col("reviewed_at") if "reviewed_at" in have else F.lit(None).cast("timestamp")
    updated = prs.join(ended, "pr_id", "left").withColumns({
        "status": F.when(F.col("_ended"), F.when(F.col("_well"), "completed").otherwise("failed")).otherwise(F.col("status")),
        "risk_score": F.when(F.col("_well"), F.coalesce("_risk", F.lit(0.0))).otherwise(F.col("risk_score")),
        "reviewed_at": F.when(F.col("_well"), F.col("_at")).otherwise(reviewed)}).drop("_ended", "_well", "_risk", "_at")
    return updated, runs


def agent_counts(findings: DataFrame | Folded) -> DataFrame:
    """Findings per agent and change, one column per agent."""
    return _counted(findings, **{f"agent_{a}": F.col("agent_type") == a for a in REPORT_ORDER}, enriched=_is_serious())


def comment_outbox(prs: DataFrame, final: DataFrame | Folded, first: int = 5) -> DataFrame:
    """Review comment of each change: band, counts, serious ones of the first findings (Q13)."""
    counts = _counted(final, **{f"n_{s}": F.col("severity") == s for s in SEVERITIES[:3]})
    # of what a row stands for, no more than `first` can be among the first of its change
    early = final if isinstance(final, DataFrame) else final.unfold(final.members.filter(F.col("_place") <= first))
    entry = F.concat(
        F.lit("\n- **["), F.upper("severity"), F.lit("]** "), F.col("title"),
        F.when(F.coalesce("file_path", F.lit("")) != "", F.concat(F.lit(" (`"), F.col("file_path"), F.lit("`)"))).otherwise(""))
    top = top_per_group(early, ["pr_id"], ["emit_seq", "title"], first, "_n").filter(F.col("severity").isin("critical", "high"))
    entries = top.groupBy("pr_id").agg(  # at most `first` rows each
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", entry.alias("entry")))), lambda s: s["entry"]), "").alias("entries"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    band = risk_band(F.col("risk_score"))
    mark = F.when(band == "red", "\U0001F534").when(band == "amber", "\U0001F7E1").otherwise("\U0001F7E2")
    body = F.concat(
        F.lit("## "), mark, F.lit(" Automated Code Review Report\n\n**Risk Score:** "), F.format_string("%.2f", F.col("risk_score")),
        F.lit("/1.0\n\n### Finding Summary\n| Severity | Count |\n|----------|-------|\n| \U0001F534 Critical | "), zero("n_critical"),
        F.lit(" |\n| \U0001F7E0 High | "), zero("n_high"), F.lit(" |\n| \U0001F7E1 Medium | "), zero("n_medium"), F.lit(" |\n\n### Top Findings\n"),
        F.coalesce("entries", F.lit("")))
    return prs.join(counts, "pr_id", "left").join(entries, "pr_id", "left").select("pr_id", "repo_full_name", "pr_number", band.alias("band"), body.alias("body"))


def inline_comments(final: DataFrame | Folded, per_review: int = 50) -> DataFrame:
    """All inline comments, numbered, ``per_review`` to a review; default line 1, right side (Q13).

    A review takes only so many comments, so those beyond go to the change's next review (``review_no`` from 0).
    """
    return _numbered(final, "comment_no").select(
        "pr_id", F.floor((F.col("comment_no") - 1) / per_review).cast("bigint").alias("review_no"), "comment_no", F.col("file_path").alias("path"),
        F.coalesce("line_start", F.lit(1)).alias("line"), F.lit("RIGHT").alias("side"), F.col("description").alias("body"))
