"""Findings of advisories stay folded until the end: same results as one by one, nothing shuffled or written for each of them."""

import os

import pytest
from pyspark.sql import functions as F

from changelens.operators import findings, scoring
from changelens.plans import review
from tests.test_review import PR
from tests.test_rules import diff_of

ADVISORY = "ecosystem string, name string, version string, id string, summary string, severity array<struct<type:string,score:string>>, aliases array<string>"
LONG = "a-name-longer-than-the-titles-that-count-as-keys"


def changes_of(spark, *diffs):
    """Changes of high risk; ``diffs`` are pairs of an id and a diff."""
    return spark.createDataFrame([(p, "o/r", 1, "auth", 15, 600, 200, d) for p, d in diffs], PR)


def advisories_of(spark, *rows):
    """An advisory for each (ecosystem, name, version, id), every other one serious."""
    return spark.createDataFrame([(*r, f"about {r[3]}", [("CVSS_V3", "9.8" if i % 2 else "4.0")], ["A", "B"]) for i, r in enumerate(rows)], ADVISORY)


@pytest.fixture(scope="module")
def odd(spark):
    files = lambda *parts: "\n".join(diff_of(text, path) for path, text in parts)
    changes = changes_of(
        spark,
        ("plain", files(("app.py", "eval(x)\npassword = 'abcdefgh1'"), ("requirements.txt", "p==1.0\nq==0.1\np==1.0"), ("dev/requirements.txt", "p==1.0\nq==0.1"))),
        ("twice", files(("requirements.txt", "p==1.0"),)), ("twice", files(("requirements.txt", "p==1.0"),)),
        # one id with two diffs: their dependencies have the same place, so their titles are in each other's order
        ("both", files(("requirements.txt", "p==1.0"),)), ("both", files(("package.json", '"p": "1.0",'),)),
        ("long", files(("requirements.txt", f"{LONG}==1.0\n{LONG}==2.0\n{LONG}==3.0\np==1.0"),)),
        # 'CVE in p 1.0: x: y' is a title of either version, and 'CVE in p 1.0: x: z' comes first from the later one
        ("mixed", files(("package.json", '"p": "1.0: x",\n"p": "1.0",\n"q": "2.0",'),)),
        (None, files(("requirements.txt", "q==0.1\np==1.0"),)))
    advisories = advisories_of(
        spark, *[("PyPI", "p", "1.0", f"ADV-{i}") for i in range(12)], *[("PyPI", "q", "0.1", f"ADV-{i}") for i in range(3)], ("PyPI", "p", "1.0", None), ("PyPI", "q", "0.1", None),
        *[("npm", "p", "1.0", i) for i in ("ADV-3x", "x: y", "ADV-a", None)], *[("npm", "p", "1.0: x", i) for i in ("y", "z")], ("npm", "q", "2.0", "ADV-1"),
        *[("PyPI", LONG, v, f"ADV-{v}-{i}") for v in ("2.0", "3.0") for i in range(3)])
    return changes, advisories.unionByName(advisories.filter("id = 'ADV-4'"))


def rows_of(df, *dropped):
    return sorted((tuple(map(str, r)) for r in df.drop(*dropped).collect()))


@pytest.mark.parametrize("title", [None, 50, 12])
def test_same_results_as_one_by_one(spark, odd, title):
    widths = review.Widths(title=title)
    single = review.final_findings(review.raw_findings(*odd, widths), widths).localCheckpoint()
    assert rows_of(review.review(*odd, widths)) == rows_of(single)
    folded = review.stored(review.review(*odd, widths, folded=True), "final-findings")
    assert folded.spans.filter("pr_id = 'plain' AND head = 'CVE in p 1.0: '").count() == (0 if title == 12 else 2)
    assert rows_of(findings.inline_comments(folded)) == rows_of(findings.inline_comments(single))
    heads = scoring.with_risk(odd[0], widths.places).select("pr_id", "repo_full_name", "pr_number", "score_pts", "risk_score")
    counts = findings.agent_counts(review.raw_findings(*odd, widths))
    assert rows_of(findings.agent_counts(review.raw_findings(*odd, widths, folded=True))) == rows_of(counts)
    assert rows_of(review.reports(*odd, widths)) == rows_of(findings.review_reports(heads, single, counts))
    assert rows_of(review.outbox(*odd, widths)) == rows_of(findings.comment_outbox(heads.drop("score_pts"), single))


def shuffled(df):
    """Rows that the shuffles of a finished query wrote."""
    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        own = node.metrics().get("shuffleRecordsWritten")
        below = node.children()
        return (own.get().value() if own.isDefined() else 0) + sum(walk(below.apply(i)) for i in range(below.size()))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.fixture(scope="module")
def popular(spark):
    """30 changes with a dependency that 300 advisories name."""
    changes = changes_of(spark, *[(f"c{i}", diff_of("p==1.0", "requirements.txt")) for i in range(30)])
    return changes, advisories_of(spark, *[("PyPI", "p", "1.0", f"ADV-{i}") for i in range(300)])


def test_final_findings_are_not_shuffled_one_by_one(spark, popular):
    final = review.review(*popular)
    assert len(final.collect()) == 9000 and shuffled(final) < 3000


def test_inline_comments_are_not_shuffled_one_by_one(spark, popular):
    comments = findings.inline_comments(review.review(*popular, folded=True))
    numbers = comments.groupBy("pr_id").agg(F.count("*").alias("n"), F.countDistinct("comment_no").alias("d"), F.max("comment_no").alias("m")).collect()
    assert {(r.n, r.d, r.m) for r in numbers} == {(300, 300, 300)} and len(numbers) == 30
    comments.collect()
    assert shuffled(comments) < 3000


@pytest.mark.parametrize("texts, rows", [(review.reports, 30 * 151), (review.outbox, 30)])
def test_texts_write_no_table_of_all_findings(spark, popular, texts, rows):
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    got = texts(*popular)
    assert len(got.collect()) == rows
    written = [spark.read.parquet(f"{shared}/{d}").count() for d in set(os.listdir(shared)) - before if not d.startswith(".")]
    assert 0 < sum(written) < 3000
