"""Maintained sums equal the queries over the facts that are left."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from changelens.operators import metrics as A
from changelens.operators import rollups as R
from changelens.plans import dashboard as D
from changelens.session import work_dir
from changelens.sources import views as V

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def sums(spark):
    return D.kept_sums(spark, SF)


def test_dashboards_equal_those_of_the_facts(spark, sums):
    facts, prs = V.finding_facts(spark, SF), V.pr_facts(spark, SF)
    assert rows(R.daily_trend(sums, D.AS_OF, 400)) == rows(A.daily_trend(facts, D.AS_OF, 400))
    assert rows(R.breakdown(sums, D.AS_OF, 400)) == rows(A.breakdown(facts, D.AS_OF, 400))
    assert rows(R.top_repositories(sums, D.AS_OF, 400)) == rows(A.top_repositories(prs, facts, D.AS_OF, 400))
    assert rows(R.reviewed_false_positive_rate(sums, D.AS_OF, 400)) == rows(A.reviewed_false_positive_rate(facts, D.AS_OF, 400))
    assert rows(R.agent_performance(D.run_sums(spark, SF), D.RUNS_AS_OF)) == rows(A.agent_performance(V.run_facts(spark, SF), D.RUNS_AS_OF))


def test_a_dashboard_reads_no_facts(sums):
    plan = R.daily_trend(sums, D.AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "finding-sums" in plan and "documents.parquet" not in plan and "lineitem.parquet" not in plan and plan.count("Scan parquet") == 1


def test_compaction_and_order_of_batches(spark):
    facts = V.finding_facts(spark, SF).withColumn("repo_full_name", F.lit("r"))
    path, out = work_dir(spark, "sums"), work_dir(spark, "compacted")
    # a deletion may be stored before the rows that it takes back
    R.apply_batch(R.FINDINGS, path, 0, R.FINDINGS.sums(facts.filter("crc32(finding_id) % 2 = 0"), -1))
    R.apply_batch(R.FINDINGS, path, 1, R.FINDINGS.sums(facts))
    R.apply_batch(R.FINDINGS, path, 2, R.FINDINGS.sums(facts.filter("crc32(finding_id) % 2 = 1"), -1))
    R.compact(spark, R.FINDINGS, path, 1, out)
    assert rows(R.read(spark, R.FINDINGS, out)) == rows(R.read(spark, R.FINDINGS, path)) == []
    assert R.Cube("created_at", ["severity"], {"n": "1"}).sums(facts.filter("false")).count() == 0


def test_whole_days_only(sums):
    with pytest.raises(ValueError):
        R.daily_trend(sums, datetime(1998, 6, 15, 12))
