"""Row updates, time windows, uncut listings and odd sources."""

from datetime import datetime, timedelta

from changelens.operators import findings, metrics, symbols

AS_OF = datetime(2024, 3, 1)


def test_partial_updates_add_up(spark):
    base = spark.createDataFrame([(1, "pending", 0.1), (2, "pending", 0.2), (3, "queued", None)], "pr_id int, status string, risk double")
    updates = spark.createDataFrame(
        [(1, 1, "completed", None), (1, 2, None, 0.5), (2, 1, "queued", 0.7), (2, 2, "reviewing", None), (9, 1, "queued", None)],
        "pr_id int, seq int, status string, risk double")
    got = findings.patch_rows(base, updates, "pr_id", ["status", "risk"], "seq").orderBy("pr_id").collect()
    assert [tuple(r) for r in got] == [(1, "completed", 0.5), (2, "reviewing", 0.7), (3, "queued", None)]


def test_windows_end_at_as_of(spark):
    times = [AS_OF - timedelta(days=d) for d in (31, 30, 1, 0, -1)] + [AS_OF - timedelta(seconds=1)]
    rows = spark.createDataFrame([(t, "high") for t in times], "created_at timestamp, severity string")
    assert metrics.recent(rows, "created_at", AS_OF, 30).count() == 3
    assert metrics.recent(rows, "created_at", AS_OF, 365).count() == 4
    assert [r["date"] for r in metrics.daily_trend(rows, AS_OF).collect()] == ["2024-01-31", "2024-02-29"]


def test_listings_are_whole_without_a_limit(spark):
    rows = spark.range(450).selectExpr("id AS finding_id", "7 AS pr_id", "timestamp_seconds(id) AS created_at")
    assert metrics.listing(rows, "created_at", "finding_id", pr_id=7).count() == 450
    assert metrics.listing(rows, "created_at", "finding_id", 300, 10).count() == 300
    assert metrics.listing(rows, "created_at", "finding_id", offset=440).count() == 10


def test_odd_sources_are_error_rows(spark):
    odd = [("null", None), ("nul", "x = 1\0"), ("deep", "x = " + "(" * 5000 + ")" * 5000), ("long", "x = " + "1+" * 200000 + "1"),
           ("bad", "def"), ("empty", ""), ("good", "def f(a):\n    return a")]
    rows = symbols.python_structure(spark.createDataFrame(odd, "name_ string, code string"), "code").collect()
    kinds = {r["name_"]: r["kind"] for r in rows}
    assert kinds == {"null": "error", "nul": "error", "deep": "error", "long": "error", "bad": "error", "good": "function"}


def test_symbols_are_uncut_by_default(spark):
    code = "\n".join(f"def func{i}(): pass" for i in range(50))
    row = spark.createDataFrame([(code, "python")], "content string, language string")
    assert len(row.select(symbols.symbols(row.content, row.language).alias("s")).first().s) == 50
    assert len(row.select(symbols.symbols(row.content, row.language, 20).alias("s")).first().s) == 20
