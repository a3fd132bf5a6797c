"""One positive and one negative line per rule, and the context rules."""

import pytest
from pyspark.sql import functions as F

from changelens.operators import rules as R
from changelens.operators import scan as S
from changelens.sources.exemplars import RULE_SAMPLES

ALL_GROUPS = S.MAIN_GROUPS + S.LIBRARY_GROUPS
_RANGES = [
    (R.QUICK_STATIC, range(0, 5)), (R.LANGUAGE_STATIC, range(5, 24)), (R.OWASP, [*range(24, 32), 21, 22, *range(32, 50)]), (R.SECRETS, range(50, 62)),
    (R.AUTH, range(62, 69)), (R.INJECTION, range(69, 76)), (R.CRYPTO, [10, 11, *range(76, 82)]), (R.CONTROLS, range(82, 87)), (R.RETENTION, range(87, 90)),
]
CASES = [(pack, no, rule, RULE_SAMPLES[i]) for pack, places in _RANGES for (no, rule), i in zip(enumerate(pack.rules, 1), places, strict=True)]


def diff_of(code, path="a.py"):
    return "\n".join([f"diff --git a/{path} b/{path}", f"--- a/{path}", f"+++ b/{path}", *("+" + line for line in code.split("\n"))])


def scan(spark, diffs, groups=ALL_GROUPS):
    rows = spark.createDataFrame([(str(i), d) for i, d in enumerate(diffs)], "pr_id string, diff string")
    return S.scan_changes(rows, groups)


def test_ninety_four_rules():
    assert len(CASES) == 94


@pytest.fixture(scope="module")
def fired(spark):
    diffs = []
    for _, _, rule, (positive, negative) in CASES:
        path = "a.js" if rule.label == "javascript" else "a.py"
        diffs += [diff_of(positive, path), diff_of(negative, path)]
    hits = {}
    for row in scan(spark, diffs).select("pr_id", "rule_id").collect():
        hits.setdefault(int(row.pr_id), set()).add(row.rule_id)
    return hits


@pytest.mark.parametrize("index", range(94))
def test_rule(fired, index):
    pack, no, rule, _ = CASES[index]
    rule_id = f"injection-{rule.label}" if pack is R.INJECTION else f"{pack.name}-{no}"
    assert rule_id in fired.get(2 * index, set())
    assert rule_id not in fired.get(2 * index + 1, set())


def test_prefilter_changes_nothing(spark):
    packs = [R.QUICK_STATIC, R.OWASP, R.SECRETS, R.AUTH, R.INJECTION, R.CRYPTO, R.CONTROLS, R.RETENTION, R.LANGUAGE_STATIC]
    texts = [line for pair in RULE_SAMPLES for text in pair for line in (text, "+" + text, text.upper(), text.lower())]
    lines = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "i int, line string, pair string")
    found = lambda flag: sorted(map(tuple, S.match_rules(lines, "line", packs, flag, "pair").select("i", "pack", "rule_no").collect()))
    assert found(True) == found(False)
    assert {("owasp", no) for no, r in enumerate(R.OWASP.rules, 1) if r.two_line} <= {(pack, no) for _, pack, no in found(True)}
    with pytest.raises(ValueError):
        S.match_rules(lines, "line", packs)


def test_secret_placeholders_and_removed_lines(spark):
    diffs = [diff_of('token = "' + "x" * 24 + '"'), diff_of('password = "changeme1"'), diff_of("a").replace("+a", '-password = "longenough1"')]
    assert scan(spark, diffs, ["secrets"]).count() == 0


def test_long_secret_snippet_is_cut_where_a_width_is_given(spark):
    secret = 'password = "' + "p" * 200 + '"'
    assert scan(spark, [diff_of(secret)], ["secrets"]).first().code_snippet == "+" + secret
    rows = spark.createDataFrame([("0", diff_of(secret))], "pr_id string, diff string")
    row = S.scan_changes(rows, ["secrets"], secret_chars=100).first()
    assert row.code_snippet.endswith("...") and len(row.code_snippet) == 103
    assert row.line_start == 4 and row.confidence_score == 0.95


def test_context_windows(spark):
    fill = "\n".join(["    step()"] * 9)
    cases = {
        "def delete(x):\n" + fill + "\n    step()": True,
        "def delete(x):\n" + fill + "\n    logger.info(x)": False,
        "def delete(x):\n" + fill + "\n    step()\n    logger.info(x)": True,
        "def delete(x):": True,
    }
    hits = {int(r.pr_id) for r in scan(spark, [diff_of(c) for c in cases], ["operations"]).collect()}
    assert hits == {i for i, wanted in enumerate(cases.values()) if wanted}


def test_context_skips_file_headers_however_many(spark):
    # far more headers than the first look-ahead holds: the next code line is still found
    headers = "\n".join(f"+++ b/{i}.py" for i in range(60))
    diff = diff_of("def refund(x):") + "\n" + headers + "\n+    audit(x)"
    assert scan(spark, [diff], ["audit"]).count() == 0


def test_privacy_rules(spark):
    lines = ["logger.info(email)", "print(ip_address)", "send(email)", "save_email(v)", "save_email(encrypt(v))", "run(user_data)", "run(user_data, consent)",
             "requests.post(u, json=user)", "requests.get(u)", "catalog.email"]
    counts = dict(scan(spark, [diff_of(x) for x in lines], S.GDPR_GROUPS).groupBy("pr_id").count().collect())
    assert counts == {"0": 1, "1": 2, "3": 1, "5": 1, "7": 1, "9": 1}


def test_deep_groups_need_risk(spark):
    rows = spark.createDataFrame([("a", diff_of("x = eval(md5(s))"), 30), ("b", diff_of("x = eval(md5(s))"), 29)], "pr_id string, diff string, score_pts int")
    found = S.scan_changes(rows, deep_when=F.col("score_pts") >= 30).select("pr_id", "agent_type").distinct().collect()
    assert sorted(map(tuple, found)) == [("a", "security_audit"), ("a", "static_analysis"), ("b", "static_analysis")]


def test_scan_does_not_shuffle(spark):
    plan = scan(spark, [diff_of("x")])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
