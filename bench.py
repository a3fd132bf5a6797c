"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from changelens.plans import catalog  # noqa: E402
from changelens.session import build_session  # noqa: E402

HEADLINE = (
    "secrets_by_severity", "r3_owasp", "r10_finding_assembly", "u1_union_of_agents", "review_final_findings", "q1_risk_score", "j9_line_rule_join",
    "d1_diff_lines", "d4_file_chunks", "d8_overlapping_chunks", "e1_manifest_dependencies", "j2_dependency_advisories", "w4_first_wins", "j7_new_minus_existing",
    "a1_a2_a3_summary", "a5_daily_trend", "a7_top_repositories", "j1_findings_with_prs", "q11_enrichment", "v1_chunk_index", "v2_nearest_chunks", "v4_nearest_many",
    "t2_pr_upsert", "t6_server_error_ratio", "t8_latency_quantiles", "d11_complexity_hotspots",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # the test tables are one file of one row group each, which is one task; stored tables of any size have many, so the bench deals them out first
    split_dir = tempfile.mkdtemp(prefix="bench-")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        spark.read.parquet(path).repartition(int(cpus)).write.parquet(f"{split_dir}/{os.path.basename(path)}")
    source_dir, sf_dir = sf_dir, split_dir
    catalog.QUERIES["a15_finding_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # JVM warm-up
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(source_dir.rstrip("/")).removeprefix("sf")}), flush=True)


if __name__ == "__main__":
    main()
