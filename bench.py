"""Headline queries at one scale; prints a single JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
Each query is fully computed into a no-op sink; the better of two runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from millrace.catalog import QUERIES  # noqa: E402
from millrace.session import build_session  # noqa: E402

HEADLINE = (
    "flagship_segment_revenue", "join_inner", "join_multi_key", "join_rollup", "filter_cmp", "groupby_agg",
    "dedupe_subset", "derive", "impute_median", "impute_auto", "outlier_iqr", "scale_robust", "encode_ordinal",
    "pii_mask", "clean_rules", "clean_auto", "win_ffill", "win_interp", "proc_run", "dq_gate", "profile", "q_summary",
    "chart_hist", "corr_fdr", "cat_assoc", "fdr_adjust", "mann_whitney", "ins_outliers", "insights_run", "root_change",
    "ts_resample", "fc_ensemble",
)


def seconds(spark, folder: str, name: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("OFF")
    seconds(spark, folder, HEADLINE[0])
    times = {}
    for name in only or HEADLINE:
        times[name] = round(min(seconds(spark, folder, name) for _ in range(2)), 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
