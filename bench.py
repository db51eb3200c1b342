"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line:
{"metric": "headline_total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is forced end to end with the no-op sink (no collect), one
warm-up run, then the median of $BENCH_RUNS timed runs.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "5"))

HEADLINE = [
    "A05_repo_breakdown",
    "X05_changed_files",
    "J01_similar_reviews_scoped",
    "J02_similar_reviews_unscoped",
    "J03_relevant_conventions",
    "J04_functions_in_hunks",
    "F04_delivery_disposition",
    "F05_signature_check",
    "A14_A15_A18_J08_pr_rollup",
    "J05_apply_feedback",
    "J07_context_with_history",
    "P01_P05_function_facts",
]


def _sf(path: str):
    m = re.search(r"sf([0-9.]+)", path)
    return float(m.group(1)) if m else path


def main() -> None:
    import logging
    logging.getLogger("py4j").setLevel(logging.ERROR)
    from revlens.catalog import queries
    from revlens.session import get_session
    spark = get_session(f"local[{CPUS}]", shuffle_partitions=CPUS, app_name="revlens-bench")
    qs = queries()
    extra = [n for n in os.environ.get("BENCH_EXTRA", "").split(",") if n]
    names = [n for n in HEADLINE + extra if n in qs]
    out = {}
    for name in names:
        times = []
        for i in range(RUNS + 1):
            t0 = time.perf_counter()
            qs[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            if i > 0:
                times.append(time.perf_counter() - t0)
        out[name] = round(statistics.median(times), 3)
    try:
        from revlens.streaming.jobs import bench_streaming_upsert
        out["T06_streaming_upsert"] = round(bench_streaming_upsert(spark, SF_DIR), 3)
    except ImportError:
        pass
    total = round(sum(out.values()), 3)
    # end to end: deliveries -> routed -> parsed files -> context -> model -> stored review rows (one run)
    flow = {}
    if os.environ.get("BENCH_FLOW", "1") == "1" and "S12_stored_reviews_from_deliveries" in qs:
        t0 = time.perf_counter()
        df = qs["S12_stored_reviews_from_deliveries"](spark, SF_DIR)
        df.write.format("noop").mode("overwrite").save()
        sec = time.perf_counter() - t0
        files = spark.read.parquet(f"{SF_DIR}/part.parquet").count()
        flow = {"sec": round(sec, 3), "diff_files_in": files}
    print(json.dumps({"metric": "headline_total_sec", "value": total, "unit": "sec", "queries": out,
                      "sf": _sf(SF_DIR), "cpus": CPUS, "runs": RUNS, "end_to_end_review_flow": flow}))
    spark.stop()


if __name__ == "__main__":
    main()
