"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR  table folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    measured runs per query, best counts (default 2)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "usage_cost_daily",
    "usage_request_cost",
    "pii_masked",
    "sentence_split",
    "capture_classes",
    "structured_notes",
    "fact_notes",
    "fact_dedupe",
    "fact_changed_owners",
    "entry_latest_status",
    "job_counters",
    "job_items_latest",
    "entries_search",
    "token_index",
    "claim_parse",
    "claim_normalised",
    "claims_search",
    "rollup_scoped",
    "lww_merge",
    "eval_facts",
]


def main() -> None:
    from capturelake.plans.catalog import QUERIES
    from capturelake.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        # a table of texts is one row group, so one task; dealing its rows is part of every time
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"},
        **{f"spark.capturelake.deal.{table}": cpus for table in ("documents", "conversations")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    # the first run of claims_search also writes the stored claims that it reads
    first: dict[str, float] = {}
    for name in HEADLINE:
        best = None
        for _ in range(runs):
            t0 = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.time() - t0
            first.setdefault(name, round(took, 3))
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(f"{name} {times[name]} (first {first[name]})", file=sys.stderr)
    spark.stop()
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "first_runs": first, "sf": float(sf)}
        )
    )


if __name__ == "__main__":
    main()
