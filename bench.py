"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs to completion through the ``noop`` sink (the whole plan executes, nothing
is collected to the driver). The first query also pays JVM / session warm-up, so a small
warm-up query runs before timing starts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "build_cases",
    "classify_intent",
    "conversation_roots",
    "topk_retrieval",
    "escalation_decisions",
    "leakage_safe_cases",
    "tfidf",
    "clean_replies",
    "judge_scores_six",
    "agent_batch",
    "classification_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from supportflow.plans.queries import queries
    from supportflow.session import ensure_checkpoint_dir, get_spark, ship_package

    spark = get_spark(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")),
                      app="supportflow-bench")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    qs = queries()
    names = sys.argv[1:] or HEADLINE
    qs["head_n"](spark, sf_dir).write.format("noop").mode("overwrite").save()   # warm-up
    times = {}
    for name in names:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
