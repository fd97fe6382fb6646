"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR  folder with the parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    local threads (default: all)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spendlens.plans import QUERIES  # noqa: E402
from spendlens.session import build_session  # noqa: E402

HEADLINE = [
    "a1_sliding_spend", "a2_minute_spend", "a4_hourly_spend_approx", "a5_sessions", "a9_user_metrics",
    "w2_trailing_spend", "m1_anomaly_features", "m5_fraud_features", "g2_behaviour_anomalies", "f1_summary",
    "f2_diversification", "f8_rebalance", "q2_high_fraud_rate", "q3_p95_histogram", "v1_validate", "s6_ingest_defaults",
    "k8_idempotent_insert", "t2_top_k", "d1_chunks", "a14_token_costs", "k2_live_upsert", "x4_live_sessions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    partitions = str(os.cpu_count() if cpus == "*" else int(cpus))
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=partitions,
                          spark__ui__enabled="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()  # start the engine
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
