"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Each query runs once to warm
up and once timed; results go to a no-op sink, so every column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from specflow.catalog import load  # noqa: E402
from specflow.session import build_session  # noqa: E402

HEADLINE = [
    "run_summary",            # parse, correct, validate, route, summarise
    "route_quarantine",
    "error_details",
    "sink_kafka_frame",
    "src_fixed_width",
    "src_json",
    "src_xml_attr",
    "src_csv",                # written, numbered and read as files
    "cor_date",
    "val_cross_field",
    "flow_events_to_file",
    "gen_nacha",
    "join_reconcile",
    "sink_upsert",
    "ledger_transition",
    "dedup_rejects",
    "win_tumbling",
    "win_session",
    "win_cron",
    "metric_rate",
    "metric_hist_quantile",
    "alert_for",
    "join_range_alert",
    "trace_summary",
    "action_chain",
    "flow_daily_close",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("specflow-bench", cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    entries = load()
    times: dict[str, float] = {}
    for name in names:
        for _ in range(2):
            begun = time.perf_counter()
            entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - begun, 3)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    result = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    if "run_summary" in times:
        result["records_per_sec"] = {"run_summary": round(orders / times["run_summary"])}
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
