"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run to completion through the ``noop`` sink (full execution,
nothing collected to the driver). ``value`` is the sum of the query times;
the one-time warm-up on the smallest input is reported as ``warmup_sec``.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shroud.plans.queries import QUERIES  # noqa: E402
from shroud.session import local_session  # noqa: E402

HEADLINE = [
    "scan_documents",
    "load_documents",
    "clean_pages",
    "chunk_recursive",
    "detect_rules",
    "detect_dictionary",
    "mask_documents",
    "findings",
    "payload_parse",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="shroud-bench")
    # One-time start-up (JIT, Python workers, code generation) on the smallest
    # input, reported separately instead of being charged to the first query.
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    t0 = time.perf_counter()
    if os.path.isdir(warm_dir):
        QUERIES["scan_documents"](spark, warm_dir).write.format("noop").mode("overwrite").save()
    warmup = round(time.perf_counter() - t0, 3)
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else None,
        "cpus": int(cpus),
        "warmup_sec": warmup,
    }))


if __name__ == "__main__":
    main()
