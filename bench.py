"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and
BENCH_QUERIES (comma separated keys; "all" for every query).
"""

from __future__ import annotations

import json
import os
import time

from checks.compare import session
from checks.registry import queries

HEADLINE = (
    "flagship_top_listings",
    "F1_preview_filter",
    "W3_clone_collapse",
    "A1_batch_price_stats",
    "S7_listing_upsert",
    "E_feedback_fold",
    "L10_hide_decided",
    "W9_recommendations",
    "P26_mortgage",
    "L14_nearby_places",
    "L18_attach_scores",
    "W12_due_list",
    "K8_limiter",
    "L2_city_in_text",
    "P34_price_bounds",
    "S12_export_properties",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    everything = queries()
    keys = list(everything) if chosen == "all" else [k for k in chosen.split(",") if k] or list(HEADLINE)
    spark = session(cpus)
    times: dict[str, float] = {}
    for key in keys:
        started = time.time()
        everything[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
