"""Headline queries over the benchmark tables; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]

Every query runs twice into a sink that reads all rows; the second, warm run is reported.
"""

import json
import os
import sys
import time

from examlake.plans.queries import REGISTRY
from examlake.session import local_session

HEADLINE = [
    "std_typed",
    "clean_valid",
    "clean_duplicates",
    "clean_report",
    "class_rows",
    "class_summary",
    "year_stats",
    "geo_municipality",
    "geo_state",
    "score_histogram",
    "income_box",
    "state_bands",
    "dim_municipality",
    "race_means",
    "geo_page",
    "municipal_evolution",
    "radar",
    "bands_municipality",
    "race_history",
    "small_domain",
    "checks",
    "pipeline_states",
]


def run(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", "16g", **{"spark.sql.shuffle.partitions": cpus})
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        run(spark, sf_dir, name)
        seconds[name] = round(run(spark, sf_dir, name), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, warm, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
