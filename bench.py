"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run $BENCH_RUNS times (3) into a sink that keeps nothing, and counts with its
median. The first run of a query compiles its plan; a small query before all others starts
the session.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from checks.queries import all_queries
from lexigauge.session import build_session

HEADLINE = [
    "clean_summary",  # cleaning, validation and accounting of events
    "csv_source",  # CSV written, read back and cleaned
    "readability_doc",  # all counts and metrics per document
    "readability_dataset",  # the same per dataset, with distinct words
    "homogeneity",
    "chunks",
    "lang_detect",  # profile learned from all texts, then all texts scored
    "pos_counts",
    "max_arc",
    "template_view",  # full profile of texts and tokens to 86 columns
    "group_rank",  # lineitem: fit, group moments, Mahalanobis, ranking
    "key_differences",
    "group_cov_wide",  # 64 features
    "compare_groups",  # text features by language against conversations
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    seconds = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs):
            started = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(taken), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
