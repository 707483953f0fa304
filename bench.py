"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "timeline_filter",
    "timeline_facets",
    "timeline_histogram",
    "timeline_clusters",
    "artifact_family_counts",
    "artifact_kind_pivot",
    "artifact_created_page",
    "catalog_by_name",
    "catalog_classification",
    "search_names",
    "search_phrase",
    "search_ranked",
    "correlation_best_path",
    "correlation_temporal_proximity",
    "correlation_object_groups",
    "graph_walk",
    "entity_cross_case",
    "log_web_findings",
    "session_pairs",
    "integrity_chain",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tracegrid.queries import QUERIES

    QUERIES[HEADLINE[0]](spark, SF_DIR).collect()  # start-up does not count
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
