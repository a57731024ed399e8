"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from shutterlake.operators.vector_index import index_of
from shutterlake.plans.registry import QUERIES
from shutterlake.session import build
from shutterlake.sources import driver

HEADLINE = [
    "rank_best_photos", "peak_percentile", "signature_stats", "purity_exemplars", "descriptors", "suggest_next", "best_score",
    "catalog_search", "facet_counts", "top_tags", "unscored_active", "coverage", "work_triples", "bursts", "burst_representative",
    "pending_suggestions", "knn_topk", "similarity_groups", "fts_search", "sync_missing", "upsert_latest", "supersede", "log_stats", "log_tail",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ["PYTHONPATH"] = os.path.dirname(os.path.abspath(__file__)) + ":" + os.environ.get("PYTHONPATH", "")
    spark = build(f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    # the first query also starts Python workers and compiles shared code
    QUERIES["rank_best_photos"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    # indexes are built once for a table and kept; their cost is told apart from the searches'
    for name, make in (("build_text_index", lambda: driver.text_index(spark, sf_dir)), ("build_vector_index", lambda: index_of(driver.vectors(spark, sf_dir).select("key", "embedding")))):
        began = time.perf_counter()
        make()
        took[name] = round(time.perf_counter() - began, 3)
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        print(name, took[name], file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))


if __name__ == "__main__":
    main()
