"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR: folder of tables; BENCH_CPUS: cores. Each query is written to the no-op sink, so all of its rows are made.
"""

from __future__ import annotations

import json
import os
import time

from stowage.plans import registry
from stowage.session import session

HEADLINE = ("hash_registry", "hash_hex", "dedup_report", "archive_stats", "meta_merge", "validate_archive", "join_extract", "join_mirror_coalesce", "join_hash_cache", "index_build", "query_by_size_range", "search_image_metadata", "folder_size", "pipe_group", "pipe_flatmap", "result_grep", "sector_addressing", "embedded_offsets", "ignore_filter")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.queries(), {}
    run = lambda n: queries[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run(HEADLINE[0])  # compiles what all share
    for name in HEADLINE:
        began = time.time()
        run(name)
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "master": f"local[{cpus}]", "memory": "8g"}))


if __name__ == "__main__":
    main()
