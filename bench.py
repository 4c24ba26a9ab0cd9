"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all cores) set data and threads.
Every result is computed in whole, all columns, and discarded.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from merklake.queries.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "leaf_hash",
    "merkle_root",
    "prefix_roots",
    "tiles_all",
    "hash_index_stats",
    "hash_lookup",
    "inclusion_proof",
    "inclusion_proof_requested_size",
    "inclusion_proof_by_hash",
    "consistency_proof",
    "latest_root",
    "entry_and_proof",
    "leaves_by_range",
    "all_inclusion_proofs",
    "bundle_encode",
    "bundle_decode",
    "ts_metadata_parse",
    "compare_leaves",
    "completeness_gaps",
    "validate_copy",
    "migrate_logs",
    "migrate_grown",
    "compare_by_descent",
    "object_sink_roundtrip",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="bench-"))
        # Few bytes but much hashing per partition: let small shuffles keep all cores busy.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("merkle_root")
    seconds = {}
    for name in names:
        seconds[name] = round(run(name), 3)
        print(name, seconds[name], file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
