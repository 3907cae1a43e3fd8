"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from binwright.session import build_session
from binwright.workload import QUERIES

HEADLINE = [
    "B9_filter_map", "C1_filtered_count", "C3_distinct_counts", "C6_category_lists", "C7_extract_summary",
    "C8_cell_totals", "C9_packed_counts", "D2_feature_remap", "D3_counts_of_cells", "E3_category_bins",
    "E4_random_bins", "E7_contiguous_ranges", "E11_grouped_plan", "E12_randomized_plan", "F4_cell_permutation",
    "I9_count_matrix_profile", "J3_prepare_extract", "J4_extract_bins", "J5_extract_grouped",
    "F5_randomized_extract", "J1_ingest_counts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
