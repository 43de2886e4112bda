"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tablelore.operators import profiling
from tablelore.session import local_session
from tablelore.workload import inputs
from tablelore.workload.queries import QUERIES

HEADLINE = ("table_row_counts", "column_nulls", "column_uniqueness", "duplicate_rows", "numeric_stats", "sample_values",
            "clean_strings", "parse_dates", "infer_types", "relationship_map", "pii_values", "pii_documents", "drift",
            "schema_hash", "parse_responses", "table_rollup")


def run(df) -> None:
    """Compute every row and column of a result without bringing it to the driver."""
    df.write.format("noop").mode("overwrite").save()


def full_profile(spark, sf):
    """Every statistic of every column of every table, over all rows."""
    return profiling.column_profiles(inputs.load(spark, sf))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, "tablelore-bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    rows = sum(r.row_count for r in QUERIES["table_row_counts"](spark, sf).collect())  # also warms the session up
    times = {}
    for name, query in {"full_profile": full_profile, **{n: QUERIES[n] for n in HEADLINE}}.items():
        start = time.perf_counter()
        run(query(spark, sf))
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()  # no query may live on frames another one kept
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf.rstrip("/").split("sf")[-1], "rows": rows,
                      "rows_profiled_per_sec": round(rows / times["full_profile"])}))
    spark.stop()


if __name__ == "__main__":
    main()
