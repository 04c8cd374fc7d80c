"""Benchmark headline queries.

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]``, materialising every result with a no-op write (the
whole plan runs, nothing is collected). Reports the median of
``$BENCH_REPEAT`` warm runs per query and prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparkpairs.plans.registry import QUERIES  # noqa: E402
from sparkpairs.session import get_session  # noqa: E402

HEADLINE = [
    "corpus_pairs",          # windows -> bounded pieces -> split -> error chain -> union -> order
    "chunk_corpus",          # paragraph windows + max-word sentence packing
    "insert_errors",         # error chain over whole documents
    "merge_pairs",           # four adapters, union, exact seeded permutation
    "subsample_ceil",        # exact split + exact per-split subsample
    "length_summary",        # chat render + token count + exact percentiles
    "truncation_curve",      # histogram x max-length grid
    "packing_efficiency",    # next-fit packing from the clipped histogram
    "match_by_source",       # exact match, rollup by source
    "running_accuracy",      # chunked running sum
    "early_stop",            # ordinals + running min per run
    "html_to_markdown",      # regex chain over raw pages
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = get_session("sparkpairs-bench", master=f"local[{cpus}]", shuffle_partitions=cpus,
                        extra={"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    run("train_test_split")  # JVM / code-generation warm-up
    per_query, failed = {}, {}
    for name in names:
        try:
            run(name)  # warm
            per_query[name] = round(statistics.median(run(name) for _ in range(repeat)), 3)
        except Exception as e:  # noqa: BLE001 - report and keep measuring the others
            per_query[name] = None
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total_median_sec",
        "value": round(sum(v for v in per_query.values() if v is not None), 3),
        "unit": "sec",
        "queries": per_query,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "repeat": repeat,
        "spark": spark.version,
        **({"failed": failed} if failed else {}),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
