"""Headline queries, one JSON line: seconds per query on local[$BENCH_CPUS] over $BENCH_SF_DIR.

Each query runs once to warm up and then three times (BENCH_RUNS), and the median counts; a query that takes over
BENCH_LONG seconds (8) runs once after it is warm. jobs and shuffle_mb are those of the first run. BENCH_QUERIES=all times every
registered query once.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from cuesheet.plans.registry import all_queries
from cuesheet.session import local_session

HEADLINE = [
    "sample_group_compare", "rank_group_compare", "capped_extremes", "knn_similar", "midrank_percentile",
    "nearest_event_offset", "scene_summary", "line_repeat_first", "clause_scrub", "corpus_search", "content_digest",
    "build_feature_row", "claims_taste", "scene_blueprint", "context_at", "embedding_neighbours", "spearman_pairs",
]


def seconds(spark, q, sf: str) -> float:
    start = time.perf_counter()
    q.run(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def shuffled(spark) -> int:
    """Bytes written to shuffles so far."""
    found = spark._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=max(2, int(cpus)) if cpus.isdigit() else 8, app="bench")
    known = all_queries()
    every = os.environ.get("BENCH_QUERIES") == "all"
    times: dict[str, float] = {}
    jobs: dict[str, int] = {}
    moved: dict[str, float] = {}
    for name in list(known) if every else HEADLINE:
        q = known[name]
        spark.sparkContext.setJobGroup(name, name)
        before = shuffled(spark)
        first = seconds(spark, q, sf)
        time.sleep(0.2)  # the listener is asynchronous
        jobs[name] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        moved[name] = round((shuffled(spark) - before) / 1e6, 1)
        runs = 1 if first > float(os.environ.get("BENCH_LONG", "8")) else int(os.environ.get("BENCH_RUNS", "3"))
        times[name] = round(first if every else statistics.median(seconds(spark, q, sf) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": sf.rsplit("sf", 1)[-1].strip("/"), "jobs": jobs, "shuffle_mb": moved,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
