"""Time the headline queries: one JSON line on standard output.

Each query runs alone, cold caches of this library included, and its whole result is
produced (written to Spark's no-op sink). BENCH_ONLY=name,name limits the run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "build_inverted_index", "bm25_search", "dense_search", "hybrid_search", "lexical_rerank", "evaluate_run",
    "dedup_near_text", "find_duplicates", "resolve_entities", "extract_claims", "contradictions", "structural_chunks",
    "semantic_chunks", "coauthors", "related_papers", "topic_growth", "landscape", "stream_health",
)


def main() -> None:
    from folioframe.plans import catalog, registry
    from folioframe.session import local_session

    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    only = os.environ.get("BENCH_ONLY")
    names = only.split(",") if only else HEADLINE
    spark.range(1).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        registry.forget()
        start = time.perf_counter()
        queries[name](spark, root).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(root.rstrip("/")), "cpus": cpus}))


if __name__ == "__main__":
    main()
