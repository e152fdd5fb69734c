"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores, BENCH_QUERIES
(comma separated) other queries.  Every result is produced in full and thrown
away; each query is run once to warm up and then timed BENCH_RUNS times (best).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from factlane.catalog.queries import QUERIES  # noqa: E402
from factlane.scale import clear_scratch  # noqa: E402
from factlane.session import local_session  # noqa: E402

HEADLINE = [
    "kb_build", "keyword_intent", "entity_match", "passage_match", "entity_match_blocked", "fuzzy_lookup",
    "rule_qa", "dedupe_first", "dense_ids", "term_idf", "index_postings", "cosine_scores", "retrieve_topk",
    "hybrid_topk", "rag_qa", "tfidf_sublinear", "stratified_split", "classification_report", "svm_evaluate",
    "classification_qa", "ingest_encodings",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session("bench", cpus, partitions=int(cpus), memory=os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in names:
        best = None
        for attempt in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            clear_scratch(spark)
            if attempt:
                best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
