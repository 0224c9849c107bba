"""Headline-query timings: prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, optional). Each query is forced in full with a
``noop`` write so no rows are skipped.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["clean_documents", "word_vocab", "encode_documents", "ngram_counts", "perplexity",
            "rouge_l", "generate_greedy", "evaluate_tokens"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    from lexicorn.session import build_session
    from lexicorn.plans.catalog import QUERIES
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": m.group(1) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
