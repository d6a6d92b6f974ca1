"""Times the queries of the catalogue, each once after a warm-up of the session, and prints one JSON line.

The alignments of whole turns, quadratic in their length, come last. No query is begun after BENCH_SECONDS (240); those left are named under not_timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH", "")])

from quillfern.plans import catalogue  # noqa: E402
from quillfern.session import local_session  # noqa: E402

LAST = ("align_stats", "sequence_diff", "token_align")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalogue.queries(), {}
    queries["word_count_by_lang"](spark, sf_dir).count()  # starts executors and code generation, which are no query's own cost
    start, left = time.perf_counter(), []
    for name in sorted(queries, key=lambda n: (n in LAST, n)):
        if time.perf_counter() - start > float(os.environ.get("BENCH_SECONDS", "240")):
            left.append(name)
            continue
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "not_timed": left, "sf": sf_dir.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
