"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data (default sf 0.1), ``BENCH_CPUS`` the cores (default all) and
``BENCH_RUNS`` the timed runs of which the median counts (default 3).
"""

from __future__ import annotations

import json
import os
import statistics
import time

from vacantia.plans.queries import QUERIES
from vacantia.session import local_session

HEADLINES = (
    "skill_trends_all", "extract_skills_hard", "extract_skills_synonyms", "corpus_skill_trends",
    "dedup_postings", "skill_cooccurrence", "source_profile", "html_fallback_postings",
    "weak_labels", "nb_train", "nb_predict", "detect_language", "skill_ols", "eval_report",
)


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores, app="bench")
    times = {}
    for name in HEADLINES:
        run(spark, name, folder)  # code generation and file listing
        times[name] = round(statistics.median(run(spark, name, folder) for _ in range(runs)), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": int(cores), "runs": runs}))


if __name__ == "__main__":
    main()
