"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Tables that several queries share are derived once and timed as `stage:<name>`; every query is
timed from those tables to its last row.  The value is the sum of all of it.
"""

from __future__ import annotations

import json
import os
import time

from kithlink.plans.queries import QUERIES
from kithlink.plans.workspace import Workspace
from kithlink.session import local_session

STAGES = ["cases", "persons", "profiled", "roles", "edges", "components", "profiles", "candidates",
          "members", "pool", "ranked", "run_rows", "run_results", "run_bootstraps", "tests"]
HEADLINE = ["first_per_case", "dense_rowid", "preprocess", "stat_columns", "truncate_clusters", "build_datasets",
            "connected_components", "exact_key_linkage", "block_cosine", "block_dob_edit", "compare_pairs",
            "agreement_levels", "pattern_counts", "em_linkage", "learn_blocks", "score_pairs", "active_linkage", "supervised_linkage",
            "constrained_clusters", "partition_clusters", "many_to_one", "eval_summary", "bootstrap_eval",
            "significance_test", "significance_report", "confidence_intervals"]


def timed(action) -> float:
    start = time.monotonic()
    action()
    return round(time.monotonic() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "kithlink-bench")
    w = Workspace(spark, folder)
    times = {f"stage:{s}": timed(getattr(w, s)) for s in STAGES}
    # the noop sink runs the whole query without moving its rows to the driver
    for name in HEADLINE:
        times[name] = timed(lambda: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save())
    size = {"persons": w.persons().count(), "candidate_pairs": w.candidates().count(),
            "run_rows": w.run_rows().count(), "partitions": int(spark.conf.get("spark.sql.shuffle.partitions"))}
    print(json.dumps({"metric": "linkage study, stages and headline queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                      "size": size}))


if __name__ == "__main__":
    main()
