"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
BENCH_QUERIES may list other names, or "all".
"""

from __future__ import annotations

import json
import os
import time

from parley.catalog import QUERIES
from parley.session import local_session

HEADLINE = (
    "eval_by_dataset context_text context_length intervention_label stratified_split "
    "balanced_subset length_batches threshold_sweep bootstrap_ci words_hist document_words_hist "
    "wide_ratings majority_label self_consistency label_share_dataset agreement_summary "
    "clean_documents frequent_phrases tfidf characteristic_phrases nonempty_multiuser "
    "chunks_of_six escalation_percentile csv_round_trip batch_score weighted_head"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    chosen = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    names = list(QUERIES) if chosen == ["all"] else chosen
    spark = local_session(cpus, "parley-bench", "16g", **{"spark.ui.showConsoleProgress": "false"})
    # One warm-up, so the first query does not pay for starting the engine.
    QUERIES["sample_counts"](spark, sf_dir).collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
