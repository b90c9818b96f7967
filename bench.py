"""Time the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Every query runs to completion into the no-op sink, so nothing passes through the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

from lociframe.plans import registry
from lociframe.scale import session

HEADLINE = ["interval_genes", "resolve_symbols", "constraint_mask", "tissue_pivot", "normalize_rank", "consensus_score_rank",
            "borda_rank", "budget_select", "loo_tune", "weight_sensitivity", "merge_exon_blocks", "transcript_design", "cell_qc",
            "gene_moments", "compensation_class", "window_group_signal", "deletion_segments", "linear_response", "group_response",
            "knn_idw", "spearman", "auroc"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    # Start the workers and load the common classes once.
    queries["interval_genes"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        started = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    print(json.dumps({"metric": "headline queries, total wall-clock", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
