"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local cores, BENCH_QUERIES a comma-separated
list of registered queries ("all" for every one).
"""

from __future__ import annotations

import json
import os
import time

from tallyrow.catalog import REGISTRY
from tallyrow.session import local_session

HEADLINE = [
    "missing_gap",
    "infer_schema",
    "scan_impressions",
    "block_catalog",
    "clean_scalar_ids",
    "seq_head",
    "time_bucket",
    "fit_log_bounds",
    "assemble_dense",
    "weight_target_day",
    "split_row_cutoff",
    "split_row_gap",
    "split_blocks",
    "aux_windows",
    "history_build",
    "history_lookup",
    "history_stream",
    "id_frequency",
    "seq_len_quantiles",
    "time_diff_quantiles",
    "cvr_by_local_day",
    "value_quantiles",
    "value_cvr_signal",
    "seq_topk_items",
    "window_scoreboard",
    "pairwise_user_user",
    "pairwise_user_item",
    "label_mi",
    "train_test_drift",
    "auc",
    "logloss",
    "slice_quantile",
    "eval_windows",
    "loss_combined_auc",
    "early_stop_step",
    "aux_select",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(REGISTRY) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = local_session(cpus, "tallyrow-bench", spark__ui__showConsoleProgress="false")
    REGISTRY["seq_len"].run(spark, sf_dir).count()  # warms the JVM, not timed
    seconds = {}
    for name in names:
        started = time.perf_counter()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    line = {
        "metric": "total_wall_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
