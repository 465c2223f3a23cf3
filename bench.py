"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import load  # noqa: E402
from cohortcast.session import build_session, drop_staged  # noqa: E402

WARM_UP = "uplift_decile"  # run once before anything is timed
HEADLINE = [
    "uplift_decile",
    "uplift_cumlift",
    "uplift_auuc",
    "qini_score",
    "uplift_topn_lift",
    "uplift_auuc_mean",
    "treat_sample_balanced",
    "sample_exact_rows",
    "user_kfold",
    "hash_split_3way",
    "psm_match",
    "psm_eval_sample",
    "fill_mean",
    "corr_rank",
    "filter_kl",
    "filter_f",
    "mmd_linear",
    "daily_sum",
    "rolling_stats",
    "price_level_counts",
    "feature_v8",
    "missing_days",
    "classification_report",
    "wape",
    "dedup_keep_first",
    "s_learner_uplift",
    "sinkhorn_by_batch",
    "matched_samples",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        conf={
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = load().queries
    registered[WARM_UP](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    drop_staged(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds over headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
