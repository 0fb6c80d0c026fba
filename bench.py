"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the cores of the local session. Every query
runs in full (all rows and columns are produced and dropped); the value is the sum.
"""

from __future__ import annotations

import json
import os
import time

from flowlens.plans import catalog, models
from flowlens.session import local_session, require_checkpoint_dir

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "class_share", "dedup_count", "null_census", "distinct_census", "numeric_summary", "skew_rank",
    "zero_share", "corr_matrix", "corr_label_rank", "crosstab_topn", "iqr_outliers_items",
    "box_stats_log1p", "histogram_40_items", "onehot_union", "scale_train_test", "seeded_sample",
    "metrics_binary", "metrics_weighted", "anomaly_metrics", "topk_contribution", "waterfall",
    "dt_scores", "lr_scores",
]


def produce(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn) -> float:
    start = time.perf_counter()
    fn()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = local_session(CPUS, "flowlens-bench", shuffle=int(CPUS))
    require_checkpoint_dir(spark)
    produce(catalog.QUERIES["class_share"](spark, SF))  # starts the session's workers
    took = {}
    for name in HEADLINE:
        models.forget_models()
        took[name] = timed(lambda: produce(catalog.QUERIES[name](spark, SF)))
    models.forget_models()
    took["tree_models_fit"] = timed(lambda: models.event_trees(spark, SF))
    took["forest_attribution"] = timed(
        lambda: produce(models.event_attributions(spark, SF, ["random_forest"]))
    )
    rows = models.event_vectors(spark, SF).count()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "attribution_rows_per_sec": round(rows / took["forest_attribution"]),
                "sf": SF.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
