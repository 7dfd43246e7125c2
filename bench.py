"""Headline timings: prints one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores.

Every entry starts without relations or models kept from an earlier one, so each pays for its own inputs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from panelkit.models import trees as T  # noqa: E402
from panelkit.operators import metrics as M  # noqa: E402
from panelkit.plans import frames as B  # noqa: E402
from panelkit.plans import model_queries, registry  # noqa: E402
from panelkit.session import build_session, clean_up  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

RELATIONAL = [
    "s1_parse_pages", "j1_outer_join_pivot", "j2_region_lookup", "a4_missing_summary", "a7_quartiles", "a9_descriptive_table",
    "a10_segment_summary", "p8_drop_sparse_columns", "p10_iqr_filter", "p11_zscore_filter", "f8_shipped_specs",
    "i1_mean_impute", "i2_median_impute", "i3_knn_impute", "r1_split", "a14_extended_metrics", "a24_error_boxes",
    "q2_comprehensive_metrics", "q3b_pairwise_tests_full", "w7_normal_plot", "a17_bootstrap_summary", "x4_spearman",
    "x6_permutation_drops", "q18_comparison_report",
]


def score(spark, key: str) -> DataFrame:
    """Train a model at its default settings and score both splits."""
    model = T.train(key, model_queries.train_rows(spark, SF_DIR), B.FEATURES, "target", "row_id")
    return M.regression_metrics(T.predict_long({key: model}, model_queries.split_rows(spark, SF_DIR), "row_id", "target"))


def training() -> dict:
    names = {"decision_tree": "train_decision_tree", "random_forest": "train_random_forest_200", "gradient_boosting": "train_gradient_boosting_200",
             "xgboost": "train_depthwise_boosting_200", "lightgbm": "train_leafwise_boosting_200"}
    return {name: (lambda s, k=key: score(s, k)) for key, name in names.items()} | {
        "bootstrap_100_replicates": lambda s: model_queries.bootstrap_intervals(s, SF_DIR)}


def main() -> None:
    spark = build_session(f"local[{CPUS}]", "panelkit-bench", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    runs = {name: (lambda s, n=name: registry.QUERIES[n](s, SF_DIR)) for name in RELATIONAL}
    runs.update(training())
    B.table(spark, SF_DIR, "lineitem").agg(F.sum("l_quantity")).collect()  # start the executor threads
    timings: dict[str, float] = {}
    for name, run in runs.items():
        B.forget_written()
        model_queries.forget_models()
        start = time.time()
        run(spark).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - start, 3)
        print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))
    clean_up(spark)
    spark.stop()


if __name__ == "__main__":
    main()
