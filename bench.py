"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH", "")])

HEADLINE = [
    "campaign_statistics", "participant_rollup", "participant_channel_summary", "message_type_exposure_pivot", "channel_totals", "zip_engagement_top20",
    "conversion_funnel", "ctr_ranking", "savings_histogram", "cascade_best_match", "score_cascade_match", "or_aggregate_contacts", "last_wins_dedupe",
    "join_fallback_group_mean", "stratified_split", "median_impute", "feature_matrix", "normalize_address", "html_to_text", "text_conversation_fold",
    "template_group_sets", "chi_square_yates", "silhouette_exact", "hdi_interval", "rhat", "upsert_merge_flags",
]


def main() -> None:
    from canvass.queries import queries
    from canvass.session import build

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build("bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    known, took = queries(), {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):  # the first run warms up
            start = time.perf_counter()
            known[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
