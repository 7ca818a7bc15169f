"""Headline queries on the test tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

import pricelens.registry.all  # noqa: F401
from pricelens.registry import base
from pricelens.session import get_spark

HEADLINES = [
    "d03_market_trend", "d04_competitor_analytics", "d05_category_analytics", "d06_availability_trend", "d12_dashboard_overview", "e01_latest_snapshot", "e02_price_lag",
    "h01_product_entities", "h03_product_movements", "h05_attention_list", "h06_clusters", "c09_theta_similarity", "j02_match_suggestions", "m01_change_detection",
    "d33_product_daily_rollup", "l07_provider_health", "k03_link_graph",
]
#: Timed and listed, but not part of the total, so that this stays comparable.
OTHERS = ["j05_cross_store_candidates", "j08_discovered_dedup", "k13_extraction_cascade", "k16_merge_cards", "o02_stream_changes", "o05_stream_provider_health"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    base.run("e01_latest_snapshot", spark, sf_dir).limit(1).count()  # warm the JVM
    took = {}
    for name in HEADLINES + OTHERS:
        start = time.perf_counter()
        base.run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took[n] for n in HEADLINES), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
