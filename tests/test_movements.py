"""Movements are ranked whole: the list has its twenty, and no limit gives every one."""

import datetime as dt

from pyspark.sql import functions as F

from pricelens.plans import analytics as A
from pricelens.plans.filters import parse_filters
from pricelens.registry import all as _all  # noqa: F401  fills the registry
from pricelens.registry import base
from pricelens.sources.catalog import Tables

T0 = dt.datetime(2024, 5, 1)
LISTING = "listing_id long, org_id long, store_id long, title string, url string, brand string, image_url string, last_scraped_at timestamp, selector_failure_count int, last_snapshot_currency string"


def _tables(spark, n=30):
    seen = [(k * 2 + i, 0, k, 1, T0 + dt.timedelta(hours=i), 100.0 - i * (k + 1), None, "EUR", "in_stock", "ok", 1.0) for k in range(n) for i in (0, 1)]
    money = {c: F.col(c).cast("decimal(12,2)") for c in ("price", "old_price")}
    frames = {
        "snapshots": spark.createDataFrame(seen, "snapshot_id long, org_id long, listing_id long, store_id long, scraped_at timestamp, price double, old_price double, currency string, availability string, status string, confidence double").withColumns(money),
        "listings": spark.createDataFrame([(k, 0, 1, f"t{k}", f"u{k}", "b", None, T0 + dt.timedelta(hours=1), 0, "EUR") for k in range(n)], LISTING),
        "matches": spark.createDataFrame([], "listing_id long, match_id long, product_id long, status string"),
        "my_products": spark.createDataFrame([], "product_id long, name string, brand string, sku string, gtin string, category_id string"),
        "categories": spark.createDataFrame([], "category_id string, name string"),
        "stores": spark.createDataFrame([(1, "S")], "store_id long, name string"),
    }
    return Tables(spark, frames.__getitem__, T0 + dt.timedelta(hours=2))


def test_topk_movements_has_the_whole_list(spark):
    rows = base.REGISTRY["f02_topk_movements"].build(_tables(spark)).collect()
    drops = sorted((r["position"], r["listing_id"]) for r in rows if r["kind"] == "drop")
    assert drops == [(k + 1, 29 - k) for k in range(20)]


def test_movements_beyond_the_list(spark):
    rows = A.product_movements(_tables(spark), parse_filters({"range": "all"}), None).collect()
    drops = sorted((r["position"], r["listing_id"]) for r in rows if r["kind"] == "drop")
    assert drops == [(k + 1, 29 - k) for k in range(30)]
