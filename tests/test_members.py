"""Members and entities: own products are never sent whole to every task, and callers collect only what they read."""

import datetime as dt

from pyspark.sql import functions as F

from pricelens.operators.medians import exact_medians
from pricelens.plans import products as P
from pricelens.sources.catalog import Tables

AT = dt.datetime(2024, 5, 1)
DAY = lambda n: AT - dt.timedelta(days=n)
MONEY = "decimal(12,2)"


def _tables(spark):
    # (listing, snapshot, day, price, availability, confidence)
    snaps = [(10, 1, 9, 100.0, "in_stock", 0.9), (10, 2, 5, 99.5, "out_of_stock", 0.9), (11, 3, 8, 7.0, "in_stock", 0.5), (11, 4, 3, None, "in_stock", 0.9),
             (12, 5, 7, 1234567.89, "in_stock", 0.9), (12, 6, 6, 0.05, "in_stock", 0.9)]
    s = spark.createDataFrame([(k, i, DAY(d), p, a, c, 1, 0, "EUR", None, None, "x", "cheerio", None, None) for k, i, d, p, a, c in snaps],
        "listing_id long, snapshot_id long, scraped_at timestamp, price double, availability string, confidence double, store_id long, org_id long, currency string, old_price double, image_url string, status string, source string, shipping_text string, rating double")
    s = s.withColumns({c: F.col(c).cast(MONEY) for c in ("price", "old_price")})
    listed = [(k, 0, 1, f"u{k}", f"t{k}", "b", None, None, None, DAY(1), DAY(1), DAY(20), None, None, None) for k in (10, 11, 12, 13)]
    l = spark.createDataFrame(listed, "listing_id long, org_id long, store_id long, url string, title string, brand string, sku string, gtin string, image_url string, last_scraped_at timestamp, last_change_at timestamp, created_at timestamp, last_snapshot_price double, last_snapshot_currency string, last_snapshot_availability string")
    frames = {
        "snapshots": s, "listings": l.withColumn("last_snapshot_price", F.col("last_snapshot_price").cast(MONEY)),
        # product 101 comes twice, product 103 isn't there, a match may name no product
        "my_products": spark.createDataFrame([(p, 0, f"own {p}", "b", None, f"g{p}", "c", "USD", None, DAY(30), DAY(30)) for p in (100, 101, 101)],
            "product_id long, org_id long, name string, brand string, sku string, gtin string, category_id string, currency string, image_url string, created_at timestamp, updated_at timestamp"),
        "matches": spark.createDataFrame([(10, 0, 100, "confirmed"), (11, 0, 101, "confirmed"), (13, 0, 103, "confirmed"), (13, 0, None, "confirmed"), (12, 0, 100, "rejected")],
            "listing_id long, org_id long, product_id long, status string"),
        "stores": spark.createDataFrame([(1, 0, "shop", "d")], "store_id long, org_id long, name string, domain string"),
        "categories": spark.createDataFrame([("c", "C")], "category_id string, name string"),
    }
    return Tables(spark, frames.__getitem__, AT)


def _joins(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_own_products_are_merged_with_matched_listings_only(spark):
    t = _tables(spark)
    m = P.members(t)
    got = sorted((r["entity_id"] or "", r["listing_id"], r["currency"]) for r in m.collect())
    assert got == [("", 13, "EUR"), ("l12", 12, "EUR"), ("p100", 10, "EUR"), ("p101", 11, "EUR"), ("p101", 11, "EUR"), ("p103", 13, "EUR")]
    merged = [x for x in _joins(m).splitlines() if "SortMergeJoin [product_id" in x]
    assert merged and not [x for x in _joins(m).splitlines() if "BroadcastHashJoin [product_id" in x]


def test_only_the_named_columns_are_collected(spark):
    t = _tables(spark)
    few, every = P.members(t, ["price", "scraped_at"]), P.members(t)
    cols = ["org_id", "entity_id", "listing_id", "store_name", "price", "seen_at"]
    key = lambda df: sorted(map(str, df.select(*cols).collect()))
    assert few.schema == every.schema and key(few) == key(every)
    picked = lambda df, c: [x for x in _joins(df.select(*cols)).splitlines() if "max_by(struct(" in x and c in x]
    assert picked(few, "price") and not picked(few, "confidence") and picked(every, "confidence")


def test_keys_of_entities_need_no_members(spark):
    t = _tables(spark)
    keys, every = P.product_entities(t, False, ["entity_id", "cluster_key"]), P.product_entities(t, False)
    key = lambda df: sorted((r["entity_id"], r["cluster_key"]) for r in df.collect())
    assert key(keys) == key(every.select("entity_id", "cluster_key")) and len(key(keys)) == 4
    assert "max_by(" not in _joins(keys) and "max_by(" in _joins(every)
    assert P.product_entities(t, False, ["entity_id", "volatility"]).columns == ["entity_id", "volatility"]


def test_events_show_two_digits_as_a_formatted_double(spark):
    t = _tables(spark)
    events = P.product_events(t, days=None)
    got = {(r["listing_id"], r["label"]) for r in events.where(F.col("type") == "price_changed").collect()}
    assert got == {(10, "shop: 100.00 -> 99.50"), (12, "shop: 1234567.89 -> 0.05")}
    assert "format_string" not in events._jdf.queryExecution().optimizedPlan().toString()


def test_counted_values_are_merged_with_the_middle_bins(spark):
    rows = [(k, float(v)) for k in (0, 1, None) for v in (1, 2, 2, 9, 30)] + [(5, None)]
    df = exact_medians(spark.createDataFrame(rows, "org_id long, price double"), ["org_id"], "price", "m")
    assert {(r["org_id"], r["m"]) for r in df.collect()} == {(0, 2.0), (1, 2.0), (None, 2.0)}
    assert "BroadcastHashJoin" not in _joins(df) and "SortMergeJoin [_key" in _joins(df)
