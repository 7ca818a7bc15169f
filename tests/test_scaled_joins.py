"""Joins that must not grow with rules times events, nor send a catalogue to every task."""

import datetime as dt

from pyspark.sql import functions as F

from pricelens.plans import alerts as AL
from pricelens.plans.scope import with_confirmed_match
from pricelens.sources.catalog import Tables

AT = dt.datetime(2024, 5, 1)
RULE = "rule_id long, org_id long, type string, params struct<thresholdPct: double, pricePct: double>, scope_listing_id long, scope_store_id long, scope_product_id long, channels array<string>, active boolean"


def _tables(spark):
    cheap, above, drop = "competitor_cheaper_than_me", "my_price_above_market_pct", "price_drop_pct"
    rule = lambda k, type_, limit=None, listing=None, store=None, product=None, active=True: (k, 0, type_, (limit, None), listing, store, product, ["in_app"], active)
    rules = [
        rule(1, cheap), rule(2, cheap, store=1), rule(3, cheap, store=2), rule(4, cheap, listing=11), rule(5, cheap, product=100), rule(6, cheap, store=1, product=101),
        rule(7, above), rule(8, above, 40.0), rule(9, drop, 1.0), rule(10, drop, 1.0, listing=10, store=2), rule(11, drop, 1.0, active=False), rule(12, above, -20.0), rule(9, drop, 1.0), rule(13, drop, listing=10, product=100),
    ]
    # listing 10 is confirmed for two own products, listing 12 for none
    matches = [(10, 100, "confirmed"), (10, 101, "confirmed"), (11, 101, "confirmed"), (12, 100, "rejected"), (10, 100, "confirmed")]
    own = [(100, 0, "own a", "A", 110.0), (101, 0, "own b", "B", 150.0), (102, 0, "own c", "C", 1.0)]
    frames = {
        "alert_rules": spark.createDataFrame(rules, RULE),
        "matches": spark.createDataFrame(matches, "listing_id long, product_id long, status string").withColumn("match_id", F.col("listing_id")),
        "my_products": spark.createDataFrame(own, "product_id long, org_id long, name string, sku string, my_price double").withColumns(
            {"my_price": F.col("my_price").cast("decimal(12,2)"), "brand": F.lit("b"), "gtin": F.lit("g"), "category_id": F.lit("c")}),
        "categories": spark.createDataFrame([("c", "C")], "category_id string, name string"),
    }
    return Tables(spark, frames.__getitem__, AT)


def _changes(spark):
    rows = [(0, 1, 10, 1, AT, 100.0, 120.0), (0, 1, 10, 2, AT, 140.0, 100.0), (0, 1, 10, 3, AT, 5000.0, 6000.0), (0, 2, 11, 4, AT, 149.0, None), (0, 2, 12, 5, AT, 1.0, 2.0), (0, 1, 10, 6, AT, None, 2.0), (None, 1, 10, 7, AT, 1.0, 2.0), (0, 1, 10, 1, AT, 100.0, 120.0)]
    df = spark.createDataFrame(rows, "org_id long, store_id long, listing_id long, snapshot_id long, scraped_at timestamp, price double, prev_price double")
    money = {c: F.col(c).cast("decimal(12,2)") for c in ("price", "prev_price")}
    return df.withColumns(money | {"availability": F.lit("in_stock"), "prev_availability": F.lit("in_stock"), "currency": F.lit("EUR"), "label": F.lit("x")})


def test_counts_per_rule_equal_the_joined_rows(spark):
    t = _tables(spark)
    events = AL.candidate_events(_changes(spark))
    want = {(r["rule_id"], r["type"], r["n"]) for r in AL.applicable(t.alert_rules, events, t).groupBy("rule_id", "type").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = AL.applicable_counts(t.alert_rules, events, t).collect()
    assert len(want) >= 9 and len(got) == len(want) and {(r["rule_id"], r["type"], r["n"]) for r in got} == want


def test_only_events_near_the_own_price_meet_rules(spark):
    t = _tables(spark)
    events = AL.candidate_events(_changes(spark))
    near = AL.own_price_events(events, t)
    assert {(r["snapshot_id"], r["own_id"], r["type"][:2]) for r in near.collect()} == {
        (1, 100, "co"), (1, 101, "co"), (2, 101, "co"), (4, 101, "co"), (1, 100, "my"), (1, 101, "my"), (2, 101, "my"), (4, 101, "my"), (7, 100, "co"), (7, 101, "co")}
    got = sorted((r["rule_id"], r["snapshot_id"], r["title"]) for r in AL.own_price_alerts(events, t).collect())
    cheap = lambda who: f"Competitor cheaper than own {who}"
    above = lambda who: f"own {who} is above market"
    assert got == sorted([
        (1, 1, cheap("a")), (1, 2, cheap("b")), (1, 4, cheap("b")), (2, 1, cheap("a")), (2, 2, cheap("b")), (3, 4, cheap("b")), (4, 4, cheap("b")), (5, 1, cheap("a")), (5, 2, cheap("b")),
        (6, 1, cheap("a")), (6, 2, cheap("b")), (7, 1, above("a")), (7, 2, above("b")), (8, 1, above("b")), (12, 1, above("a")), (12, 2, above("b")), (12, 4, above("b"))])


def test_own_products_are_merged_however_small_their_file(spark):
    t = _tables(spark)
    rows = with_confirmed_match(spark.createDataFrame([(10,), (12,)], "listing_id long"), t)
    plan = rows._jdf.queryExecution().toString()
    assert any("SortMergeJoin" in line and "product_id" in line for line in plan.splitlines())
    assert sorted((r["listing_id"], r["product_name"] or "") for r in rows.collect()) == [(10, "own a"), (10, "own a"), (10, "own b"), (12, "")]
