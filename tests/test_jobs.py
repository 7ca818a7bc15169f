"""Registered queries against DuckDB, imports and exports, and streams against the batch."""

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

import pricelens.registry.all  # noqa: F401
from pricelens.operators.statetable import StateTable
from pricelens.plans import alerts as AL
from pricelens.plans import shipments as SH
from pricelens.registry import base
from pricelens.sources import exports as EX
from pricelens.sources import imports as IM
from pricelens.sources.testdata import bound
from pricelens.streaming import jobs as J
from pricelens.streaming import state as ST
from tests.compare import compare

SMALL = "/root/testdata/sf0.001"
SAMPLE = [
    "d01_overview_kpis", "d03_market_trend", "d04_competitor_analytics", "d05_category_analytics", "d14_competitor_activity", "h05_attention_list", "h01_product_entities", "h06_clusters",
    "j02_match_suggestions", "j08_discovered_dedup", "m01_change_detection", "l07_provider_health", "k03_link_graph", "k09_structured_products", "a05_import_listings",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_duckdb(spark, name):
    assert compare(name, spark, SMALL) is None


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 200


def test_hot_listings_change_nothing(spark):
    spark.conf.set("spark.pricelens.hotRows", "4")
    try:
        assert compare("e02_price_lag", spark, SMALL) is None
        assert compare("c14_prior_good_value", spark, SMALL) is None
    finally:
        spark.conf.unset("spark.pricelens.hotRows")


def test_seed_history(spark):
    s = IM.seed_snapshots(spark, dt.datetime(2024, 1, 31))
    assert s.count() == 62
    assert s.where("listing_id = 2 AND availability = 'out_of_stock'").count() == 5


def test_csv_import_and_export(spark, tmp_path):
    csv = tmp_path / "in.csv"
    csv.write_text("sku,name,brand,gtin,price\n A1 , One ,b,,12.5\n,No sku,,,\nA1,Again,,,\nB2,Two,,,x\n")
    rows = IM.read_csv(spark, str(csv), IM.MY_PRODUCT_CSV).withColumn("org_id", F.lit(1).cast("bigint"))
    new, rejected, counts = IM.import_my_products(rows, spark.createDataFrame([], "org_id bigint, sku string"))
    assert sorted((r["sku"], r["name"], r["my_price"] and float(r["my_price"])) for r in new.collect()) == [("A1", "One", 12.5), ("B2", "Two", None)]
    assert rejected.count() == 1 and counts.first()["imported"] == 3
    for fmt in ("csv", "json", "parquet"):
        EX.write_export(new, str(tmp_path / fmt), fmt)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    assert spark.read.json(str(tmp_path / "json")).count() == 2


OBSERVED = "listing_id long, org_id long, store_id long, snapshot_id long, scraped_at timestamp, status string, price decimal(12,2), old_price decimal(12,2), currency string, availability string, shipping_text string, rating decimal(3,2), image_url string, confidence decimal(3,2), source string"
T0 = dt.datetime(2024, 1, 1)


def seen(spark, rows):
    """(listing, day, snapshot, status, price, availability)"""
    full = [(l, l % 2, 1, i, T0 + dt.timedelta(days=d), st, p if p is None else decimal.Decimal(str(p)), None, "EUR", a, None, None, None, None, "x") for l, d, i, st, p, a in rows]
    return spark.createDataFrame(full, OBSERVED)


@pytest.fixture
def feed(spark, tmp_path):
    """Writes batches of observations as files and runs the stream of changes over what is new."""
    def run(*batches, hot=None):
        for rows in batches:
            seen(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(OBSERVED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("scraped_at", J.WATERMARK)
        J.run_available(stream, ST.change_sink(table, str(tmp_path / "changes"), str(tmp_path / "late")), str(tmp_path / "check"))

    table = ST.listing_table(spark, str(tmp_path / "state"), buckets=4)
    run.table, run.path = table, tmp_path
    return run


def changes(spark, folder):
    return sorted((r["snapshot_id"], r["status"], r["prev_price"] and float(r["prev_price"]), r["prev_availability"]) for r in spark.read.parquet(str(folder / "changes")).collect())


def batch_changes(spark, rows):
    return sorted((r["snapshot_id"], r["status"], r["prev_price"] and float(r["prev_price"]), r["prev_availability"]) for r in AL.detect_changes(seen(spark, rows)).collect())


def history(n_listings=7, n=12, step=40):
    """Observations far apart, some failed, some without price; a listing silent for most of the time."""
    out = []
    for l in range(n_listings):
        for k in range(n):
            if l == 3 and 1 < k < n - 1:
                continue
            status = "parse_failed" if (l + k) % 5 == 0 else "ok"
            price = None if (l * k) % 7 == 3 else 10 + (l * k) % 3
            out.append((l, k * step + l / 10, l * 1000 + k, status, price if status == "ok" else None, ["in_stock", "out_of_stock", None][(k // 2 + l) % 3]))
    return sorted(out, key=lambda r: r[1])


def test_stream_of_several_batches_equals_the_batch(spark, feed):
    """The real watermark of two days, batches months apart, nothing forgotten."""
    rows = history()
    feed(*[rows[k: k + 20] for k in range(0, len(rows), 20)])
    assert changes(spark, feed.path) == batch_changes(spark, rows)
    assert spark.read.parquet(str(feed.path / "late")).count() == 0
    state = {r["listing_id"]: r for r in feed.table.read().collect()}
    for l, r in state.items():
        mine = [x for x in rows if x[0] == l]
        ok = [x for x in mine if x[3] == "ok"]
        priced = [x[4] for x in ok if x[4] is not None]
        assert r["observations"] == len(mine) and r["newest"]["snapshot_id"] == mine[-1][2] and r["previous"]["snapshot_id"] == mine[-2][2]
        assert float(r["price"]) == priced[-1] and r["availability"] == (ok[-1][5] or "unknown") and r["ok_id"] == ok[-1][2]
        assert r["selector_failure_count"] == sum(x[3] == "parse_failed" and x[1] > ok[-1][1] for x in mine)


def test_late_rows_land_beside(spark, feed):
    rows = history()
    cut = len(rows) // 2
    late = rows[cut // 2]
    feed(rows[: cut // 2] + rows[cut // 2 + 1: cut], rows[cut:] + [late])
    assert [r["snapshot_id"] for r in spark.read.parquet(str(feed.path / "late")).collect()] == [late[2]]
    assert changes(spark, feed.path) == batch_changes(spark, [r for r in rows if r != late])


def test_repeated_batches_change_nothing_and_old_versions_go(spark, feed):
    rows = history()
    feed(rows[:30], rows[30:50])
    before, state = changes(spark, feed.path), sorted(map(str, feed.table.read().collect()))
    sink = ST.change_sink(feed.table, str(feed.path / "changes"), str(feed.path / "late"))
    sink(seen(spark, rows[30:50]), feed.table.committed())  # a batch that was committed
    assert changes(spark, feed.path) == before and sorted(map(str, feed.table.read().collect())) == state
    # a batch that failed before its marker: half-written data of the next version is replaced
    seen(spark, rows[:2]).withColumn("hash_bucket", F.lit(0)).write.partitionBy("hash_bucket").parquet(str(feed.path / "state/data/version=2"))
    for k in range(50, len(rows), 10):
        feed(rows[k: k + 10])
    assert changes(spark, feed.path) == batch_changes(spark, rows)
    named = {v for e in feed.table._markers() for v in feed.table._marker(e)["buckets"].values()}
    assert len(feed.table._markers()) == 2 and {int(n.split("=")[1]) for n in feed.table.folders.names(f"{feed.table.path}/data")} <= named | {feed.table.committed()}


def test_only_touched_buckets_are_written(spark, feed):
    feed(history())
    first = dict(feed.table._marker(0)["buckets"])
    feed([(2, 900.0, 99_999, "ok", 77, "in_stock")])
    second = feed.table._marker(1)["buckets"]
    assert sum(v == 1 for v in second.values()) == 1 and {b for b, v in second.items() if v == 0} <= set(first)


def test_hot_listing_in_a_batch(spark, feed):
    rows = [(1, k / 10, k, "ok", 5 + k % 4 // 2, "in_stock") for k in range(200)]
    spark.conf.set("spark.pricelens.hotRows", "16")
    try:
        feed(rows[:90], rows[90:])
        assert changes(spark, feed.path) == batch_changes(spark, rows)
    finally:
        spark.conf.unset("spark.pricelens.hotRows")


def test_health_in_parts_equals_the_whole(spark, tmp_path):
    schema = "check_id long, org_id long, provider string, state string, duration_ms double, checked_at timestamp"
    rows = [(k, k % 2, "ab"[k % 3 % 2], ["success", "error", "captcha", "robots_disallowed"][(k * k + k // 5) % 4], 100.0 + k, T0 + dt.timedelta(hours=7 * k)) for k in range(120)]
    table = StateTable(spark, str(tmp_path / "health"), SH.HEALTH_KEY, 2)
    sink = J.health_sink(table, str(tmp_path / "late"))
    for e, k in enumerate(range(0, 120, 40)):
        sink(spark.createDataFrame(rows[k: k + 40] + (rows[:1] if e == 2 else []), schema), e)
    sink(spark.createDataFrame(rows[:40], schema), 1)  # once more
    got = sorted(map(tuple, SH.health_view(table.read()).collect()))
    assert got == sorted(map(tuple, SH.provider_health(spark.createDataFrame(rows, schema)).collect()))
    assert spark.read.parquet(str(tmp_path / "late")).count() == 1


def test_alert_keys_come_once(spark, tmp_path):
    """Two batches of one day and a replay give each key once; folders of other days aren't read."""
    t = bound(spark, SMALL)
    every = AL.changes_with_context(t).drop("label").withColumn("status", F.lit("ok"))
    day = every
    parts = [day.where(F.col("snapshot_id") % 2 == k) for k in (0, 1)]
    sink = J.alert_sink(t, str(tmp_path / "alerts"), "month")
    for e, k in enumerate((0, 1, 1)):
        sink(parts[k], min(e, 1))
    found = [r["dedup_key"] for r in spark.read.parquet(str(tmp_path / "alerts")).collect()]
    whole = {r["dedup_key"] for r in AL.evaluate_alerts(t, day.join(t.listings.select("listing_id", F.coalesce("title", F.lit("x")).alias("label")), "listing_id")).collect()}
    assert len(found) == len(set(found)) and set(found) == whole and found


def test_registry_names_follow_the_inventory():
    assert all(n[0] in "abcdefghijklmnop" and n[1:3].isdigit() for n in base.REGISTRY)
