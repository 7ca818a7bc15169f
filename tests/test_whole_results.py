"""Results beyond the limits that lists, keys and payloads once had."""

import datetime as dt
import json
import random
import statistics

from pyspark.sql import functions as F

from pricelens.functions import text as X
from pricelens.functions import urls as U
from pricelens.operators.medians import exact_medians
from pricelens.plans import pages as PG
from pricelens.plans import shipments as SH
from pricelens.sources import imports as IM
from pricelens.sources.testdata import bound
from pricelens.streaming import jobs as J

SMALL = "/root/testdata/sf0.001"


def test_exact_medians(spark):
    rng = random.Random(1)
    rows = [(g, rng.choice([None, 0.0, -3.5, 2.25, round(rng.uniform(-50, 500), 2)])) for g in ("a", "b", None) for _ in range(rng.randint(40, 60))]
    rows += [("one", 7.0), ("two", 1.0), ("two", 2.0), ("none", None)] + [("hot", 5.0)] * 3000 + [("hot", 9.0)] * 3000
    df = spark.createDataFrame(rows, "g string, v double")
    want = {g: round(statistics.median([v for k, v in rows if k == g and v is not None]), 3) for g in {g for g, _ in rows} - {"none"}}
    got = {r["g"]: r["m"] for r in exact_medians(df, ["g"], "v", "m", digits=3).collect()}
    assert got == want
    counted = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    assert {r["g"]: r["m"] for r in exact_medians(counted, ["g"], "v", "m", "n", 3).collect()} == want


def test_product_keys_use_all_tokens(spark):
    words = " ".join(f"word{k}" for k in range(15))
    row = spark.createDataFrame([(words + " alpha", words + " omega")], "a string, b string").select(
        X.product_key("a", F.lit("x")).alias("a"), X.product_key("b", F.lit("x")).alias("b"), X.product_key("a", F.lit("x"), 10).alias("c")).first()
    assert row["a"] != row["b"] and row["a"].endswith("alpha") and len(row["c"].split("-")) <= 10


def test_search_text_is_whole(spark):
    row = spark.createDataFrame([("y" * 500,)], "q string").select(U.search_url(F.col("q"), F.lit("shop.example")).alias("u")).first()
    assert "y" * 500 in row["u"]


def test_payload_of_many_products_at_any_depth():
    tree = {"items": [{"name": f"p{k}", "price": k + 1} for k in range(600)]}
    assert len(list(PG.walk(tree))) == 600
    deep = {"title": "deep", "price": "3,50", "offers": {"price": 9}, "brand": {"name": "b"}, "images": [{"src": "i.jpg"}]}
    for _ in range(12):
        deep = {"x": [deep]}
    found = list(PG.walk(deep))
    assert found == [{"title": "deep", "price": 3.5, "currency": None, "product_url": None, "image_url": "i.jpg", "sku": None, "ean": None, "gtin": None, "brand": "b"}]
    parent = {"title": "p", "price": True, "cost": 2, "child": {"name": "c", "priceValue": "0"}}
    assert list(PG.walk(parent)) == []


def test_payload_table(spark):
    html = '<script id="__NEXT_DATA__" type="application/json">' + json.dumps([{"name": f"p{k}", "price": k + 1} for k in range(600)]) + "</script>"
    pages = spark.createDataFrame([(1, html, "https://a.example/x")], "page_id long, html string, url string")
    assert PG.payload_products(pages).count() == 600


def test_breadcrumbs_and_page_links(spark):
    nav = '<nav aria-label="breadcrumb">' + "".join(f'<a href="/c{k}">name {k}</a>' for k in range(14)) + "</nav>"
    links = "".join(f'<a href="/l?page={k}">{k}</a>' for k in range(1, 31))
    pages = spark.createDataFrame([(1, nav + links, "https://a.example/")], "page_id long, html string, url string")
    assert len(pages.select(PG.breadcrumbs("html").alias("b")).first()["b"]) == 14
    assert PG.pagination(pages).count() >= 30 and PG.pagination(pages, 20).count() == 20


def test_every_check_counts_in_provider_health(spark):
    start, s, n = dt.datetime(2024, 1, 1), 0.0, 1000
    rows = []
    for k in range(n):
        state = "success" if k % 3 else "failed"
        s = float(state == "success") if k == 0 else s * 0.8 + 0.2 * (state == "success")
        rows.append((k, 1, "p", state, float(k), start + dt.timedelta(hours=k)))
    checks = spark.createDataFrame(rows, "check_id long, org_id long, provider string, state string, duration_ms double, checked_at timestamp")
    assert sorted(r["k"] for r in SH.newest_first(checks, ["org_id", "provider"]).collect()) == list(range(1, n + 1))
    assert abs(SH.provider_health(checks).first()["success_rate"] - round(s, 4)) < 1e-9


def test_excerpts_and_evidence(spark):
    text = "\n".join(f"delivered line {k}" for k in range(900)) + "\nNO1"
    row = spark.createDataFrame([(text, "NO1")], "t string, n string").select(SH.excerpt("t", "n").alias("e"), SH.evidence("t").alias("s"), SH.excerpt("t", "n", 50, 10).alias("w")).first()
    assert row["e"].startswith("delivered line 0\n") and row["e"].endswith("[TRACKING_NUMBER]") and row["s"].count("·") >= 899 and row["w"].endswith("[TRACKING_NUMBER]")


def test_import_errors_and_logs(spark):
    rows = spark.createDataFrame([(1, 1, k, "no url", "t") for k in range(30)], "org_id long, store_id long, row_no long, url string, title string")
    errors = IM.import_listings(rows, spark.createDataFrame([], "store_id long, url_hash string"))[1]
    assert errors.count() == 30
    report = json.dumps({"run_id": 1, "store_id": 1, "pages": [], "categories": [], "products": [], "logs": [{"level": "info", "message": str(k)} for k in range(700)]})
    logs = IM.flatten_report(spark.createDataFrame([(report,)], "report string"))["logs"]
    assert logs.count() == 700


def test_alerts_over_several_batches_equal_the_batch(spark, tmp_path):
    """Changes in three micro-batches: every rule type and scope, each key once."""
    from pricelens.plans import alerts as AL

    t = bound(spark, SMALL)
    changes = AL.detect_changes(t.snapshots).select(
        "listing_id", "org_id", "store_id", "snapshot_id", "scraped_at", "status", F.col("price").cast("double").alias("price"), "availability", "currency",
        F.col("prev_price").cast("double").alias("prev_price"), "prev_availability")
    for k in range(3):
        changes.where(F.pmod("snapshot_id", F.lit(3)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    J.run_available(stream, J.alert_sink(t, str(tmp_path / "out")), str(tmp_path / "check"))
    got = [r["dedup_key"] for r in spark.read.parquet(str(tmp_path / "out")).select("dedup_key").collect()]
    assert len(got) == len(set(got)) and set(got) == {r["dedup_key"] for r in AL.evaluate_alerts(t).select("dedup_key").collect()}
