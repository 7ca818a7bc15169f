"""Rows that make long documents, or need much work each, are dealt to many tasks however few bytes they hold."""

import datetime as dt

from pyspark.sql import functions as F

from pricelens.plans import pages as PG
from pricelens.plans import shipments as SH
from pricelens.registry.data import _reports
from pricelens.registry.streams import Feed
from pricelens.session import spread
from pricelens.sources import imports as IM
from pricelens.sources import testdata
from pricelens.sources.folders import Folders
from pricelens.sources.catalog import Tables

LISTING = "listing_id long, store_id long, url string, title string, brand string, sku string, gtin string, last_snapshot_price decimal(12,2), last_snapshot_availability string"


def _tables(spark):
    # as an aggregate leaves them: a few kilobytes that adaptive execution would merge into one task
    rows = [(k, k % 5, f"https://store{k % 5}.example/p/{k // 5}", f"thing {k}", "Brand", f"SKU{k}", None, None, "in_stock") for k in range(400)]
    listings = spark.createDataFrame(rows, LISTING).groupBy("listing_id", "store_id").agg(*[F.max(c).alias(c) for c in (f.split()[0] for f in LISTING.split(", ")[2:])])
    found = spark.createDataFrame(
        [(k // 5, k % 5, f"u{k}", f"n{k}", f"t{k}", 1.5, f"c{k % 3}", f"C{k % 3}") for k in range(400)],
        "run_id long, store_id long, url string, normalized_url string, title string, price double, category_url string, category_path string").repartition("url")
    return Tables(spark, {"listings": listings, "discovery_products": found}.__getitem__, dt.datetime(2024, 5, 1))


def _filled(df):
    """Tasks that hold rows, and the rows."""
    sizes = [n for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    return len(sizes), sum(sizes)


def test_product_pages_meet_many_tasks(spark):
    tasks, rows = _filled(testdata.product_pages(_tables(spark), None).select("page_id"))
    assert (tasks, rows) == (8, 400)


def test_reports_meet_many_tasks(spark):
    tasks, rows = _filled(_reports(_tables(spark)))
    assert (tasks, rows) == (8, 80)


def test_equal_and_null_keys_stay(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,), (2,)], "k long")
    assert sorted((r["k"] or 0) for r in spread(df, "k").collect()) == [0, 0, 1, 1, 2]


def test_elements_are_found_wherever_their_attribute_stands(spark):
    docs = ['<p itemprop="price" content="7,50">x</p>', "<SPAN ITEMPROP = 'PRICE'>8,50 €</SPAN>", "itemprop='price' 9,50", None, '<b class="big\nprice">1.234,50 €</b><i itemprop="name">A</i>', "<p>itemprop</p>"]
    pages = spark.createDataFrame([(k, "https://shop.example/p", d) for k, d in enumerate(docs)], "page_id long, url string, html string")
    got = {r["page_id"]: r["heur"]["price"] if r["heur"] else None for r in PG.readings(pages, ("heur",)).collect()}
    assert got == {0: 7.5, 1: 8.5, 2: None, 3: None, 4: 1234.5, 5: None}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_report_is_parsed_once_for_a_table(spark):
    report = '{"run_id":1,"store_id":2,"pages":[],"categories":[{"url":"c","name":"C"}],"products":[{"url":"u","title":"t","price":1.005,"categoryUrl":"c"},{"url":"v","categoryUrl":"d"}],"logs":[{"message":"m"}]}'
    docs = spark.createDataFrame([(report,), ("{",), (None,), ('{"run_id":3}',)], "report string").repartition(2)
    tables = IM.flatten_report(docs)
    assert {n: _plan(t).count("from_json(") for n, t in tables.items()} == {"pages": 1, "categories": 1, "products": 2, "logs": 1}
    assert sorted((r["run_id"], r["url"], r["title"], r["category_id"]) for r in tables["products"].collect()) == [(1, "u", "t", "1|c"), (1, "v", None, None)]
    assert [tuple(r) for r in tables["logs"].collect()] == [(1, 0, "info", "m")]


def test_reports_are_whole_documents(spark):
    text = [r["report"] for r in _reports(_tables(spark)).collect()]
    whole = IM.flatten_report(spark.createDataFrame([(x,) for x in text], "report string"))
    assert {n: t.count() for n, t in whole.items()} == {"pages": 400, "categories": 80 * 3, "products": 400, "logs": 80 * 600}
    assert all(x.endswith('{"level":"info","message":"step 600"}]}') for x in text)


def test_tracking_pages_meet_many_tasks_and_are_searched_once(spark):
    docs = spark.createDataFrame([(k, f"page {k}") for k in range(400)] + [(None, None), (None, None)], "doc_id long, text string").coalesce(1)
    pages = testdata.tracking_pages(None, lambda name: docs)
    assert _filled(pages) == (8, 402)
    assert _plan(SH.classify_tracking(pages)).count("regexp_instr(") == len(SH.STATUS_PHRASES)
    rows = [(1, "N1", "n1 label created, then Delivered"), (2, "N1", "n1 captcha delivered"), (3, "N1", "delivered"), (4, "", "x"), (5, None, "In transit"), (6, "N1", None), (7, "N1", "n1")]
    got = SH.classify_tracking(spark.createDataFrame(rows, "page_id long, tracking_number string, text string")).select("page_id", "state", "status_hint")
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, "success", "registered"), (2, "captcha", None), (3, "irrelevant", None), (4, "irrelevant", None), (5, "success", "in_transit"), (6, "irrelevant", None), (7, "irrelevant", None)]


def test_a_part_arrives_in_many_files_and_is_one_batch(spark):
    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(k, at + dt.timedelta(hours=k)) for k in range(400)] + [(400, None)], "k long, ts timestamp").repartition(4)
    feed = Feed(Tables(spark, {}.__getitem__, at))
    stream = feed.arriving(rows, "ts")
    assert len([n for n in Folders(spark).names(f"{feed.path}/in") if n.endswith(".parquet")]) == 4
    seen = []
    feed.run(stream, lambda df, epoch: seen.append((epoch, sorted(r["k"] for r in df.collect()))))
    Folders(spark).delete(feed.path)
    assert [e for e, _ in seen] == [0, 1, 2, 3] and sorted(k for _, b in seen for k in b) == list(range(401))
    assert all(max(set(a) - {400}) < min(b) for (_, a), (_, b) in zip(seen, seen[1:]))
