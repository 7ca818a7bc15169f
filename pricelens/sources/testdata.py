"""Binding of the supplied star-schema test tables to the domain tables.

Every table is a projection or an aggregation of the given files, so its size follows theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from .catalog import Tables

_AS_OF: dict[tuple[str, str], object] = {}

SELECTOR_FIELDS = ["titleSelector", "priceSelector", "oldPriceSelector", "availabilitySelector", "imageSelector"]
PROVIDERS = ["ups", "postal_ninja", "parcelsapp", "ship24", "17track", "yanwen"]
STATUSES = ["registered", "in_transit", "customs", "out_for_delivery", "delivered", "exception", "returned", "info_received"]


def bound(spark: SparkSession, sf_dir: str) -> Tables:
    raw = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _AS_OF:
        newest = raw("lineitem").agg(F.max("l_shipdate").cast("timestamp").alias("m"))
        _AS_OF[key] = newest.select((F.col("m") + F.expr("INTERVAL 1 DAY")).alias("a")).first()["a"]
    tables = Tables(spark, lambda name: _BUILDERS[name](tables, raw), _AS_OF[key])
    tables.source_dir = sf_dir
    return tables


def _pick(options: list[str], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index + 1).cast("int"))


def _org(store):
    return F.when(store < 3, 0).otherwise(1).cast("bigint")


def _ordered_at():
    """Order date moved so that the newest order meets the newest observation."""
    return F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 95 DAYS")


def stores(t, raw) -> DataFrame:
    ids = raw("supplier").select((F.col("s_suppkey") % 5).alias("store_id")).distinct()
    s = F.col("store_id")
    return ids.select(
        s,
        _org(s).alias("org_id"),
        F.concat(F.lit("STORE_"), s.cast("string")).alias("name"),
        F.concat(F.lit("store"), s.cast("string"), F.lit(".example")).alias("domain"),
        F.lit("DE").alias("country_code"),
        F.lit("EUR").alias("currency"),
        F.lit(1440).alias("crawl_frequency_minutes"),
        (s == 2).alias("js_required"),
        F.when(s == 4, "paused").otherwise("active").alias("status"),
        F.lit("normal").alias("discovery_preset"),
        _pick(["shopify", "woocommerce", "magento", "custom", "tilda"], s).alias("framework"),
        t.ago(days=2).alias("last_successful_scrape_at"),
    )


def snapshots(t, raw) -> DataFrame:
    q, qty = F.col("l_quantity"), F.col("l_quantity").cast("bigint")
    store = F.col("l_suppkey") % 5
    listing = F.col("l_partkey") * 5 + store
    ext = F.col("l_extendedprice").cast("decimal(12,2)")
    return raw("lineitem").select(
        (
            ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 64 + qty) * 20000000
            + F.round(F.col("l_extendedprice") * 100).cast("bigint")
        ).alias("snapshot_id"),
        _org(store).alias("org_id"),
        listing.alias("listing_id"),
        store.alias("store_id"),
        F.col("l_shipdate").cast("timestamp").alias("scraped_at"),
        F.when(q > 3, (ext * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(12,2)")).alias("price"),
        F.when((q > 3) & (F.col("l_discount") >= 0.05), ext).alias("old_price"),
        F.lit("EUR").alias("currency"),
        F.when(F.col("l_returnflag") == "N", "in_stock").when(F.col("l_returnflag") == "R", "out_of_stock").otherwise("unknown").alias("availability"),
        F.lit(None).cast("string").alias("shipping_text"),
        F.lit(None).cast("decimal(3,2)").alias("rating"),
        F.lit(None).cast("string").alias("title"),
        F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("/img/"), listing.cast("string"), F.lit(".jpg"))).alias("image_url"),
        F.when(q == 1, "captcha").when(q == 2, "blocked").when(q == 3, "parse_failed").otherwise("ok").alias("status"),
        (1 - 5 * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(3,2)").alias("confidence"),
        F.when(F.col("l_linestatus") == "O", "playwright").otherwise("cheerio").alias("source"),
        F.when(q == 2, 403).otherwise(200).alias("http_status"),
        (F.col("l_linenumber") * 100 + qty).cast("int").alias("duration_ms"),
        F.col("l_orderkey").alias("run_id"),
    )


def listings(t, raw) -> DataFrame:
    s = t.snapshots
    order = F.struct("scraped_at", "snapshot_id")
    state = s.groupBy("listing_id", "store_id", "org_id").agg(
        F.min("scraped_at").alias("created_at"),
        F.max("scraped_at").alias("last_scraped_at"),
        F.max(F.when(F.col("status") == "ok", F.col("scraped_at"))).alias("last_change_at"),
        F.max_by(F.struct("price", "currency", "availability", "status"), order).alias("n"),
    )
    part = raw("part").select(F.col("p_partkey").alias("part_id"), "p_name", "p_brand")
    pid = F.col("part_id")
    joined = state.withColumn("part_id", F.floor(F.col("listing_id") / 5)).join(part.hint("merge"), "part_id", "left")
    lid = F.col("listing_id").cast("string")
    url = F.concat(
        F.lit("https://store"), F.col("store_id").cast("string"), F.lit(".example/p/"),
        F.when(pid % 40 == 39, pid - 1).otherwise(pid).cast("string"),
    )
    return joined.select(
        "listing_id", "org_id", "store_id",
        url.alias("url"),
        F.sha2(F.lower(F.trim(url)), 256).alias("url_hash"),
        F.when(pid % 97 != 96, F.col("p_name")).alias("title"),
        F.col("p_brand").alias("brand"),
        F.concat(F.lit("SKU"), pid.cast("string")).alias("sku"),
        F.when(pid % 2 == 0, F.concat(F.lit("G"), pid.cast("string"))).alias("gtin"),
        F.when(pid % 4 != 0, F.concat(F.lit("/img/"), lid, F.lit(".jpg"))).alias("image_url"),
        (pid % 25 != 24).alias("active"),
        "last_scraped_at", "last_change_at",
        (F.col("last_scraped_at") + F.make_dt_interval(days=(F.col("listing_id") % 3 + 1).cast("int"))).alias("next_run_at"),
        F.when(F.col("n.status") == "parse_failed", 1).otherwise(0).alias("selector_failure_count"),
        F.col("n.price").alias("last_snapshot_price"),
        F.col("n.currency").alias("last_snapshot_currency"),
        F.col("n.availability").alias("last_snapshot_availability"),
        "created_at",
    )


def my_products(t, raw) -> DataFrame:
    p = raw("part").withColumn("org_id", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))))
    pid, org = F.col("p_partkey"), F.col("org_id")
    return p.select(
        (pid * 2 + org).alias("product_id"),
        org,
        F.concat(F.lit("SKU"), pid.cast("string")).alias("sku"),
        F.when(pid % 2 == 0, F.concat(F.lit("G"), pid.cast("string"))).alias("gtin"),
        F.col("p_brand").alias("brand"),
        F.col("p_name").alias("name"),
        F.concat(F.lit("c"), org.cast("string"), F.lit("-"), F.col("p_type")).alias("category_id"),
        F.col("p_retailprice").cast("decimal(12,2)").alias("my_price"),
        F.lit("EUR").alias("currency"),
        F.concat(F.lit("https://own.example/"), pid.cast("string")).alias("url"),
        F.lit(None).cast("string").alias("image_url"),
        F.lit(True).alias("active"),
        F.to_timestamp(F.lit("1995-01-01 00:00:00")).alias("created_at"),
        F.to_timestamp(F.lit("1995-01-01 00:00:00")).alias("updated_at"),
    )


def matches(t, raw) -> DataFrame:
    keys = t.snapshots.groupBy("listing_id", "org_id").agg(F.min("scraped_at").alias("created_at"))
    pid = F.floor(F.col("listing_id") / 5)
    cls = pid % 10
    return keys.where(cls < 9).select(
        F.col("listing_id").alias("match_id"),
        "org_id",
        (pid * 2 + F.col("org_id")).alias("product_id"),
        "listing_id",
        F.when(pid % 2 == 0, "gtin").otherwise("sku").alias("method"),
        F.when(pid % 2 == 0, 0.99).otherwise(0.95).cast("decimal(4,3)").alias("confidence"),
        F.when(cls <= 6, "confirmed").when(cls == 7, "suggested").otherwise("rejected").alias("status"),
        F.when(cls != 7, F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("decided_at"),
        "created_at",
    )


def categories(t, raw) -> DataFrame:
    c = raw("part").select("p_type").distinct().withColumn("org_id", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))))
    return c.select(
        F.concat(F.lit("c"), F.col("org_id").cast("string"), F.lit("-"), F.col("p_type")).alias("category_id"),
        "org_id", F.lit(None).cast("string").alias("parent_id"), F.col("p_type").alias("name"), F.lower("p_type").alias("slug"),
    )


def runs(t, raw) -> DataFrame:
    k, store = F.col("o_orderkey"), F.col("o_custkey") % 5
    created = _ordered_at()
    total = (k % 20 + 1).cast("int")
    ok = F.when(F.col("o_orderstatus") == "F", total).when(F.col("o_orderstatus") == "O", F.ceil(total / 2).cast("int")).otherwise(0)
    return raw("orders").select(
        k.alias("run_id"), _org(store).alias("org_id"), store.alias("store_id"),
        F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "partial").otherwise("failed").alias("status"),
        (created + F.expr("INTERVAL 1 MINUTE")).alias("started_at"),
        F.when((F.col("o_orderstatus") != "P") | (k % 4 != 0), created + F.make_dt_interval(mins=(k % 30 + 2).cast("int"))).alias("finished_at"),
        total.alias("products_total"), ok.alias("products_ok"), (total - ok).alias("products_failed"),
        created.alias("created_at"),
    )


def organizations(t, raw) -> DataFrame:
    return t.stores.select("org_id").distinct().select("org_id", F.concat(F.lit("ORG_"), F.col("org_id").cast("string")).alias("name"))


def memberships(t, raw) -> DataFrame:
    c = raw("customer")
    k = F.col("c_custkey")
    orgs = F.when(k % 10 == 0, F.array(k % 2, (k + 1) % 2)).otherwise(F.array(k % 2))
    role = F.when(F.col("c_nationkey") % 3 == 0, "owner").when(F.col("c_nationkey") % 3 == 1, "manager").otherwise("viewer")
    return c.select(F.explode(orgs).alias("org_id"), k.alias("user_id"), role.alias("role"))


def profiles(t, raw) -> DataFrame:
    return raw("customer").select(
        F.col("c_custkey").alias("user_id"),
        F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@example.org")).alias("email"),
        F.col("c_name").alias("full_name"),
    )


def alert_rules(t, raw) -> DataFrame:
    k = F.col("s_suppkey")
    store, org = k % 5, _org(F.col("s_suppkey") % 5)
    types = [
        "competitor_cheaper_than_me", "price_drop_pct", "price_rise_pct", "back_in_stock", "out_of_stock", "my_price_above_market_pct",
    ]
    channels = F.when(k % 2 == 0, F.array(F.lit("in_app"), F.lit("email"))).otherwise(F.array(F.lit("in_app")))
    return raw("supplier").select(
        k.alias("rule_id"), org.alias("org_id"), F.concat(F.lit("rule "), k.cast("string")).alias("name"),
        _pick(types, k % 6).alias("type"),
        F.struct(
            F.when(k % 4 != 0, 5.0 + F.col("s_nationkey")).alias("thresholdPct"),
            F.when(k % 4 == 0, 3.0 + F.col("s_nationkey")).alias("pricePct"),
        ).alias("params"),
        F.when(k % 7 == 3, k * 2 + org).alias("scope_product_id"),
        F.when(k % 7 == 4, k * 5 + store).alias("scope_listing_id"),
        F.when(k % 7 < 3, store).alias("scope_store_id"),
        channels.alias("channels"),
        (k % 11 != 10).alias("active"),
    )


def notifications(t, raw) -> DataFrame:
    k, created = F.col("o_orderkey"), _ordered_at()
    return raw("orders").select(
        k.alias("notification_id"), (F.col("o_custkey") % 2).alias("org_id"), (k % 100).alias("rule_id"),
        F.col("o_custkey").alias("user_id"), F.concat(F.lit("Notice "), F.col("o_orderpriority")).alias("title"),
        F.lit("").alias("body"), F.lit("in_app").alias("channel"), F.lit("sent").alias("status"),
        F.sha1(k.cast("string")).alias("dedup_key"),
        F.when(F.col("o_orderstatus") == "O", created + F.expr("INTERVAL 1 DAY")).alias("read_at"),
        created.alias("created_at"),
    )


def pages(t, raw) -> DataFrame:
    return raw("pages").select("page_id", "url", "html", F.lit(200).alias("http_status"))


def provider_checks(t, raw) -> DataFrame:
    e = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    state = F.when(e.isin("purchase", "click"), "success").when(e == "signup", "captcha").when(e == "view", "not_found").otherwise("failed")
    return raw("events").select(
        F.col("event_id").alias("check_id"), (F.col("user_id") % 2).alias("org_id"), F.col("user_id").alias("shipment_id"),
        _pick(PROVIDERS, F.col("event_id") % 6).alias("provider"), state.alias("state"),
        F.when(state == "success", _pick(STATUSES, k % 8)).alias("status"),
        F.col("value").alias("duration_ms"), F.col("ts").cast("timestamp").alias("checked_at"),
        F.concat(
            F.lit("Shipment "), F.col("user_id").cast("string"), F.lit("\nOrigin country:\n"),
            F.when(k % 5 == 0, "unknown").otherwise(F.concat(F.lit("Country "), (k % 7).cast("string"))),
            F.lit("\nDestination country\nCity "), (F.col("user_id") % 9).cast("string"),
            F.lit("\nparcel in transit\n"), e,
        ).alias("excerpt"),
    )


def shipments(t, raw) -> DataFrame:
    g = raw("events").groupBy("user_id").agg(F.min("ts").cast("timestamp").alias("first_ts"), F.count(F.lit(1)).alias("n"))
    k = F.col("user_id")
    status = _pick(STATUSES[1:] + ["pending"], k % 8)
    return g.select(
        k.alias("shipment_id"), (k % 2).alias("org_id"),
        F.concat(F.lit("1Z"), F.lpad(k.cast("string"), 16, "0")).alias("tracking_number"),
        F.concat(F.lit("Parcel "), k.cast("string")).alias("display_name"),
        (k % 9 != 8).alias("tracking_enabled"),
        status.alias("current_status"), F.lit("registered").alias("previous_status"),
        (F.col("first_ts") + F.make_dt_interval(hours=(k % 48).cast("int"))).alias("next_check_at"),
        F.when(k % 6 == 0, (k % 30).cast("int") * 60).alias("check_interval_override_minutes"),
        F.when(status == "delivered", F.col("first_ts")).alias("delivered_at"),
        F.col("first_ts").alias("last_checked_at"), F.col("first_ts").alias("updated_at"),
    )


def work_items(t, raw) -> DataFrame:
    k, created = F.col("o_orderkey"), _ordered_at()
    prio = (
        F.when(F.col("o_orderpriority").startswith("1"), "critical").when(F.col("o_orderpriority").startswith("2"), "high")
        .when(F.col("o_orderpriority").startswith("5"), "low").otherwise("normal")
    )
    status = _pick(["queued", "running", "succeeded", "partial", "failed", "cancelled", "dead_letter"], k % 7)
    return raw("orders").select(
        k.alias("id"), (F.col("o_custkey") % 2).alias("org_id"),
        F.when(k % 3 == 0, "competitor_scrape").otherwise("shipment_tracking").alias("type"),
        prio.alias("priority"), status.alias("status"),
        F.when(k % 5 != 0, F.concat(F.lit("shipment:"), F.col("o_custkey").cast("string"))).alias("dedupe_key"),
        F.when(k % 4 != 0, F.concat(F.lit('{"inputVersion":1,"shipmentId":"'), (F.col("o_custkey") % 500).cast("string"), F.lit('"}'))).otherwise('{"inputVersion":1}').alias("payload"),
        (created + F.make_dt_interval(hours=(k % 48).cast("int"))).alias("scheduled_at"), created.alias("created_at"),
    )


def settings(t, raw) -> DataFrame:
    """Only organisation 0 has a settings row, so the default has to be applied for the other."""
    return t.organizations.where(F.col("org_id") == 0).select(
        "org_id", F.lit(True).alias("enabled"), F.lit(3).alias("max_concurrent_jobs"), F.lit(720).alias("competitor_interval_minutes")
    )


def selector_versions(t, raw) -> DataFrame:
    k = F.col("p_partkey")
    return raw("part").select(
        k.alias("version_id"), (k % 5).alias("store_id"), _pick(SELECTOR_FIELDS, F.col("p_size") % 5).alias("selector_type"),
        (k + 1).alias("version"), F.concat(F.lit("."), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("selector_value"),
        F.lit("manual").alias("source"), F.lit(0.9).alias("confidence"),
    )


def repair_attempts(t, raw) -> DataFrame:
    s = t.snapshots.where(F.col("status") == "parse_failed")
    return s.select(
        F.col("snapshot_id").alias("attempt_id"), "org_id", "store_id", "listing_id", "run_id",
        _pick(["applied", "failed", "skipped"], F.col("run_id") % 3).alias("status"), F.col("scraped_at").alias("created_at"),
    )


def manual_sessions(t, raw) -> DataFrame:
    s = t.snapshots.where(F.col("status") == "captcha")
    return s.select(
        F.col("snapshot_id").alias("session_id"), "org_id", "store_id",
        F.concat(F.lit("https://store"), F.col("store_id").cast("string"), F.lit(".example/p/"), F.floor(F.col("listing_id") / 5).cast("string")).alias("url"),
        _pick(["waiting_for_manual_action", "browser_opened", "paused", "completed", "cancelled", "expired"], F.col("run_id") % 6).alias("status"),
        F.col("scraped_at").alias("created_at"),
    )


def exports(t, raw) -> DataFrame:
    k = F.col("c_custkey")
    return raw("customer").select(
        k.alias("export_id"), (k % 2).alias("org_id"),
        _pick(["snapshots_csv", "products_csv", "matches_csv", "analytics_xlsx"], k % 4).alias("kind"),
        _pick(["ready", "failed", "queued"], k % 3).alias("status"),
        (t.now - F.make_dt_interval(days=(k % 60).cast("int"))).alias("created_at"),
    )


def discovery_runs(t, raw) -> DataFrame:
    k, store = F.col("o_orderkey"), F.col("o_custkey") % 5
    r = raw("orders")
    created = _ordered_at()
    return r.select(
        k.alias("run_id"), _org(store).alias("org_id"), store.alias("store_id"),
        F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "partial").otherwise("failed").alias("status"),
        created.alias("started_at"), F.when(k % 5 != 0, created + F.make_dt_interval(mins=(k % 90).cast("int"))).alias("finished_at"),
    )


def discovery_products(t, raw) -> DataFrame:
    """Every listing as found by a crawl: the part key appears as SKU, GTIN or EAN, so copies link transitively."""
    l = t.listings
    lid, pid, s = F.col("listing_id"), F.floor(F.col("listing_id") / 5), F.col("store_id")
    run = pid
    return l.select(
        lid.alias("product_id"), run.alias("run_id"), "store_id", "url",
        F.concat(F.lit("https://store"), s.cast("string"), F.lit(".example/p/"), pid.cast("string")).alias("normalized_url"),
        "title", F.col("last_snapshot_price").alias("price"), F.col("last_snapshot_currency").alias("currency"),
        F.col("last_snapshot_availability").alias("availability"), "image_url", "brand",
        F.when(s.isin(0, 1, 3), F.col("sku")).alias("sku"),
        F.when(s.isin(1, 4), F.concat(F.lit("E"), pid.cast("string"))).alias("ean"),
        F.when(s.isin(2, 3, 4), F.col("gtin")).alias("gtin"),
        F.concat(F.lit("shop / "), F.coalesce("brand", F.lit("none"))).alias("category_path"),
        F.concat(F.lit("https://store"), s.cast("string"), F.lit(".example/shop/"), F.lower(F.replace("brand", F.lit("#"), F.lit("")))).alias("category_url"),
        F.array(F.lit("Home"), F.coalesce("brand", F.lit("none")), F.concat(F.lit("S"), s.cast("string"))).alias("breadcrumbs"),
        F.when(F.col("last_snapshot_price").isNull(), 0.5).otherwise(0.8).alias("confidence"),
        F.when(s == 0, "product_detail").otherwise("json-ld").alias("source"),
        F.when(F.col("last_snapshot_price").isNull(), F.array(F.lit("incomplete_card"))).otherwise(F.array().cast("array<string>")).alias("errors"),
        F.col("last_scraped_at").alias("created_at"),
    )


def discovery_pages(t, raw) -> DataFrame:
    p = raw("pages")
    k = F.col("page_id")
    return p.select(
        "page_id", k.alias("run_id"), "url",
        _pick(["crawled", "crawled", "crawled", "queued", "error"], k % 5).alias("status"),
        _pick(["homepage", "category", "product", "content"], k % 4).alias("page_type"),
    )


def discovery_logs(t, raw) -> DataFrame:
    s = t.snapshots.where(F.col("status") != "ok")
    return s.select(
        F.col("snapshot_id").alias("log_id"), "run_id", F.when(F.col("status") == "captcha", "warn").otherwise("error").alias("level"),
        F.col("status").alias("message"), F.col("scraped_at").alias("created_at"),
    )


def discovery_categories(t, raw) -> DataFrame:
    d = t.discovery_products
    return d.groupBy("run_id", F.col("category_url").alias("url")).agg(
        F.min("category_path").alias("path"), F.count(F.lit(1)).alias("products_found")
    ).withColumn("category_id", F.concat_ws("|", F.col("run_id").cast("string"), "url"))


def product_pages(t, raw) -> DataFrame:
    """One product page per listing, carrying its data as JSON-LD, meta tags, an embedded payload or plain text."""
    from .productpages import product_page_html

    return product_page_html(spread(t.listings, "listing_id"))


def tracking_source(t, raw) -> DataFrame:
    return raw("documents").select("doc_id", "text")


def parts(t, raw) -> DataFrame:
    return raw("part")


def tracking_pages(t, raw) -> DataFrame:
    """Every document with a tracking status appended, as a carrier page would show it."""
    k = F.col("doc_id")
    phrases = [
        "Delivered", "Return to sender", "Out for delivery", "Held by customs", "Delivery failed", "In transit",
        "Label created", "Tracking number not found", "Please verify you are human", "Access denied", "Upgrade your plan", "nothing here",
    ]
    number = F.concat(F.lit("1Z"), F.lpad(k.cast("string"), 16, "0"))
    # a file may be one split, and every page needs much work
    return spread(raw("documents").select("doc_id", "text"), "doc_id", "text").select(
        F.col("doc_id").alias("page_id"), _pick(PROVIDERS, k % 6).alias("provider"), number.alias("tracking_number"),
        F.concat(
            F.col("text"), F.lit("\n\n"), F.when(k % 13 == 12, "no number").otherwise(F.lower(number)), F.lit("\n"),
            _pick(phrases, k % 12), F.lit("\n"), _pick(phrases, (k + 5) % 7),
        ).alias("text"),
    )


_BUILDERS = {
    f.__name__: f
    for f in (
        stores, snapshots, listings, my_products, matches, categories, runs, organizations, memberships, profiles, alert_rules,
        notifications, pages, provider_checks, shipments, work_items, settings, selector_versions, repair_attempts,
        manual_sessions, exports, discovery_runs, discovery_products, discovery_pages, discovery_logs, discovery_categories, product_pages, tracking_pages, tracking_source, parts,
    )
}
