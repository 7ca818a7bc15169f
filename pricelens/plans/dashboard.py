"""Operations dashboard: overviews, activity, freshness, health, attention list and event feed, per tenant."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators.ordered import latest_per_key, top_k
from ..sources.catalog import Tables
from .filters import DashboardFilters, time_bucket
from .scope import between, changed, dropped, raised, sequenced

n_if = F.count_if


def filter_stores(t: Tables, f: DashboardFilters) -> DataFrame:
    """Stores of the filter; the category test is a semi-join through listings and matches."""
    st = t.stores
    if f.store_id is not None:
        st = st.where(F.col("store_id") == f.store_id)
    if f.active_only:
        st = st.where(F.col("status") == "active")
    if f.category_id is not None:
        st = st.join(listings_in_category(t, f.category_id).select("store_id", "org_id"), ["store_id", "org_id"], "left_semi")
    return st


def listings_in_category(t: Tables, category_id: str) -> DataFrame:
    own = t.my_products.where(F.col("category_id") == category_id).select("product_id")
    edges = t.matches.join(own, "product_id", "left_semi").select("listing_id", "org_id")
    return t.listings.select("listing_id", "org_id", "store_id").join(edges, ["listing_id", "org_id"], "left_semi")


def filter_listings(t: Tables, f: DashboardFilters) -> DataFrame:
    st = t.stores.select("store_id", F.col("name").alias("store_name"), F.col("status").alias("store_status"))
    if f.active_only:
        st = st.where(F.col("store_status") == "active")
    out = t.listings
    if f.store_id is not None:
        out = out.where(F.col("store_id") == f.store_id)
    out = out.join(st.select("store_id", "store_name"), "store_id")
    if f.category_id is not None:
        out = out.join(listings_in_category(t, f.category_id).select("listing_id"), "listing_id", "left_semi")
    return out


def _stores_in_scope(t: Tables, f: DashboardFilters) -> DataFrame:
    return filter_stores(t, f).select("store_id")


def _moves(t: Tables, f: DashboardFilters, price=True, availability=False) -> DataFrame:
    """Observations from one period earlier on, with their predecessor, limited to the stores in scope."""
    p = f.period(t.as_of)
    snaps = between(t.snapshots, "scraped_at", p.previous_from)
    if f.category_id is not None:
        snaps = snaps.join(listings_in_category(t, f.category_id).select("listing_id"), "listing_id", "left_semi")
    snaps = snaps.join(_stores_in_scope(t, f), "store_id", "left_semi")
    return sequenced(t, snaps, p.previous_from, price=price, availability=availability)


def dashboard_overview(t: Tables, f: DashboardFilters) -> DataFrame:
    p = f.period(t.as_of)
    cur = F.col("scraped_at") >= F.lit(p.date_from)
    moves = _moves(t, f).groupBy("org_id").agg(
        n_if(cur & changed()).alias("price_changes"), n_if(cur & dropped()).alias("price_drops"), n_if(cur & raised()).alias("price_increases"),
        n_if(~cur & changed()).alias("previous_price_changes"), n_if(~cur & dropped()).alias("previous_price_drops"),
        n_if(~cur & raised()).alias("previous_price_increases"),
    )
    every = filter_stores(t, DashboardFilters(f.range, f.store_id, f.category_id, active_only=False)).groupBy("org_id").agg(
        F.count(F.lit(1)).alias("total_competitors"), n_if(F.col("status") == "active").alias("active_competitors")
    )
    scope = _stores_in_scope(t, f)
    listed = t.listings.join(scope, "store_id", "left_semi").groupBy("org_id").agg(
        F.count(F.lit(1)).alias("total_products"),
        n_if(F.col("last_snapshot_availability") == "in_stock").alias("products_in_stock"),
        n_if(F.col("last_snapshot_availability") == "out_of_stock").alias("products_out_of_stock"),
        n_if(F.col("last_scraped_at") >= t.ago(hours=24)).alias("fresh_products"),
    )
    made = F.col("created_at")
    failed = F.col("status") == "failed"
    runs = t.runs.join(scope, "store_id", "left_semi").groupBy("org_id").agg(
        n_if(failed & (made >= F.lit(p.date_from))).alias("failed_runs"),
        n_if(failed & (made >= F.lit(p.previous_from)) & (made < F.lit(p.previous_to))).alias("previous_failed_runs"),
        F.max(F.when(F.col("status").isin("success", "partial"), F.col("finished_at"))).alias("last_successful_crawl"),
    )
    alerts = t.alert_rules.where("active").groupBy("org_id").agg(F.count(F.lit(1)).alias("active_alerts"))
    out = every
    for other in (listed, moves, runs, alerts):
        out = out.join(other, "org_id", "left")
    out = out.na.fill(0)
    for c in ("price_changes", "price_drops", "price_increases", "failed_runs"):
        out = out.withColumn(f"{c}_delta", S.rnd(S.pct_delta(c, f"previous_{c}", None), 4))
    return out.withColumn("freshness", S.freshness_pct("total_products", "fresh_products"))


def availability_overview(t: Tables, f: DashboardFilters) -> DataFrame:
    p = f.period(t.as_of)
    now = filter_listings(t, f).groupBy("org_id").agg(
        n_if(F.col("last_snapshot_availability") == "in_stock").alias("in_stock"),
        n_if(F.col("last_snapshot_availability") == "out_of_stock").alias("out_of_stock"),
        n_if(F.col("last_snapshot_availability").isNull() | (F.col("last_snapshot_availability") == "unknown")).alias("unknown_count"),
    )
    a, b, cur = F.col("availability"), F.col("previous_availability"), F.col("scraped_at") >= F.lit(p.date_from)
    moved = _moves(t, f, price=False, availability=True).groupBy("org_id").agg(
        n_if(cur & (b == "out_of_stock") & (a == "in_stock")).alias("back_in_stock"),
        n_if(cur & (b != "out_of_stock") & (a == "out_of_stock")).alias("newly_unavailable"),
    )
    return now.join(moved, "org_id", "left").na.fill(0)


def competitor_activity(t: Tables, f: DashboardFilters, k: int = 20) -> DataFrame:
    """Each side is aggregated to one row per store first, so no count is multiplied by another side's rows."""
    p = f.period(t.as_of)
    cur = F.col("scraped_at") >= F.lit(p.date_from)
    off = S.dbl(F.col("old_price") - F.col("price")) / S.dbl("old_price") * 100
    moves = _moves(t, f, availability=True).where(cur).groupBy("store_id").agg(
        n_if(changed()).alias("changes"), F.avg(F.when(F.col("old_price") > F.col("price"), off)).alias("avg_discount"),
        n_if(changed("availability", "previous_availability")).alias("stock_changes"),
    )
    listed = t.listings.groupBy("store_id").agg(F.count(F.lit(1)).alias("products_monitored"))
    runs = t.runs.groupBy("store_id").agg(
        n_if((F.col("status") == "failed") & (F.col("created_at") >= F.lit(p.date_from))).alias("failed_runs"),
        F.max(F.when(F.col("status").isin("success", "partial"), F.col("finished_at"))).alias("last_ok_run"),
    )
    j = filter_stores(t, f)
    for other in (listed, moves, runs):
        j = j.join(other, "store_id", "left")
    j = j.na.fill(0, ["products_monitored", "changes", "stock_changes", "failed_runs"])
    if f.failed_only:
        j = j.where(F.col("failed_runs") > 0)
    out = j.select(
        "org_id", "store_id", F.col("name").alias("store_name"), "products_monitored", F.col("changes").alias("changes_in_period"),
        S.rnd(F.coalesce("avg_discount", F.lit(0.0)), 2).alias("average_discount_pct"), "stock_changes", "failed_runs",
        F.greatest("last_successful_scrape_at", "last_ok_run").alias("last_crawl"), "status",
    )
    return top_k(out, ["org_id"], [F.desc("changes_in_period"), F.desc("products_monitored"), F.asc("store_id")], k)


def freshness(t: Tables, f: DashboardFilters) -> DataFrame:
    at = F.col("last_scraped_at")
    g = filter_listings(t, f).where("active").groupBy("org_id").agg(
        F.count(F.lit(1)).alias("total"), n_if(at >= t.ago(hours=24)).alias("fresh"),
        n_if((at < t.ago(hours=24)) & (at >= t.ago(days=7))).alias("stale"), n_if(at < t.ago(days=7)).alias("very_stale"),
        n_if(at.isNull()).alias("never_checked"),
    )
    return g.withColumn("fresh_pct", S.freshness_pct("total", "fresh"))


def health_reasons(rate, failed_24h, broken, sessions, stale):
    """Reasons a monitoring state is not healthy, in fixed order."""
    return F.array_compact(F.array(
        F.when(rate < 70, F.lit("Low scraping success rate")),
        F.when(failed_24h >= 5, F.lit("Multiple failed runs in the last 24h")),
        F.when(broken > 0, F.lit("Broken selectors detected")),
        F.when(sessions > 0, F.lit("Manual captcha sessions waiting")),
        F.when(stale >= 50, F.lit("Many stale products")),
    ))


def health_status(rate, failed_24h, sessions, reasons):
    return (
        F.when((rate < 50) | (failed_24h >= 10) | (sessions >= 3), "critical").when(F.size(reasons) > 0, "warning").otherwise("healthy")
    )


def monitoring_health(t: Tables, f: DashboardFilters) -> DataFrame:
    p = f.period(t.as_of)
    scope = _stores_in_scope(t, f)
    in_period = F.col("created_at") >= F.lit(p.date_from)
    ms = (F.unix_millis("finished_at") - F.unix_millis("started_at"))
    runs = t.runs.join(scope, "store_id", "left_semi").groupBy("org_id").agg(
        n_if(in_period).alias("total_runs"), n_if(in_period & F.col("status").isin("success", "partial")).alias("ok_runs"),
        n_if((F.col("created_at") >= t.ago(hours=24)) & (F.col("status") == "failed")).alias("failed_runs_24h"),
        S.rnd(F.avg(F.when(in_period, ms)), 0).alias("avg_duration_ms"), F.max("created_at").alias("last_run"),
    )
    disc = t.discovery_runs.join(scope, "store_id", "left_semi").groupBy("org_id").agg(F.max("started_at").alias("last_discovery"))
    listed = t.listings.join(scope, "store_id", "left_semi").groupBy("org_id").agg(
        n_if(F.col("selector_failure_count") > 0).alias("broken_selectors"),
        n_if(F.col("active") & (F.col("last_scraped_at").isNull() | (F.col("last_scraped_at") < t.ago(hours=24)))).alias("stale_products"),
    )
    waiting = t.manual_sessions.where(~F.col("status").isin("completed", "cancelled", "expired")).groupBy("org_id").agg(F.count(F.lit(1)).alias("manual_sessions"))
    j = runs
    for other in (disc, listed, waiting):
        j = j.join(other, "org_id", "left")
    j = j.na.fill(0)
    rate = F.when(F.col("total_runs") > 0, S.rnd(S.dbl("ok_runs") / F.col("total_runs") * 100, 0)).otherwise(100.0)
    j = j.withColumn("success_rate", rate)
    j = j.withColumn("_r", health_reasons(F.col("success_rate"), F.col("failed_runs_24h"), F.col("broken_selectors"), F.col("manual_sessions"), F.col("stale_products")))
    j = j.withColumn("status", health_status(F.col("success_rate"), F.col("failed_runs_24h"), F.col("manual_sessions"), F.col("_r")))
    healthy = F.lit("Monitoring is operating normally")
    return j.select(
        "org_id", "success_rate", "failed_runs_24h", "avg_duration_ms", "broken_selectors", "manual_sessions", "stale_products",
        F.greatest("last_run", "last_discovery").alias("last_heartbeat"), "status",
        F.when(F.size("_r") > 0, F.array_join("_r", "; ")).otherwise(healthy).alias("reasons"),
    )


def org_dashboard(t: Tables) -> DataFrame:
    count = lambda df, name, cond=None: df.groupBy("org_id").agg((F.count(F.lit(1)) if cond is None else n_if(cond)).alias(name))
    snaps = between(t.snapshots, "scraped_at", t.as_of - dt.timedelta(days=7)).groupBy("org_id").agg(
        n_if(F.col("scraped_at") >= t.ago(hours=24)).alias("snapshots_24h"), F.count(F.lit(1)).alias("snapshots_7d"))
    out = t.organizations.select("org_id")
    for other in (
        count(t.listings, "monitored_products", F.col("active")), count(t.stores, "active_stores", F.col("status") == "active"),
        count(t.alert_rules, "active_alerts", F.col("active")), count(t.notifications, "unread_notifications", F.col("read_at").isNull()), snaps,
    ):
        out = out.join(other, "org_id", "left")
    return out.na.fill(0)


COUNTED = ["stores", "my_products", "listings", "snapshots", "runs", "matches", "categories", "alert_rules", "notifications", "memberships"]


def org_counts(t: Tables) -> DataFrame:
    parts = [getattr(t, n).groupBy("org_id").agg(F.count(F.lit(1)).alias("rows")).select("org_id", F.lit(n).alias("table"), "rows") for n in COUNTED]
    return reduce(DataFrame.unionByName, parts)


def crawl_health(t: Tables, hours: int = 24) -> DataFrame:
    since = t.ago(hours=hours)
    snaps = t.snapshots.where(F.col("scraped_at") >= since).groupBy("org_id").agg(
        F.count(F.lit(1)).alias("total_snapshots"), n_if(F.col("status") == "ok").alias("ok_snapshots"), n_if(F.col("status") != "ok").alias("failed_snapshots"),
        n_if(F.col("status") == "captcha").alias("captcha_snapshots"), n_if(F.col("confidence") < 0.7).alias("low_confidence_snapshots"),
        S.rnd(F.avg("duration_ms"), 0).alias("avg_duration_ms"),
    )
    stale = t.listings.where(F.col("active")).groupBy("org_id").agg(
        n_if(F.col("last_scraped_at").isNull() | (F.col("last_scraped_at") < t.ago(hours=48))).alias("stale_products"))
    runs = t.runs.groupBy("org_id").agg(n_if((F.col("status") == "failed") & (F.col("created_at") >= since)).alias("failed_runs"))
    counts = ["total_snapshots", "ok_snapshots", "failed_snapshots", "captcha_snapshots", "low_confidence_snapshots", "stale_products", "failed_runs"]
    return t.organizations.select("org_id").join(snaps, "org_id", "left").join(stale, "org_id", "left").join(runs, "org_id", "left").na.fill(0, counts)


def domain_health(t: Tables, previous: DataFrame | None = None, days: int = 7) -> DataFrame:
    """Health per tenant and domain; retries add up over the previous state (full-outer merge)."""
    ok = F.col("status") == "ok"
    # one row per store before the join: a hot domain never meets in one task
    per = t.snapshots.where(F.col("scraped_at") >= t.ago(days=days)).groupBy("store_id").agg(
        F.count(F.lit(1)).alias("n"), n_if(ok).alias("ok"), n_if(F.col("status") == "captcha").alias("captcha"), n_if(~ok).alias("failure"),
        F.sum("duration_ms").alias("ms"), F.count("duration_ms").alias("ms_n"), F.max(F.when(ok, F.col("scraped_at"))).alias("last_ok"),
        F.max(F.when(~ok, F.col("scraped_at"))).alias("last_fail"), n_if(F.col("http_status") == 429).alias("retries"),
    )
    g = per.join(t.stores.select("store_id", "org_id", "domain"), "store_id").groupBy("org_id", "domain").agg(
        *[F.sum(c).alias(c) for c in ("n", "ok", "captcha", "failure", "ms", "ms_n", "retries")], F.max("last_ok").alias("last_success_at"),
        F.max("last_fail").alias("last_failure_at"),
    )
    g = g.withColumn("success_rate", S.rnd(S.dbl("ok") / F.col("n"), 4)).withColumn("captcha_rate", S.rnd(S.dbl("captcha") / F.col("n"), 4))
    plan = F.when(S.dbl("captcha") / F.col("n") > 0.2, "manual_captcha").when(S.dbl("ok") / F.col("n") < 0.7, "playwright_primary").otherwise("auto")
    cur = g.select("org_id", "domain", "success_rate", "captcha_rate", S.rnd(S.dbl("ms") / F.col("ms_n"), 0).alias("avg_response_ms"),
                   F.col("retries").alias("retry_count"), F.col("failure").alias("failure_count"), plan.alias("recommended_strategy"), "last_success_at", "last_failure_at")
    if previous is None:
        return cur
    from ..operators.writes import upsert

    carried = cur.join(previous.select("org_id", "domain", F.col("retry_count").alias("_before")), ["org_id", "domain"], "left")
    merged = carried.withColumn("retry_count", F.col("retry_count") + F.coalesce("_before", F.lit(0))).drop("_before")
    return upsert(previous, merged, ["org_id", "domain"])


def run_rollup(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Run status from its item results; running until every item has reported."""
    done = results.groupBy("run_id").agg(n_if(F.col("succeeded")).alias("ok"), n_if(~F.col("succeeded")).alias("failed"))
    j = runs.select("run_id", "products_total").join(done, "run_id", "left").na.fill(0, ["ok", "failed"])
    status = (
        F.when(F.col("ok") + F.col("failed") < F.col("products_total"), "running").when(F.col("failed") == 0, "success")
        .when(F.col("ok") > 0, "partial").otherwise("failed")
    )
    return j.select("run_id", "ok", "failed", status.alias("status"))


# fixed order of the attention list
ATTENTION_RANK = {"captcha_required": 1, "selector_broken": 2, "extraction_failed": 3, "missing_price": 4, "stale_data": 5}


def attention_issue(failures, status, duplicate, price, last_price, last_scraped, prev_avail, avail, prev_price, as_of_minus_day):
    pct = S.pct_change(price, prev_price)
    return (
        F.when(failures > 0, "selector_broken")
        .when(status == "captcha", "captcha_required")
        .when(status != "ok", "extraction_failed")
        .when(duplicate, "duplicate_product")
        .when(price.isNull() & last_price.isNull(), "missing_price")
        .when(last_scraped.isNull() | (last_scraped < as_of_minus_day), "stale_data")
        .when((prev_avail == "out_of_stock") & (avail == "in_stock"), "back_in_stock")
        .when(~prev_avail.eqNullSafe("out_of_stock") & (avail == "out_of_stock"), "out_of_stock")
        .when(pct <= -5, "price_drop")
        .when(pct >= 5, "price_increase")
    )


def latest_with_prev(t: Tables) -> DataFrame:
    """Newest observation per listing together with the price and availability before it.

    Every task keeps its two newest rows per listing before the shuffle, so a hot listing stays small.
    """
    cols = ["scraped_at", "snapshot_id", "price", "availability", "currency", "confidence", "status"]
    two = top_k(t.snapshots.select("listing_id", *cols), ["listing_id"], [F.desc("scraped_at"), F.desc("snapshot_id")], 2, rank="_r")
    pick = lambda c, r: F.max(F.when(F.col("_r") == r, F.col(c)))
    return two.groupBy("listing_id").agg(
        *[pick(c, 1).alias(c) for c in cols], pick("price", 2).alias("previous_price"), pick("availability", 2).alias("previous_availability"))


def attention(t: Tables, f: DashboardFilters, k: int | None = 50) -> DataFrame:
    scoped = filter_listings(t, f).where("active")
    dup = scoped.groupBy("org_id", "url_hash").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    l = latest_with_prev(t).withColumnsRenamed({"scraped_at": "seen_at", "currency": "seen_currency"})
    j = scoped.join(l, "listing_id", "left").join(dup, ["org_id", "url_hash"], "left")
    issue = attention_issue(
        F.col("selector_failure_count"), F.col("status"), F.col("copies").isNotNull(), F.col("price"), F.col("last_snapshot_price"),
        F.col("last_scraped_at"), F.col("previous_availability"), F.col("availability"), F.col("previous_price"), t.ago(hours=24),
    )
    rank = F.lit(10)
    for name, r in ATTENTION_RANK.items():
        rank = F.when(F.col("issue_type") == name, r).otherwise(rank)
    out = j.withColumn("issue_type", issue).where(F.col("issue_type").isNotNull()).select(
        "org_id", "listing_id", F.coalesce("title", F.lit("Untitled")).alias("product_title"), "store_id", "store_name", "issue_type",
        S.dbl(F.coalesce("price", "last_snapshot_price")).alias("current_price"), S.dbl("previous_price").alias("previous_price"),
        F.coalesce("availability", "last_snapshot_availability").alias("availability"), S.dbl("confidence").alias("confidence"),
        F.coalesce("seen_at", "last_scraped_at").alias("last_checked"), rank.cast("bigint").alias("issue_rank"),
    )
    if k is None:
        return out
    return top_k(out, ["org_id"], [F.asc("issue_rank"), F.asc_nulls_first("last_checked"), F.asc("listing_id")], k)


def movement_timeline(t: Tables, f: DashboardFilters) -> DataFrame:
    cur = F.col("scraped_at") >= F.lit(f.period(t.as_of).date_from)
    return _moves(t, f).where(cur & changed()).groupBy("org_id", time_bucket("scraped_at", f.range).alias("bucket")).agg(
        n_if(dropped()).alias("drops"), n_if(raised()).alias("increases"))


def price_movements(t: Tables, f: DashboardFilters, k: int = 10) -> DataFrame:
    """The ``k`` strongest drops and the ``k`` strongest rises per tenant."""
    cur = F.col("scraped_at") >= F.lit(f.period(t.as_of).date_from)
    pct = S.dbl(F.col("price") - F.col("previous_price")) / F.nullif(S.dbl("previous_price"), F.lit(0.0)) * 100
    m = _moves(t, f).where(cur & changed()).select(
        "org_id", "listing_id", "store_id", "snapshot_id", S.dbl("previous_price").alias("old_price"), S.dbl("price").alias("new_price"),
        S.dbl(F.col("price") - F.col("previous_price")).alias("delta_amount"), S.rnd(pct, 2).alias("delta_pct"), F.col("scraped_at").alias("captured_at"),
    )
    tagged = m.withColumn("direction", F.when(F.col("delta_amount") < 0, "drop").otherwise("increase"))
    best = top_k(tagged, ["org_id", "direction"], [F.abs("delta_pct").desc_nulls_last(), F.desc("captured_at"), F.asc("snapshot_id")], k, rank="position")
    names = t.listings.select("listing_id", F.coalesce("title", F.lit("Untitled")).alias("product_title"))
    st = t.stores.select("store_id", F.col("name").alias("store_name"))
    return best.join(names, "listing_id").join(st, "store_id")


def recent_events(t: Tables, f: DashboardFilters, k: int | None = 50) -> DataFrame:
    """Seven event sources as one feed.  Every source is cut to ``k`` rows per tenant before the union."""
    p = f.period(t.as_of)
    since = F.lit(p.date_from)
    text = lambda c: F.col(c).cast("string")
    st = filter_stores(t, f).select("store_id", F.col("name").alias("store_name"))
    newest = lambda df: df if k is None else top_k(df, ["org_id"], [F.desc("event_at"), F.asc("event_id")], k)
    def feed(df, prefix, key, kind, entity, at, status, href):
        return newest(df.select("org_id", F.concat(F.lit(prefix), text(key)).alias("event_id"), F.lit(kind).alias("type"), entity.alias("entity"),
                                F.col(at).alias("event_at"), status.alias("status"), href.alias("href")))
    cur = _moves(t, f).where((F.col("scraped_at") >= since) & changed())
    if k is not None:
        cur = top_k(cur, ["org_id"], [F.desc("scraped_at"), F.asc(F.col("snapshot_id").cast("string"))], k)
    cur = cur.select("org_id", "snapshot_id", "listing_id", "scraped_at").join(t.listings.select("listing_id", "title"), "listing_id")
    price = feed(cur, "price-", "snapshot_id", "price_changed", F.coalesce("title", F.lit("Product")), "scraped_at", F.lit("neutral"),
                 F.concat(F.lit("/competitors/products/"), text("listing_id")))
    found = t.discovery_products.where(F.col("created_at") >= since).join(t.stores.select("store_id", "org_id"), "store_id").join(st, "store_id", "left_semi")
    found = feed(found, "discover-product-", "product_id", "product_discovered", F.coalesce("title", "url"), "created_at", F.lit("success"),
                 F.concat(F.lit("/competitors/"), text("store_id"), F.lit("/discovery/"), text("run_id"), F.lit("/report")))
    crawl = t.discovery_runs.withColumn("done_at", F.coalesce("finished_at", "started_at")).where(F.col("done_at") >= since).join(st, "store_id")
    crawl = feed(crawl, "crawl-", "run_id", "competitor_crawl_completed", F.col("store_name"), "done_at",
                 F.when(F.col("status").isin("success", "partial"), "success").otherwise("warning"),
                 F.concat(F.lit("/competitors/"), text("store_id"), F.lit("/discovery/"), text("run_id")))
    alert = feed(t.notifications.where(F.col("created_at") >= since), "alert-", "notification_id", "alert_triggered", F.col("title"), "created_at", F.lit("warning"), F.lit("/alerts"))
    captcha = feed(t.manual_sessions.where(F.col("created_at") >= since), "captcha-", "session_id", "captcha_required", F.col("url"), "created_at", F.lit("critical"),
                   F.when(F.col("store_id").isNull(), "/jobs").otherwise(F.concat(F.lit("/competitors/"), text("store_id"), F.lit("/rules"))))
    runs = t.runs.where((F.col("created_at") >= since) & (F.col("status") == "failed")).join(st, "store_id", "left")
    runs = feed(runs, "scrape-failed-", "run_id", "scrape_failed", F.coalesce("store_name", F.lit("Scrape run")), "created_at", F.lit("critical"), F.lit("/jobs"))
    exp = feed(t.exports.where(F.col("created_at") >= since), "export-", "export_id", "export_completed", F.col("kind"), "created_at",
               F.when(F.col("status") == "ready", "success").when(F.col("status") == "failed", "critical").otherwise("neutral"), F.lit("/exports"))
    return newest(reduce(DataFrame.unionByName, [price, found, crawl, alert, captcha, runs, exp]))


def status_counts(df: DataFrame, terminal: list[str], next_run: str) -> DataFrame:
    """Items per status with the number still active, the total and the earliest next run of the tenant.

    The totals are added up from the per-status rows, not from the items again.
    """
    per = df.groupBy("org_id", "status").agg(F.count(F.lit(1)).alias("items"), F.min(F.when(~F.col("status").isin(terminal), F.col(next_run))).alias("_next"))
    total = per.groupBy("org_id").agg(
        F.sum("items").alias("total"), F.sum(F.when(~F.col("status").isin(terminal), F.col("items")).otherwise(0)).alias("active"), F.min("_next").alias("next_run_at"))
    return per.drop("_next").join(total, "org_id")


def filter_options(t: Tables, k: int = 80) -> DataFrame:
    brands = t.my_products.select("org_id", "brand").union(t.listings.select("org_id", "brand"))
    b = brands.groupBy("org_id", F.coalesce("brand", F.lit("Unknown")).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    b = top_k(b, ["org_id"], [F.desc("count"), F.asc("value")], k).select("org_id", F.lit("brand").alias("option"), "value", F.col("value").alias("label"), "count")
    per_cat = t.my_products.groupBy("category_id").agg(F.count(F.lit(1)).alias("count"))
    c = t.categories.select("org_id", "category_id", "name").join(per_cat, "category_id", "left").na.fill(0, ["count"])
    c = c.select("org_id", F.lit("category").alias("option"), F.col("category_id").alias("value"), F.col("name").alias("label"), "count")
    s = stores_with_counts(t).select("org_id", F.lit("competitor").alias("option"), F.col("store_id").cast("string").alias("value"), F.col("name").alias("label"), F.col("listings").alias("count"))
    return b.unionByName(c).unionByName(s)


def stores_with_counts(t: Tables) -> DataFrame:
    per = t.listings.groupBy("store_id").agg(F.count(F.lit(1)).alias("listings"))
    return t.stores.join(per, "store_id", "left").na.fill(0, ["listings"])


def repair_counts(t: Tables) -> DataFrame:
    """Repair attempts of a listing in one run, and the store's attempts of the last hour that were not skipped."""
    same = t.repair_attempts.groupBy("listing_id", "run_id", "store_id").agg(F.count(F.lit(1)).alias("same_run_attempts"))
    hour = t.repair_attempts.where((F.col("created_at") >= t.ago(hours=1)) & (F.col("status") != "skipped"))
    hour = hour.groupBy("store_id").agg(F.count(F.lit(1)).alias("attempts_last_hour"))
    return same.join(hour, "store_id", "left").na.fill(0, ["attempts_last_hour"])


def price_movers(t: Tables, days: int = 7) -> DataFrame:
    """First and last good price of each listing within the last days."""
    good = t.snapshots.where((F.col("scraped_at") >= t.ago(days=days)) & (F.col("status") == "ok") & F.col("price").isNotNull())
    order = F.struct("scraped_at", "snapshot_id")
    g = good.groupBy("listing_id").agg(
        F.max_by("price", order).alias("last"), F.min_by("price", order).alias("first"), F.max_by("currency", order).alias("currency"), F.max("scraped_at").alias("last_at"))
    pct = S.rnd(S.pct_change("last", "first"), 2)
    return g.join(t.listings.select("listing_id", "org_id", "title", "store_id"), "listing_id").select(
        "listing_id", "org_id", "title", "store_id", "currency", S.dbl("last").alias("last_price"), S.dbl("first").alias("old_price"), "last_at", pct.alias("pct_change"))


def top_movers(t: Tables, direction: str = "up", k: int = 5, days: int = 7) -> DataFrame:
    m = price_movers(t, days).where(F.col("pct_change").isNotNull())
    order = F.col("pct_change").desc() if direction == "up" else F.col("pct_change").asc()
    return top_k(m, ["org_id"], [order, F.asc("listing_id")], k, rank="position")
