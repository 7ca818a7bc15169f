"""Analytics centre: market, competitor, category, availability, quality and movement analyses.

Every result is keyed by ``org_id``; one plan serves all tenants at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators.medians import exact_medians
from ..operators.ordered import top_k
from ..sources.catalog import Tables
from .filters import Filters, time_bucket
from .scope import (
    between, changed, confirmed_matches, discount0, dropped, enriched_scope, entity_key, latest_scope, raised, sequenced, snapshot_scope,
    store_names,
)

n_if = F.count_if


def downsample(df: DataFrame, max_points: int, order: str = "bucket") -> DataFrame:
    """Every n-th row of each tenant's series, at most ``max_points``."""
    from pyspark.sql import Window

    w = Window.partitionBy("org_id")
    ranked = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    step = F.ceil(F.col("_n") / max_points)
    kept = ranked.where((F.col("_n") <= max_points) | ((F.col("_i") % step == 0) & (F.col("_i") / step < max_points)))
    return kept.drop("_i", "_n")


def market_trend(t: Tables, f: Filters) -> DataFrame:
    low = f.period(t.as_of).date_from
    scoped = snapshot_scope(t, f, low)
    seq = sequenced(t, scoped, low).where(F.col("price").isNotNull())
    medians = exact_medians(scoped.select("org_id", time_bucket("scraped_at", f.range).alias("bucket"), "price"), ["org_id", "bucket"], "price", "median_price")
    trend = seq.groupBy("org_id", time_bucket("scraped_at", f.range).alias("bucket")).agg(
        S.mean("price").alias("average_price"),
        S.dbl(F.min("price")).alias("min_price"),
        S.dbl(F.max("price")).alias("max_price"),
        S.rnd(F.avg(discount0()), 2).alias("average_discount"),
        n_if(dropped()).alias("drops"),
        n_if(raised()).alias("increases"),
        n_if(changed()).alias("changes"),
    )
    cols = ["org_id", "bucket", "average_price", "median_price", "min_price", "max_price", "average_discount", "drops", "increases", "changes"]
    return trend.join(medians, ["org_id", "bucket"], "left").select(*cols)


def overview(t: Tables, f: Filters) -> DataFrame:
    """One row per tenant with every measure of the period and of the one before."""
    p = f.period(t.as_of)
    both = snapshot_scope(t, f, p.previous_from)
    cur = F.lit(True) if p.date_from is None else F.col("scraped_at") >= F.lit(p.date_from)
    both = both.withColumn("is_cur", cur)
    seq = sequenced_with_period(t, both, p.previous_from)
    measures = {}
    for tag, in_period in (("", F.col("is_cur")), ("previous_", ~F.col("is_cur"))):
        hit = lambda c, in_period=in_period: n_if(in_period & c)
        measures |= {
            f"{tag}rows": n_if(in_period),
            f"{tag}priced": hit(F.col("price").isNotNull()),
            f"{tag}price_sum": F.sum(F.when(in_period, F.col("price"))),
            f"{tag}discount_sum": F.sum(F.when(in_period & F.col("price").isNotNull(), discount0())),
            f"{tag}discounted": hit(F.col("old_price") > F.col("price")),
            f"{tag}in_stock": hit(F.col("availability") == "in_stock"),
            f"{tag}out": hit(F.col("availability") == "out_of_stock"),
            f"{tag}low_conf": hit(F.col("confidence") < 0.7),
            f"{tag}changes": hit(changed()),
            f"{tag}drops": hit(dropped()),
            f"{tag}raises": hit(raised()),
            f"{tag}stock_changes": hit(F.col("previous_availability") != F.col("availability")),
            f"{tag}failed": hit(F.col("status") != "ok"),
        }
    # one row per listing first: the distinct counts below become plain counts
    per_listing = seq.groupBy("org_id", "store_id", "listing_id").agg(*[c.alias(k) for k, c in measures.items()])
    def mean_of(total, count, digits=2):
        return S.rnd(S.dbl(F.sum(total)) / F.sum(count), digits)
    aggs = []
    for tag in ("", "previous_"):
        c = lambda k, tag=tag: F.col(f"{tag}{k}")
        aggs += [
            F.count_distinct(F.when(c("rows") > 0, F.col("store_id"))).alias(f"{tag}active_competitors"),
            mean_of(c("price_sum"), c("priced")).alias(f"{tag}avg_price"),
            mean_of(c("discount_sum"), c("priced")).alias(f"{tag}avg_discount"),
            F.sum(c("changes")).alias(f"{tag}price_changes"),
            F.sum(c("drops")).alias(f"{tag}price_drops"),
            F.sum(c("raises")).alias(f"{tag}price_increases"),
            F.sum(c("stock_changes")).alias(f"{tag}stock_changes"),
            F.sum(c("failed")).alias(f"{tag}failed_extractions"),
        ]
    aggs += [
        n_if(F.col("previous_discounted") > 0).alias("previous_discounted_products"),
        n_if(F.col("previous_in_stock") > 0).alias("previous_in_stock_products"),
        n_if(F.col("previous_out") > 0).alias("previous_out_of_stock_products"),
        n_if(F.col("previous_low_conf") > 0).alias("previous_low_confidence_products"),
    ]
    periods = per_listing.groupBy("org_id").agg(*aggs)
    before = per_listing.where(F.col("previous_rows") > 0).join(confirmed_matches(t), "listing_id", "left")
    before = before.groupBy("org_id").agg(F.count_distinct(entity_key()).alias("previous_total_products"))
    medians = exact_medians(both, ["org_id", "is_cur"], "price", "m").groupBy("org_id").agg(
        F.max(F.when(F.col("is_cur"), F.col("m"))).alias("median_price"), F.max(F.when(~F.col("is_cur"), F.col("m"))).alias("previous_median_price"))
    stale = F.col("last_scraped_at").isNull() | (F.col("last_scraped_at") < t.ago(hours=24))
    now = latest_scope(t, f).groupBy("org_id").agg(
        F.count_distinct(entity_key()).alias("total_products"),
        n_if(F.col("old_price") > F.col("price")).alias("discounted_products"),
        n_if(F.col("availability") == "in_stock").alias("in_stock_products"),
        n_if(F.col("availability") == "out_of_stock").alias("out_of_stock_products"),
        n_if(stale).alias("stale_products"),
        n_if(F.col("confidence") < 0.7).alias("low_confidence_products"),
        n_if(F.col("last_scraped_at") >= t.ago(hours=24)).alias("fresh_products"),
    )
    alerts = t.alert_rules.where("active").groupBy("org_id").agg(F.count(F.lit(1)).alias("active_alerts"))
    out = now
    for other in (periods, before, medians, alerts):
        out = out.join(other, "org_id", "left")
    counts = [c for c in out.columns if c != "org_id" and not c.endswith(("_price", "avg_discount"))]
    return out.select(
        "org_id", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts], *[c for c in out.columns if c not in counts and c != "org_id"]
    )


def sequenced_with_period(t: Tables, both: DataFrame, low) -> DataFrame:
    """Previous values that never reach across the border between the two periods."""
    from ..operators.ordered import with_previous

    sizes = between(t.snapshots, "scraped_at", low).select("listing_id", "scraped_at")
    values = {"previous_price": "price", "previous_availability": "availability", "_prev_cur": "is_cur"}
    seq = with_previous(both, values, sizes=sizes)
    same = F.col("_prev_cur") == F.col("is_cur")
    for c in ("previous_price", "previous_availability"):
        seq = seq.withColumn(c, F.when(same, F.col(c)))
    return seq.drop("_prev_cur")


# fixed list: label, measure, previous measure, status rule
KPIS = [
    ("Total analyzed products", "total_products", "previous_total_products", "neutral"),
    ("Total active competitors", "active_competitors", "previous_active_competitors", "neutral"),
    ("Average market price", "avg_price", "previous_avg_price", "neutral"),
    ("Median market price", "median_price", "previous_median_price", "neutral"),
    ("Average discount", "avg_discount", "previous_avg_discount", ("above", 15, "warning", "neutral")),
    ("Products with discounts", "discounted_products", "previous_discounted_products", "warning"),
    ("Products in stock", "in_stock_products", "previous_in_stock_products", "good"),
    ("Out of stock products", "out_of_stock_products", "previous_out_of_stock_products", ("above", 0, "warning", "good")),
    ("Price changes today", "price_changes", "previous_price_changes", "neutral"),
    ("Price drops today", "price_drops", "previous_price_drops", "good"),
    ("Price increases today", "price_increases", "previous_price_increases", "warning"),
    ("Stock changes today", "stock_changes", "previous_stock_changes", "warning"),
    ("Stale products", "stale_products", None, ("above", 0, "warning", "good")),
    ("Low confidence products", "low_confidence_products", "previous_low_confidence_products", ("above", 0, "warning", "good")),
    ("Failed extractions", "failed_extractions", "previous_failed_extractions", ("above", 0, "critical", "good")),
    ("Active alerts", "active_alerts", "active_alerts", "neutral"),
    ("Data freshness score", "freshness", None, ("below", 70, "warning", "good")),
]


def kpi_deltas(t: Tables, f: Filters) -> DataFrame:
    row = overview(t, f).withColumn("freshness", S.freshness_pct("total_products", "fresh_products"))
    items = []
    for i, (label, cur, prev, rule) in enumerate(KPIS):
        value = F.coalesce(S.dbl(cur), F.lit(0.0))
        if isinstance(rule, tuple):
            kind, limit, yes, no = rule
            status = F.when(value > limit if kind == "above" else value < limit, yes).otherwise(no)
        else:
            status = F.lit(rule)
        money, pct = cur in ("avg_price", "median_price"), cur == "avg_discount"
        if money:
            text = S.format_currency(F.col(cur), F.lit("EUR"))
        elif pct:
            text = S.format_pct(value)
        else:
            text = F.concat(F.format_number(value, 0), F.lit("%" if cur == "freshness" else ""))
        delta = S.pct_delta(value, F.coalesce(S.dbl(prev), F.lit(0.0))) if prev else F.lit(None).cast("double")
        items.append(
            F.struct(
                F.lit(i + 1).cast("bigint").alias("position"), F.lit(label).alias("label"), value.alias("numeric_value"),
                text.alias("value"), status.alias("status"), delta.alias("delta"),
            )
        )
    kpis = row.select("org_id", F.inline(F.array(*items)))
    points = downsample(market_trend(t, f), f.max_points)
    # at most max_points entries per tenant
    spark_line = points.groupBy("org_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("bucket", "average_price"))), lambda x: F.coalesce(x["average_price"], F.lit(0.0)).cast("decimal(12,2)").cast("string")), "|"
        ).alias("sparkline")
    )
    return kpis.join(spark_line, "org_id", "left")


def listing_measures(seq: DataFrame) -> DataFrame:
    """Plain sums and counts per listing of a sequenced scope, ready to be added up to any level."""
    order = F.struct("scraped_at", "snapshot_id", "listing_id")
    priced = F.when(F.col("price").isNotNull(), F.struct(order.alias("at"), F.col("price").alias("price")))
    stock = [n_if(changed("availability", "previous_availability")).alias("stock_changes")] if "previous_availability" in seq.columns else []
    return seq.groupBy("org_id", "store_id", "listing_id").agg(
        F.count(F.lit(1)).alias("n"), n_if(F.col("availability") == "in_stock").alias("in_stock"), F.sum("price").alias("price_sum"), F.count("price").alias("priced"),
        F.min("price").alias("lo"), F.max("price").alias("hi"), F.sum(discount0()).alias("discount_sum"), n_if(changed()).alias("changes"), n_if(dropped()).alias("drops"), n_if(raised()).alias("raises"),
        F.sum("confidence").alias("conf_sum"), F.count("confidence").alias("conf_n"), n_if(F.col("status") == "ok").alias("ok"), F.max("scraped_at").alias("last_seen"),
        F.min(priced).alias("first_seen"), F.max(priced).alias("latest_seen"), *stock,
    )


def rolled_measures() -> list:
    return [
        S.rnd(S.dbl(F.sum("price_sum")) / F.sum("priced"), 2).alias("avg_price"), S.dbl(F.min("lo")).alias("min_price"), S.dbl(F.max("hi")).alias("max_price"),
        S.rnd(F.sum("discount_sum") / F.sum("n"), 2).alias("avg_discount"), F.sum("changes").alias("price_changes"), F.sum("drops").alias("price_drops"), F.sum("raises").alias("price_increases"),
    ]


def competitor_analytics(t: Tables, f: Filters, k: int | None = None) -> DataFrame:
    low = f.period(t.as_of).date_from
    scoped = snapshot_scope(t, f, low)
    per = listing_measures(sequenced(t, scoped, low, availability=True))
    stats = per.groupBy("org_id", "store_id").agg(
        F.count(F.lit(1)).alias("monitored_products"), n_if(F.col("in_stock") > 0).alias("in_stock"), *rolled_measures(),
        F.sum("stock_changes").alias("stock_changes"), S.rnd(S.dbl(F.sum("conf_sum")) / F.sum("conf_n"), 3).alias("avg_confidence"),
        F.sum("ok").alias("ok_count"), F.sum("n").alias("total_count"), F.max("last_seen").alias("last_seen"),
    )
    stats = stats.join(exact_medians(scoped, ["org_id", "store_id"], "price", "median_price"), ["org_id", "store_id"], "left")
    failed = between(t.runs, "created_at", low).where(F.col("status") == "failed").groupBy("store_id").agg(
        F.count(F.lit(1)).alias("failed_scrapes"),
        F.max(F.coalesce("finished_at", "started_at", "created_at")).alias("last_failed"),
    )
    j = stats.join(failed, "store_id", "left").join(store_names(t), "store_id")
    j = j.withColumn("failed_scrapes", F.coalesce("failed_scrapes", F.lit(0)))
    ok_share = F.col("ok_count") / F.col("total_count")
    out = j.select(
        "org_id", "store_id", "store_name", "monitored_products", "avg_price", "median_price", "min_price", "max_price",
        F.coalesce("avg_discount", F.lit(0.0)).alias("avg_discount"),
        S.stock_ratio("in_stock", "monitored_products").alias("stock_ratio"),
        "price_changes", "price_drops", "price_increases", "stock_changes", "failed_scrapes",
        F.greatest("last_seen", "last_failed").alias("last_crawl"),
        S.aggressiveness("price_drops", S.rnd("avg_discount", 0), "price_changes", "stock_changes", "failed_scrapes").alias("aggressiveness_score"),
        S.volatility("min_price", "max_price", "avg_price").alias("volatility_score"),
        S.quality_score(F.col("avg_price").isNotNull(), F.lit(True), F.col("avg_confidence"), F.lit(True), ok_share >= 0.8, F.lit(True)).alias("data_quality_score"),
    )
    if k is None:
        return out
    return top_k(out, ["org_id"], [F.desc("price_changes"), F.desc("monitored_products"), F.asc("store_id")], k)


def category_first_last(t: Tables, f: Filters) -> DataFrame:
    """First and last observed price of every category (one grouped pass, no window)."""
    low = f.period(t.as_of).date_from
    order = F.struct("scraped_at", "snapshot_id", "listing_id")
    scoped = enriched_scope(t, f, low).where(F.col("price").isNotNull())
    return scoped.groupBy("org_id", F.coalesce("category_name", F.lit("Uncategorized")).alias("category")).agg(
        S.dbl(F.min_by("price", order)).alias("first_price"), S.dbl(F.max_by("price", order)).alias("last_price")
    )


def category_analytics(t: Tables, f: Filters, k: int | None = None) -> DataFrame:
    low = f.period(t.as_of).date_from
    from .scope import listing_dims, listing_predicates

    dims = listing_dims(t)
    for p in listing_predicates(f, t):
        dims = dims.where(p)
    dims = dims.select("listing_id", "product_id", "category_id", F.coalesce("category_name", F.lit("Uncategorized")).alias("category"))
    scoped = snapshot_scope(t, f, low)
    key = ["org_id", "category_id", "category"]
    # observations shrink to one row per listing before they meet the dimensions
    per = listing_measures(sequenced(t, scoped, low)).join(dims, "listing_id")
    stats = per.groupBy(*key).agg(
        F.count_distinct(entity_key()).alias("products_count"), F.count_distinct("store_id").alias("competitors_count"),
        F.count_distinct("listing_id").alias("total_stock"), F.count_distinct(F.when(F.col("in_stock") > 0, F.col("listing_id"))).alias("in_stock"),
        *rolled_measures(), S.dbl(F.min("first_seen")["price"]).alias("first_price"), S.dbl(F.max("latest_seen")["price"]).alias("last_price"),
    )
    prices = scoped.where(F.col("price").isNotNull()).groupBy("org_id", "listing_id", "price").agg(F.count(F.lit(1)).alias("times"))
    medians = exact_medians(prices.join(dims.select("listing_id", "category_id", "category"), "listing_id"), key, "price", "median_price", "times")
    same = lambda c: stats[c].eqNullSafe(medians[c])
    stats = stats.join(medians, same("org_id") & same("category_id") & same("category"), "left").select(*[stats[c] for c in stats.columns], "median_price")
    out = stats.select(
        "org_id", "category_id", "category", "products_count", "competitors_count", "avg_price", "median_price", "min_price", "max_price",
        F.coalesce("avg_discount", F.lit(0.0)).alias("avg_discount"), S.stock_ratio("in_stock", "total_stock").alias("stock_ratio"),
        "price_changes", "first_price", "last_price",
        S.category_volatility("min_price", "max_price", "avg_price", "price_changes").alias("volatility_score"),
        S.trend("first_price", "last_price").alias("trend"),
    )
    if k is None:
        return out
    return top_k(out, ["org_id"], [F.desc("price_changes"), F.desc("products_count"), F.asc("category")], k)


def availability_trend(t: Tables, f: Filters) -> DataFrame:
    low = f.period(t.as_of).date_from
    seq = sequenced(t, snapshot_scope(t, f, low), low, price=False, availability=True)
    avail, prev = F.col("availability"), F.col("previous_availability")
    # one row per bucket and listing turns three distinct counts into flags
    per = seq.groupBy("org_id", time_bucket("scraped_at", f.range).alias("bucket"), "listing_id").agg(
        F.max((avail == "in_stock").cast("int")).alias("i"),
        F.max((avail == "out_of_stock").cast("int")).alias("o"),
        F.max((avail.isNull() | (avail == "unknown")).cast("int")).alias("u"),
        n_if(~prev.eqNullSafe("out_of_stock") & (avail == "out_of_stock")).alias("gone"),
        n_if((prev == "out_of_stock") & (avail == "in_stock")).alias("back"),
    )
    return per.groupBy("org_id", "bucket").agg(
        F.coalesce(F.sum("i"), F.lit(0)).alias("in_stock"), F.coalesce(F.sum("o"), F.lit(0)).alias("out_of_stock"),
        F.sum("u").alias("unknown_count"), F.sum("gone").alias("newly_unavailable"), F.sum("back").alias("back_in_stock"),
    )


def availability_events(t: Tables, f: Filters, k: int | None = None) -> DataFrame:
    """Newest ``k`` changes or out-of-stock observations per tenant, with the number of events of the listing."""
    low = f.period(t.as_of).date_from
    seq = sequenced(t, snapshot_scope(t, f, low), low, price=False, availability=True)
    avail, prev = F.col("availability"), F.col("previous_availability")
    events = seq.where((prev.isNotNull() & (prev != avail)) | (avail == "out_of_stock"))
    newest = top_k(events, ["org_id"], [F.desc("scraped_at"), F.desc("snapshot_id")], k)
    counts = events.groupBy("listing_id").agg(F.count(F.lit(1)).alias("metric"))
    from .scope import listing_dims

    dims = listing_dims(t).select("listing_id", "product_id", "store_name", F.coalesce("product_name", "title", "url").alias("product_title"))
    return newest.join(counts, "listing_id").join(dims, "listing_id").select(
        "org_id", "listing_id", "snapshot_id", "product_id", "product_title", "store_name", "availability", "previous_availability",
        "scraped_at", "metric",
    )


def availability_lists(t: Tables, f: Filters, k: int = 25) -> DataFrame:
    ev = availability_events(t, f)
    avail, prev = F.col("availability"), F.col("previous_availability")
    gone = ev.where(~prev.eqNullSafe("out_of_stock") & (avail == "out_of_stock")).withColumn("list", F.lit("newly_unavailable"))
    back = ev.where((prev == "out_of_stock") & (avail == "in_stock")).withColumn("list", F.lit("back_in_stock"))
    shaky = ev.withColumn("list", F.lit("unstable"))
    newest = [F.desc("scraped_at"), F.desc("snapshot_id")]
    parts = [top_k(gone, ["org_id"], newest, k), top_k(back, ["org_id"], newest, k), top_k(shaky, ["org_id"], [F.desc("metric"), *newest], k)]
    return reduce(DataFrame.unionByName, parts)


def quality_summary(t: Tables, f: Filters) -> DataFrame:
    low = f.period(t.as_of).date_from
    stale = F.col("last_scraped_at").isNull() | (F.col("last_scraped_at") < t.ago(hours=24))
    latest = latest_scope(t, f).groupBy("org_id").agg(
        n_if(F.col("price").isNull()).alias("missing_price_count"),
        n_if(F.col("image_url").isNull()).alias("missing_image_count"),
        n_if(F.col("confidence") < 0.7).alias("low_confidence_products"),
        n_if(stale).alias("stale_products"),
        n_if(F.col("scraped_at").isNull() | ~F.col("snapshot_status").eqNullSafe("ok")).alias("never_successfully_scraped"),
        n_if(F.col("last_scraped_at") >= t.ago(hours=24)).alias("fresh_products"),
        F.count(F.lit(1)).alias("total_products"),
    )
    seen = snapshot_scope(t, f, low).groupBy("org_id").agg(
        n_if(F.col("status") != "ok").alias("failed_extractions"),
        n_if(F.col("status") == "ok").alias("ok_count"),
        F.count(F.lit(1)).alias("total_snapshots"),
    )
    out = latest.join(seen, "org_id", "left").na.fill(0)
    rate = F.when(F.col("total_snapshots") > 0, S.rnd(S.dbl("ok_count") / F.col("total_snapshots") * 100, 0)).otherwise(0.0)
    out = out.withColumn("success_rate", rate).withColumn("freshness", S.freshness_pct("total_products", "fresh_products"))
    return out.withColumn("data_quality_score", S.rnd((F.col("success_rate") + F.col("freshness")) / 2, 0))


def confidence_bands(t: Tables, f: Filters) -> DataFrame:
    c = F.col("confidence")
    band = F.when(c >= 0.9, "90-100").when(c >= 0.75, "75-89").when(c >= 0.5, "50-74").otherwise("<50")
    return snapshot_scope(t, f, f.period(t.as_of).date_from).groupBy("org_id", band.alias("band")).agg(F.count(F.lit(1)).alias("count"))


def extraction_health(t: Tables, f: Filters) -> DataFrame:
    scoped = snapshot_scope(t, f, f.period(t.as_of).date_from)
    return scoped.groupBy("org_id", time_bucket("scraped_at", f.range).alias("bucket")).agg(
        n_if(F.col("status") == "ok").alias("ok"), n_if(F.col("status") != "ok").alias("failed")
    )


def run_success(t: Tables, f: Filters) -> DataFrame:
    runs = between(t.runs, "created_at", f.period(t.as_of).date_from)
    unit = "hour" if f.range == "24h" else "day"
    g = runs.groupBy("org_id", F.date_trunc(unit, F.col("created_at")).alias("bucket")).agg(
        n_if(F.col("status").isin("success", "partial")).alias("success"),
        n_if(F.col("status") == "failed").alias("failed"),
        F.count(F.lit(1)).alias("total"),
    )
    return g.withColumn("success_rate", S.rnd(S.dbl("success") / F.col("total") * 100, 0))


def ops_counts(t: Tables, f: Filters) -> DataFrame:
    attempts = between(t.repair_attempts, "created_at", f.period(t.as_of).date_from).groupBy("org_id").agg(F.count(F.lit(1)).alias("repair_attempts"))
    waiting = t.manual_sessions.where(F.col("status").isin("waiting_for_manual_action", "browser_opened", "paused"))
    waiting = waiting.groupBy("org_id").agg(F.count(F.lit(1)).alias("waiting_sessions"))
    return attempts.join(waiting, "org_id", "full_outer").na.fill(0)


def worst_products(t: Tables, f: Filters, k: int = 40) -> DataFrame:
    l = latest_scope(t, f)
    score = S.quality_score(
        F.col("price").isNotNull(), F.coalesce("product_name", "title").isNotNull(), F.col("confidence"),
        F.coalesce(F.col("last_scraped_at") >= t.ago(hours=24), F.lit(False)), F.col("snapshot_status").eqNullSafe("ok"), F.col("url").startswith("http"),
    )
    out = l.select(
        "org_id", "listing_id", "product_id", F.coalesce("product_name", "title", "url").alias("product_title"), "store_name",
        S.dbl("price").alias("price"), "currency", S.dbl("confidence").alias("confidence"), "snapshot_status", "scraped_at",
        score.alias("quality_score"),
    )
    return top_k(out, ["org_id"], [F.asc("quality_score"), F.asc_nulls_first("scraped_at"), F.asc("listing_id")], k)


def problem_competitors(t: Tables, f: Filters, k: int = 12) -> DataFrame:
    return top_k(competitor_analytics(t, f), ["org_id"], [F.asc("data_quality_score"), F.desc("price_changes"), F.asc("store_id")], k)


MOVEMENT_COLS = ["org_id", "kind", "product_id", "listing_id", "product_title", "store_name", "old_price", "new_price", "delta_amount", "delta_pct", "moved_at", "metric"]


def all_movements(t: Tables, f: Filters) -> DataFrame:
    """Union of seven kinds of movement, not yet ranked."""
    from .scope import listing_dims, listing_predicates

    low = f.period(t.as_of).date_from
    scoped = snapshot_scope(t, f, low)
    seq = sequenced(t, scoped, low)
    changes = seq.where(changed()).select(
        "org_id", "listing_id", S.dbl("previous_price").alias("old_price"), S.dbl("price").alias("new_price"),
        S.dbl(F.col("price") - F.col("previous_price")).alias("delta_amount"), S.pct_change("price", "previous_price").alias("delta_pct"),
        F.col("scraped_at").alias("moved_at"), "snapshot_id",
    ).withColumn("metric", F.abs("delta_pct"))
    spread = scoped.where(F.col("price").isNotNull()).groupBy("org_id", "listing_id").agg(
        S.dbl(F.min("price")).alias("old_price"), S.dbl(F.max("price")).alias("new_price"),
        (S.dbl(F.sum("price")) / F.count("price")).alias("_avg"), F.max("scraped_at").alias("moved_at"), F.count("price").cast("double").alias("metric"),
    )
    spread = spread.withColumn("delta_amount", F.col("new_price") - F.col("old_price"))
    spread = spread.withColumn("delta_pct", F.when(F.col("_avg") > 0, F.col("delta_amount") / F.col("_avg") * 100)).drop("_avg").withColumn("snapshot_id", F.lit(0).cast("bigint"))
    latest = latest_scope(t, f)
    none = F.lit(None).cast("double")
    off = F.when(F.col("old_price") > 0, S.dbl(F.col("old_price") - F.col("price")) / S.dbl("old_price") * 100)
    discounted = latest.where(F.col("old_price") > F.col("price")).select(
        "org_id", "listing_id", S.dbl("old_price").alias("old_price"), S.dbl("price").alias("new_price"),
        S.dbl(F.col("old_price") - F.col("price")).alias("delta_amount"), off.alias("delta_pct"), F.col("scraped_at").alias("moved_at"), off.alias("metric"),
    )
    blank = lambda df, at, metric: df.select(
        "org_id", "listing_id", none.alias("old_price"), S.dbl("price").alias("new_price"), none.alias("delta_amount"), none.alias("delta_pct"),
        F.col(at).alias("moved_at"), metric.alias("metric"),
    )
    missing = blank(latest.where(F.col("price").isNull()), "scraped_at", none)
    stale_rows = latest.where(F.col("last_scraped_at").isNull() | (F.col("last_scraped_at") < t.ago(hours=24)))
    stale = blank(stale_rows, "last_scraped_at", S.age_hours("last_scraped_at", t.now))
    kind = lambda df, name: (df if "snapshot_id" in df.columns else df.withColumn("snapshot_id", F.lit(0).cast("bigint"))).withColumn("kind", F.lit(name))
    parts = [
        kind(changes.where(F.col("delta_amount") < 0), "drop"), kind(changes.where(F.col("delta_amount") > 0), "increase"),
        kind(spread.where(F.coalesce("delta_pct", F.lit(0.0)) > 0), "volatile"), kind(discounted, "discounted"),
        kind(spread.where(F.col("metric") > 1), "frequent"), kind(missing, "missing"), kind(stale, "stale"),
    ]
    return reduce(DataFrame.unionByName, parts)


def product_movements(t: Tables, f: Filters, k: int | None = 20) -> DataFrame:
    """Top ``k`` of every kind after all are ranked, every movement with its position without ``k``; names are joined only for the rows that remain."""
    from .scope import listing_dims

    moves = all_movements(t, f)
    if f.min_volatility is not None:
        moves = moves.where((F.col("kind") != "volatile") | (F.col("delta_pct") >= f.min_volatility))
    if f.max_volatility is not None:
        moves = moves.where((F.col("kind") != "volatile") | (F.col("delta_pct") <= f.max_volatility))
    if f.changes_only:
        moves = moves.where(F.col("kind").isin("drop", "increase"))
    weight = F.round(F.abs(F.coalesce("metric", "delta_pct", F.lit(0.0))), 6)
    top = top_k(moves, ["org_id", "kind"], [weight.desc(), F.desc("moved_at"), F.asc("listing_id"), F.asc("snapshot_id")], k, rank="position")
    dims = listing_dims(t).select("listing_id", "product_id", "store_name", F.coalesce("product_name", "title", "url").alias("product_title"))
    return top.join(dims, "listing_id", "left").select(*MOVEMENT_COLS, "position")


def market_insights(t: Tables, f: Filters, limit: int = 40) -> DataFrame:
    cats, comps = category_analytics(t, f), competitor_analytics(t, f)
    moves, quality = product_movements(t, f), quality_summary(t, f)
    num = lambda c, d: F.format_string(f"%.{d}f", S.rnd(c, d))
    def shape(df, block, kind, severity, subject, metric, order, k=5):
        picked = top_k(df, ["org_id"], order, k, rank="place")
        return picked.select(
            "org_id", F.lit(block).alias("block"), "place", F.lit(kind).alias("type"), severity.alias("severity"),
            subject.alias("subject"), metric.alias("metric"),
        )
    falling = shape(cats.where(F.col("trend") == "falling"), 1, "price_drop_trend", F.lit("success"), F.col("category"),
                    F.concat(num("volatility_score", 0), F.lit(" volatility")), [F.desc("price_changes"), F.desc("products_count"), F.asc("category")])
    pushy = shape(comps.where(F.col("aggressiveness_score") >= 25), 2, "aggressive_competitor",
                  F.when(F.col("aggressiveness_score") >= 60, "critical").otherwise("warning"), F.col("store_name"),
                  F.concat(num("aggressiveness_score", 0), F.lit("/100")), [F.desc("aggressiveness_score"), F.desc("price_changes"), F.asc("store_id")])
    by_place = [F.asc("position")]
    pct = F.concat(F.coalesce(num("delta_pct", 1), F.lit("0")), F.lit("%"))
    discounts = shape(moves.where(F.col("kind") == "discounted"), 3, "discount_spike", F.lit("info"), F.col("product_title"), pct, by_place)
    volatile = shape(moves.where(F.col("kind") == "volatile"), 4, "unusual_activity", F.lit("warning"), F.col("product_title"), pct, by_place)
    stale = shape(moves.where(F.col("kind") == "stale"), 5, "stale_monitoring", F.lit("warning"), F.col("product_title"),
                  F.concat(num(F.coalesce("metric", F.lit(0.0)), 0), F.lit("h")), by_place)
    ops = ops_counts(t, f).select("org_id", "waiting_sessions")
    q = quality.join(ops, "org_id", "left").na.fill(0).where((F.col("waiting_sessions") > 0) | (F.col("failed_extractions") > 0))
    warn = shape(q, 6, "stale_monitoring", F.when(F.col("failed_extractions") > 10, "critical").otherwise("warning"),
                 F.lit("Data collection quality needs attention"), F.concat(num("data_quality_score", 0), F.lit("/100")), [F.asc("org_id")], 1)
    everything = reduce(DataFrame.unionByName, [falling, pushy, discounts, volatile, stale, warn])
    return top_k(everything, ["org_id"], [F.asc("block"), F.asc("place")], limit)
