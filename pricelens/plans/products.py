"""Product mart: entities (own products and unmatched listings), clusters, timelines and their summaries.

An entity is an own product with all its confirmed listings, or a listing without a confirmed match.
Members stay in a long table: a product with very many listings never becomes one huge array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as X
from ..functions import urls as U
from ..operators.ordered import latest_per_key, top_k, with_previous
from ..sources.catalog import Tables
from .filters import EntityFilters

n_if = F.count_if
HISTORY_DAYS, SPARK_DAYS, SPARK_POINTS, TIMELINE_DAYS = 120, 45, 16, 180


def product_entity(c="product_id") -> Column:
    return F.concat(F.lit("p"), F.col(c).cast("string"))


def listing_entity(c="listing_id") -> Column:
    return F.concat(F.lit("l"), F.col(c).cast("string"))


def edges(t: Tables, own: DataFrame | None = None) -> DataFrame:
    """(entity, listing) pairs: confirmed matches, and every other listing as its own entity.

    Columns of ``own`` come by product id, null where there is none. Own products are merged, never sent whole to every task, and only
    with matched listings: all others would meet in the one task of the null id.
    """
    ok = t.matches.where(F.col("status") == "confirmed").select("listing_id", "org_id", "product_id").distinct()
    matched = ok.select("org_id", product_entity().alias("entity_id"), "product_id", "listing_id")
    if own is not None:
        matched = matched.join(own.hint("merge"), "product_id", "left")
    alone = t.listings.select("listing_id", "org_id").join(ok.select("listing_id"), "listing_id", "left_anti")
    alone = alone.select("org_id", listing_entity().alias("entity_id"), F.lit(None).cast("bigint").alias("product_id"), "listing_id")
    return matched.unionByName(alone, allowMissingColumns=True)


SEEN = ["price", "old_price", "currency", "availability", "image_url", "confidence", "source", "shipping_text", "rating", "scraped_at"]


def members(t: Tables, seen: list[str] | None = None) -> DataFrame:
    """One row per (entity, listing) with the current state of the listing.

    ``seen`` names the columns of the newest observation that the caller reads (all without it): the row is picked as one struct, from
    which Spark can't drop fields. Others are null, or the listing's own.
    """
    wanted = SEEN if seen is None else seen
    newest = latest_per_key(t.snapshots, ["listing_id"], wanted)
    blanks = {f"n_{c}": F.lit(None).cast(t.snapshots.schema[c].dataType) for c in SEEN if c not in wanted}
    newest = newest.select("listing_id", *[F.col(c).alias(f"n_{c}") for c in wanted]).withColumns(blanks)
    own = t.my_products.select("product_id", F.col("currency").alias("own_currency"))
    st = t.stores.select("store_id", F.col("name").alias("store_name"), "domain")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    j = edges(t, own).join(t.listings.drop("org_id"), "listing_id").join(newest, "listing_id", "left").join(st, "store_id")
    return j.select(
        "org_id", "entity_id", "product_id", "listing_id", "store_id", "store_name", "domain", F.coalesce("title", "url").alias("title"),
        F.col("title").alias("raw_title"), "url", "brand", "sku", "gtin", F.coalesce(blank("image_url"), blank("n_image_url")).alias("image_url"),
        F.coalesce("n_price", "last_snapshot_price").alias("price"), F.col("n_old_price").alias("old_price"),
        F.coalesce("n_currency", "last_snapshot_currency", "own_currency", F.lit("EUR")).alias("currency"),
        F.coalesce("n_currency", "last_snapshot_currency").alias("seen_currency"),
        F.coalesce("n_availability", "last_snapshot_availability").alias("availability"), F.col("n_confidence").alias("confidence"),
        F.col("n_source").alias("source"), F.col("n_shipping_text").alias("shipping"), F.col("n_rating").alias("rating"),
        F.coalesce("n_scraped_at", "last_scraped_at").alias("seen_at"), "last_scraped_at", "last_change_at", "created_at",
    )


def listing_history(t: Tables, days: int = HISTORY_DAYS) -> DataFrame:
    order = F.struct("scraped_at", "snapshot_id", "listing_id")
    priced = t.snapshots.where((F.col("scraped_at") >= t.ago(days=days)) & F.col("price").isNotNull())
    return priced.groupBy("listing_id").agg(
        F.min("price").alias("h_min"), F.max("price").alias("h_max"), F.sum("price").alias("h_sum"), F.count("price").alias("h_n"),
        F.min(F.struct(order, "price")).alias("h_first"), F.max(F.struct(order, "price")).alias("h_last"),
    )


def sparkline_points(t: Tables, days: int = SPARK_DAYS, points: int = SPARK_POINTS) -> DataFrame:
    """Daily average price of the newest days per entity.  Days are pre-aggregated per listing."""
    priced = t.snapshots.where((F.col("scraped_at") >= t.ago(days=days)) & F.col("price").isNotNull())
    daily = priced.groupBy("listing_id", F.to_date("scraped_at").alias("day")).agg(F.sum("price").alias("s"), F.count("price").alias("n"))
    per = daily.join(edges(t), "listing_id").groupBy("org_id", "entity_id", "day").agg(S.rnd(S.dbl(F.sum("s")) / F.sum("n"), 2).alias("price"))
    return top_k(per, ["entity_id"], [F.desc("day")], points)


def sparkline(t: Tables) -> DataFrame:
    """Ordered array of at most sixteen points per entity."""
    pts = F.array_sort(F.collect_list(F.struct("day", "price")))
    return sparkline_points(t).groupBy("entity_id").agg(pts.alias("sparkline"))


BASE = ["org_id", "entity_id", "id", "entity_type", "canonical_title", "brand", "category", "category_id", "matched", "cluster_key", "own_text"]


def product_entities(t: Tables, with_sparkline: bool = True, only: list[str] | None = None) -> DataFrame:
    """One row per entity. ``only`` names the columns wanted; members and history aren't read for those an entity has by itself (``BASE``)."""
    if only is not None:
        return (entity_bases(t) if set(only) <= set(BASE) else product_entities(t, with_sparkline)).select(*only)
    m = members(t)
    hist = listing_history(t)
    avail, price = F.col("availability"), F.col("price")
    g = m.join(hist, "listing_id", "left").groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("competitors_count"), F.min("price").alias("cur_min"), F.max("price").alias("cur_max"),
        S.mean("price").alias("cur_avg"), n_if(price.isNotNull()).alias("cur_n"),
        n_if(avail == "in_stock").alias("in_stock_count"), n_if(avail == "out_of_stock").alias("out_stock_count"),
        n_if(avail.isNull() | (avail == "unknown")).alias("unknown_stock_count"), n_if(F.col("old_price") > price).alias("active_discounts"),
        F.min_by("seen_currency", F.when(F.col("seen_currency").isNotNull(), F.col("listing_id"))).alias("seen_currency"),
        F.min_by("image_url", F.when(F.col("image_url").isNotNull(), F.col("listing_id"))).alias("member_image"),
        F.max("last_change_at").alias("last_change_at"), F.max("last_scraped_at").alias("last_scraped_at"),
        F.max(F.col("gtin").isNotNull()).alias("any_gtin"), F.max(F.col("sku").isNotNull()).alias("any_sku"),
        F.min("h_min").alias("hist_min"), F.max("h_max").alias("hist_max"), F.sum("h_sum").alias("h_sum"), F.sum("h_n").alias("h_n"),
        F.min("h_first").alias("h_first"), F.max("h_last").alias("h_last"),
    )
    j = entity_bases(t).join(g, "entity_id", "left")
    if with_sparkline:
        j = j.join(sparkline(t), "entity_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    first, last = F.col("h_first.price"), F.col("h_last.price")
    hist_avg = S.dbl("h_sum") / F.col("h_n")
    seen = F.when(F.col("matched"), F.greatest("last_scraped_at", "updated_at")).otherwise(F.coalesce("last_scraped_at", "created_at"))
    vol = S.volatility(F.coalesce("hist_min", "cur_min"), F.coalesce("hist_max", "cur_max"), F.coalesce(hist_avg, S.dbl("cur_avg")))
    e = j.select(
        "org_id", "entity_id", "id", "entity_type", "canonical_title", "brand", "category", "category_id",
        F.coalesce("own_image", "member_image").alias("image_url"), n("competitors_count"),
        S.dbl("cur_min").alias("current_min_price"), F.col("cur_avg").alias("current_avg_price"), S.dbl("cur_max").alias("current_max_price"),
        F.coalesce("seen_currency", "own_currency", F.lit("EUR")).alias("currency"),
        S.dbl("hist_min").alias("hist_min"), S.rnd(hist_avg, 4).alias("hist_avg"), S.dbl("hist_max").alias("hist_max"),
        S.dbl(first).alias("first_price"), S.dbl(last).alias("last_price"), n("in_stock_count"), n("out_stock_count"), n("unknown_stock_count"), n("active_discounts"),
        F.when(F.col("matched"), F.greatest("last_change_at", "last_scraped_at", "updated_at")).otherwise(F.greatest("last_change_at", "last_scraped_at", "created_at")).alias("last_change"),
        F.col("created_at").alias("discovered_at"), seen.alias("updated_at"), "matched",
        (F.col("matched") & (F.coalesce("competitors_count", F.lit(0)) > 1)).alias("duplicate_risk"),
        F.coalesce(F.coalesce(seen, "created_at") < t.ago(hours=24), F.lit(False)).alias("stale"), F.col("cur_min").isNull().alias("missing_price"),
        (F.col("own_gtin") | F.coalesce("any_gtin", F.lit(False))).alias("has_gtin"), (F.col("own_sku") | F.coalesce("any_sku", F.lit(False))).alias("has_sku"),
        vol.alias("volatility"), "cluster_key", "own_text", *(["sparkline"] if with_sparkline else []),
    )
    return e.withColumns({
        "market_trend": S.trend("first_price", "last_price", "volatility"),
        "stock_status": S.stock_status("in_stock_count", "out_stock_count", "unknown_stock_count"),
        "confidence": S.entity_confidence("matched", "competitors_count", "has_gtin", "has_sku", F.coalesce(F.col("brand"), F.lit("")) != "", ~F.col("missing_price")),
    })


def entity_bases(t: Tables) -> DataFrame:
    """Own products and unmatched listings with what they have by themselves."""
    cats = t.categories.select("category_id", F.col("name").alias("category"))
    own = t.my_products.join(cats, "category_id", "left").select(
        "org_id", product_entity().alias("entity_id"), F.col("product_id").alias("id"), F.lit("normalized").alias("entity_type"), F.col("name").alias("canonical_title"),
        "brand", "category", "category_id", F.nullif("image_url", F.lit("")).alias("own_image"), F.col("currency").alias("own_currency"), "created_at", "updated_at",
        F.lit(True).alias("matched"), F.col("gtin").isNotNull().alias("own_gtin"), F.col("sku").isNotNull().alias("own_sku"),
        F.coalesce(F.nullif(F.lower("gtin"), F.lit("")), F.concat(F.lit("mp:"), F.col("product_id").cast("string"))).alias("cluster_key"),
        X.search_text("name", "brand", "sku", "gtin").alias("own_text"),
    )
    matched_ids = t.matches.where(F.col("status") == "confirmed").select("listing_id")
    st = t.stores.select("store_id", F.col("name").alias("store_name"))
    plain = F.regexp_replace(F.lower(F.concat(F.coalesce("brand", F.lit("")), F.lit(" "), F.coalesce("title", F.lit("")))), r"[^a-z0-9]+", " ")
    raw = t.listings.join(matched_ids, "listing_id", "left_anti").join(st, "store_id").select(
        "org_id", listing_entity().alias("entity_id"), F.col("listing_id").alias("id"), F.lit("raw_competitor").alias("entity_type"),
        F.coalesce("title", "url").alias("canonical_title"), "brand", F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("category_id"),
        F.lit(None).cast("string").alias("own_image"), F.lit(None).cast("string").alias("own_currency"), "created_at", F.lit(None).cast("timestamp").alias("updated_at"),
        F.lit(False).alias("matched"), F.lit(False).alias("own_gtin"), F.lit(False).alias("own_sku"),
        F.coalesce(F.nullif(F.lower("gtin"), F.lit("")), F.nullif(plain, F.lit("")), F.concat(F.lit("cp:"), F.col("listing_id").cast("string"))).alias("cluster_key"),
        X.search_text("title", "brand", "sku", "gtin", "url", "store_name").alias("own_text"),
    )
    return own.unionByName(raw)


# ------------------------------------------------------------------------------------------ filters and order


def advanced(preset: str, t: Tables) -> Column:
    c = F.col
    presets = {
        "newly_discovered": c("discovered_at") >= t.ago(days=7), "stale_data": c("stale"), "missing_prices": c("missing_price"),
        "high_discounts": c("active_discounts") > 0, "price_drops": c("last_price") < c("first_price") * 0.97,
        "stock_changes": (c("in_stock_count") > 0) & (c("out_stock_count") > 0), "only_matched": c("matched"), "only_unmatched": ~c("matched"),
        "only_duplicates": c("duplicate_risk"),
    }
    return presets.get(preset, F.lit(False))


def filter_entities(e: DataFrame, m: DataFrame, f: EntityFilters, t: Tables) -> DataFrame:
    """Predicates on entities.  Text and competitor tests on members are semi-joins against the long table."""
    c = F.col
    if f.brand is not None:
        e = e.where(F.lower(F.coalesce("brand", F.lit("Unknown"))) == f.brand.lower())
    if f.category is not None:
        e = e.where((c("category_id") == f.category) | (F.lower(F.coalesce("category", F.lit(""))) == f.category.lower()))
    if f.min_price is not None:
        e = e.where(c("current_avg_price") >= f.min_price)
    if f.max_price is not None:
        e = e.where(c("current_avg_price") <= f.max_price)
    if f.availability is not None:
        counter = {"in_stock": "in_stock_count", "out_of_stock": "out_stock_count", "unknown": "unknown_stock_count"}.get(f.availability)
        e = e.where(c(counter) > 0 if counter else F.lit(False))
    if f.discount is not None:
        e = e.where({"discounted": c("active_discounts") > 0, "not_discounted": c("active_discounts") == 0}.get(f.discount, F.lit(False)))
    if f.stock is not None:
        i, o, u = c("in_stock_count"), c("out_stock_count"), c("unknown_stock_count")
        e = e.where({
            "mixed": (i > 0) & (o > 0), "in_stock": (i > 0) & (o == 0), "out_of_stock": (o > 0) & (i == 0), "unknown": (u > 0) & (i == 0) & (o == 0),
        }.get(f.stock, F.lit(False)))
    if f.advanced is not None:
        e = e.where(advanced(f.advanced, t))
    if f.competitor is not None:
        e = e.join(m.where(c("store_id").cast("string") == str(f.competitor)).select("entity_id"), "entity_id", "left_semi")
    def contains(e, own, member, needle):
        hits = m.where(F.contains(member, F.lit(needle))).select("entity_id")
        return e.where(F.contains(own, F.lit(needle))).select("entity_id").unionByName(hits)
    if f.search is not None:
        e = e.join(contains(e, c("own_text"), X.search_text("raw_title", "sku", "gtin"), f.search.lower()), "entity_id", "left_semi")
    spec = " ".join(v for v in f.specs.values() if v).lower()
    if spec:
        e = e.join(contains(e, X.search_text("canonical_title", "brand"), F.lower("raw_title"), spec), "entity_id", "left_semi")
    return e


def sort_order(sort: str) -> list[Column]:
    vol = (F.col("hist_max") - F.col("hist_min")) / F.nullif("hist_avg", F.lit(0.0))
    first = {
        "price_asc": [F.asc_nulls_last("current_avg_price")], "price_desc": [F.desc_nulls_last("current_avg_price")], "volatility_desc": [vol.desc_nulls_last()],
        "title_asc": [F.asc("canonical_title")], "competitors_desc": [F.desc("competitors_count")],
    }.get(sort, [])
    return [*first, F.desc_nulls_last("updated_at"), F.desc_nulls_last("discovered_at"), F.asc("entity_id")]


def page(df: DataFrame, order: list[Column], size: int, number: int = 1) -> DataFrame:
    """One page per tenant with the tenant's total count."""
    total = df.groupBy("org_id").agg(F.count(F.lit(1)).alias("total_count"))
    upto = top_k(df, ["org_id"], order, size * number, rank="position").where(F.col("position") > size * (number - 1))
    return upto.join(total, "org_id")


def entity_list(t: Tables, f: EntityFilters) -> DataFrame:
    return page(filter_entities(product_entities(t), members(t), f, t), sort_order(f.sort), f.page_size, f.page)


# ------------------------------------------------------------------------------------------ timelines


def timeline(t: Tables, days: int | None = TIMELINE_DAYS, previous: bool = False) -> DataFrame:
    """Observations of every entity.  ``previous`` adds the listing's price and availability before."""
    s = t.snapshots if days is None else t.snapshots.where(F.col("scraped_at") >= t.ago(days=days))
    if previous:
        s = with_previous(s, {"previous_price": "price", "previous_availability": "availability"}, sizes=s.select("listing_id", "scraped_at"))
    keep = ["listing_id", "store_id", "snapshot_id", "scraped_at", "price", "old_price", "availability", "confidence"]
    keep += ["previous_price", "previous_availability"] if previous else []
    st = t.stores.select("store_id", F.col("name").alias("store_name"))
    return s.select(*keep).join(edges(t).drop("product_id"), "listing_id").join(st, "store_id")


DAY = F.to_date


def price_stats(tl: DataFrame, t: Tables) -> DataFrame:
    """Upper median and best / worst price of the last 30 and 90 days."""
    within = lambda d: F.when(F.col("scraped_at") >= t.ago(days=d), F.col("price"))
    return tl.where(F.col("price").isNotNull()).groupBy("org_id", "entity_id").agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY price DESC)").cast("double").alias("median"),
        S.dbl(F.min(within(30))).alias("best_30d"), S.dbl(F.max(within(30))).alias("worst_30d"),
        S.dbl(F.min(within(90))).alias("best_90d"), S.dbl(F.max(within(90))).alias("worst_90d"),
    )


def daily_spread(tl: DataFrame) -> DataFrame:
    return tl.where(F.col("price").isNotNull()).groupBy("org_id", "entity_id", DAY("scraped_at").alias("day")).agg(
        S.dbl(F.min("price")).alias("min_price"), S.mean("price").alias("avg_price"), S.dbl(F.max("price")).alias("max_price"))


def price_pivot(tl: DataFrame, stores: list[str]) -> DataFrame:
    """One row per entity and day, one column per named store: the last price of the day."""
    order = F.struct("scraped_at", "snapshot_id")
    last = tl.where(F.col("price").isNotNull()).groupBy("org_id", "entity_id", DAY("scraped_at").alias("day"), "store_name").agg(F.max_by("price", order).alias("p"))
    return last.groupBy("org_id", "entity_id", "day").pivot("store_name", stores).agg(S.dbl(F.max("p")))


def discount_timeline(tl: DataFrame) -> DataFrame:
    pct = S.discount_pct("price", "old_price", null_when_none=True)
    d = tl.withColumn("pct", pct).where(F.col("pct").isNotNull())
    return d.groupBy("org_id", "entity_id", DAY("scraped_at").alias("day")).agg(S.rnd(F.max("pct"), 2).alias("max_discount"))


def availability_days(tl: DataFrame) -> DataFrame:
    a = F.col("availability")
    return tl.groupBy("org_id", "entity_id", DAY("scraped_at").alias("day")).agg(
        n_if(a == "in_stock").alias("in_stock"), n_if(a == "out_of_stock").alias("out_of_stock"), n_if(a.isNull() | ~a.isin("in_stock", "out_of_stock")).alias("unknown"))


def activity_heatmap(tl: DataFrame, days: int = 14) -> DataFrame:
    """Observations per store and day for the newest days with data, zero-filled."""
    per = tl.groupBy("org_id", "entity_id", DAY("scraped_at").alias("day"), "store_name").agg(F.count(F.lit(1)).alias("n"))
    # at most ``days`` rows per entity, and one per store of it: both small before they are paired
    newest = top_k(per.select("org_id", "entity_id", "day").distinct(), ["entity_id"], [F.desc("day")], days)
    seen = per.select("entity_id", "store_name").distinct()
    grid = newest.join(seen, "entity_id")
    return grid.join(per.drop("org_id"), ["entity_id", "day", "store_name"], "left").select("org_id", "entity_id", "day", "store_name", F.coalesce("n", F.lit(0)).alias("observations"))


def daily_leader(tl: DataFrame) -> DataFrame:
    order = F.struct("price", "scraped_at", "snapshot_id", "store_name")
    return tl.where(F.col("price").isNotNull()).groupBy("org_id", "entity_id", DAY("scraped_at").alias("day")).agg(F.min_by("store_name", order).alias("leader"))


def cheapest_rotation(tl: DataFrame) -> DataFrame:
    return daily_leader(tl).groupBy("org_id", "entity_id", F.col("leader").alias("store_name")).agg(F.count(F.lit(1)).alias("days"))


def cheapest_streak(tl: DataFrame) -> DataFrame:
    """Newest leader, and for how many days with data it has led without a break.

    The newest day with another leader ends the streak, so two grouped passes replace a running window.
    """
    d = daily_leader(tl)
    newest = d.groupBy("entity_id").agg(F.max_by("leader", "day").alias("current"))
    j = d.join(newest, "entity_id")
    broken = j.where(F.col("leader") != F.col("current")).groupBy("entity_id").agg(F.max("day").alias("broken_on"))
    run = j.join(broken, "entity_id", "left").where(F.col("broken_on").isNull() | (F.col("day") > F.col("broken_on")))
    return run.groupBy("org_id", "entity_id", F.col("current").alias("store_name")).agg(F.count(F.lit(1)).alias("streak_days"))


def price_position(m: DataFrame) -> DataFrame:
    """Where each member's price lies between the cheapest and the dearest of its entity (0-100)."""
    span = m.groupBy("entity_id").agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    pos = F.when(F.col("hi") > F.col("lo"), S.rnd(S.dbl(F.col("price") - F.col("lo")) / S.dbl(F.col("hi") - F.col("lo")) * 100, 1))
    return m.join(span, "entity_id").select("org_id", "entity_id", "listing_id", "store_name", S.dbl("price").alias("price"), pos.alias("price_position_pct"))


def product_events(t: Tables, k: int = 80, days: int | None = TIMELINE_DAYS) -> DataFrame:
    tl = timeline(t, days, previous=True)
    # the same two digits as a formatted double, without a formatter per row
    cut = lambda c: F.col(c).cast("decimal(38,2)").cast("string")
    moved = (F.col("price") != F.col("previous_price"))
    flipped = F.col("availability") != F.col("previous_availability")
    name = F.col("store_name")
    ev = lambda kind, label, status: F.struct(F.lit(kind).alias("type"), label.alias("label"), status.alias("status"))
    found = F.array_compact(F.array(
        F.when(moved, ev("price_changed", F.concat(name, F.lit(": "), cut("previous_price"), F.lit(" -> "), cut("price")), F.when(F.col("price") < F.col("previous_price"), "success").otherwise("warning"))),
        F.when(flipped, ev("stock_changed", F.concat(name, F.lit(": "), F.col("previous_availability"), F.lit(" -> "), F.col("availability")), F.when(F.col("availability") == "out_of_stock", "critical").otherwise("success"))),
        F.when(F.col("confidence") < 0.65, ev("selector_issue", F.concat(name, F.lit(": low extraction confidence")), F.lit("warning"))),
    ))
    base = tl.select("org_id", "entity_id", "listing_id", F.col("scraped_at").alias("event_at"), "snapshot_id", F.inline(found))
    marks = members(t, ["price", "scraped_at"]).select("org_id", "entity_id", "listing_id", F.col("seen_at").alias("event_at"), F.lit(0).cast("bigint").alias("snapshot_id"), F.lit("snapshot").alias("type"),
                              F.concat(name, F.lit(": latest snapshot")).alias("label"), F.when(F.col("price").isNull(), "warning").otherwise("neutral").alias("status"))
    order = [F.desc("event_at"), F.asc("type"), F.asc("listing_id"), F.asc("snapshot_id")]
    return top_k(base.unionByName(marks), ["entity_id"], order, k)


def missing_stores(t: Tables) -> DataFrame:
    """Per entity the tenant's stores that do not list it, with a search link."""
    per = t.listings.groupBy("store_id").agg(F.count(F.lit(1)).alias("scraped_count"))
    st = t.stores.join(per, "store_id", "left").select("org_id", "store_id", F.col("name").alias("store_name"), "domain", "status", "framework", F.coalesce("scraped_count", F.lit(0)).alias("scraped_count"))
    own = t.my_products.select("org_id", product_entity().alias("entity_id"), F.col("name").alias("title"), "brand")
    ids = t.matches.where(F.col("status") == "confirmed").select("listing_id")
    raw = t.listings.join(ids, "listing_id", "left_anti").select("org_id", listing_entity().alias("entity_id"), F.coalesce("title", "url").alias("title"), "brand")
    listed = edges(t).join(t.listings.select("listing_id", "store_id"), "listing_id").select("entity_id", "store_id")
    q = F.concat_ws(" ", F.nullif("brand", F.lit("")), "title")
    cand = own.unionByName(raw).join(st, "org_id").join(listed, ["entity_id", "store_id"], "left_anti")
    return cand.select("org_id", "entity_id", "store_id", "store_name", "status", "scraped_count", U.search_url(q, F.col("domain"), F.col("framework")).alias("search_url"))


def product_details(t: Tables, entity_ids: list[str] | None = None) -> DataFrame:
    """Overview of all (or the named) entities: comparison measures next to the entity's own."""
    e, m = product_entities(t, with_sparkline=False), members(t)
    if entity_ids is not None:
        ids = list(dict.fromkeys(entity_ids))
        e, m = e.where(F.col("entity_id").isin(ids)), m.where(F.col("entity_id").isin(ids))
    off = S.discount_pct("price", "old_price", null_when_none=True)
    g = m.groupBy("entity_id").agg(
        F.min_by("store_name", F.when(F.col("price").isNotNull(), F.struct("price", "listing_id"))).alias("cheapest_competitor"),
        S.dbl(F.max("price")).alias("highest_price"), S.dbl(F.min("price")).alias("min_price"), S.rnd(F.max(off), 2).alias("current_discount_pct"),
    )
    j = e.join(g, "entity_id", "left")
    lo, hi = F.col("current_min_price"), F.col("current_max_price")
    return j.select(
        "org_id", "entity_id", "canonical_title", "cheapest_competitor", "highest_price", "min_price", F.col("current_avg_price").alias("average_price"), "current_discount_pct",
        S.stock_ratio("in_stock_count", "competitors_count").alias("stock_ratio"), F.col("volatility").alias("volatility_score"), "market_trend",
        S.rnd(hi - lo, 2).alias("competitor_spread"), F.when(hi > 0, S.rnd((hi - lo) / hi * 100, 1)).alias("spread_pct"),
        "in_stock_count", "out_stock_count", "currency", "confidence", "competitors_count",
    )


def identifier_sets(t: Tables) -> DataFrame:
    """Distinct SKUs, GTINs and titles of the listings matched to each own product, as a long table."""
    ok = t.matches.where(F.col("status") == "confirmed").select("product_id", "listing_id")
    l = ok.join(t.listings.select("listing_id", "org_id", "sku", "gtin", "title"), "listing_id")
    one = lambda kind: F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("value"))
    rows = l.select("org_id", "product_id", F.inline(F.array(one("sku"), one("gtin"), one("title"))))
    return rows.where(F.col("value").isNotNull() & (F.col("value") != "")).distinct()


# ------------------------------------------------------------------------------------------ clusters and groups


def clusters(t: Tables) -> DataFrame:
    """Entities that share a cluster key, over the whole mart."""
    e = product_entities(t, with_sparkline=False)
    key = ["org_id", "cluster_key"]
    heads = e.groupBy(*key).agg(
        F.min_by(F.struct("entity_id", "canonical_title", "brand", "category", "currency"),
                 F.struct((F.col("entity_type") != "normalized").alias("a"), (-F.col("competitors_count")).alias("b"), (-F.col("confidence")).alias("c"), F.col("entity_id").alias("d"))).alias("rep"),
        F.count(F.lit(1)).alias("entities"), F.max("last_change").alias("last_change"),
    )
    m = members(t).join(product_entities(t, with_sparkline=False, only=["entity_id", "cluster_key"]), "entity_id")
    m = latest_per_key(m, [*key, "listing_id"], ["store_id", "store_name", "price", "availability", "currency"], ["seen_at", "entity_id"])
    by = F.when(F.col("price").isNotNull(), F.struct("price", "store_name", "listing_id"))
    down = F.when(F.col("price").isNotNull(), F.struct((-F.col("price")).alias("p"), "store_name", "listing_id"))
    g = m.groupBy(*key).agg(
        F.count(F.lit(1)).alias("members"), F.count_distinct("store_id").alias("store_count"), S.dbl(F.min("price")).alias("min_price"), S.mean("price").alias("avg_price"),
        S.dbl(F.max("price")).alias("max_price"), F.min_by("store_name", by).alias("cheapest_store"), F.min_by("store_name", down).alias("highest_store"),
        n_if(F.col("availability") == "in_stock").alias("in_stock_stores"), n_if(F.col("availability") == "out_of_stock").alias("out_of_stock_stores"),
    )
    lo, hi = F.col("min_price"), F.col("max_price")
    out = heads.join(g, key, "left").na.fill(0, ["members", "store_count", "in_stock_stores", "out_of_stock_stores"])
    return out.select(
        *key, F.col("rep.entity_id").alias("representative"), F.col("rep.canonical_title").alias("title"), F.col("rep.brand").alias("brand"), F.col("rep.category").alias("category"),
        "entities", "members", "store_count", "min_price", "avg_price", "max_price", "cheapest_store", "highest_store",
        F.when((hi > 0) & (hi != lo), S.rnd((hi - lo) / hi * 100, 1)).alias("savings_pct"), "in_stock_stores", "out_of_stock_stores", "last_change",
    )


def sort_clusters(c: DataFrame, m: DataFrame | None = None, needle: str | None = None, key: str = "stores") -> DataFrame:
    """Clusters whose title, brand, category or a store's name contains the text, in one of six orders."""
    if needle:
        own = F.contains(X.search_text("title", "brand", "category"), F.lit(needle.lower()))
        if m is not None:
            hit = m.where(F.contains(F.lower("store_name"), F.lit(needle.lower()))).select("org_id", "cluster_key").distinct().withColumn("_hit", F.lit(True))
            c = c.join(hit, ["org_id", "cluster_key"], "left").where(own | F.col("_hit")).drop("_hit")
        else:
            c = c.where(own)
    order = {
        "stores": [F.desc("store_count")], "price_asc": [F.asc_nulls_last("min_price")], "price_desc": [F.desc_nulls_last("max_price")],
        "savings": [F.desc_nulls_last("savings_pct")], "updated": [F.desc_nulls_last("last_change")], "title": [],
    }[key]
    return c.orderBy(*order, F.asc("title"), F.asc("org_id"), F.asc("cluster_key"))


GROUP_KEYS = {
    "brand": lambda: F.coalesce("brand", F.lit("Unknown brand")), "category": lambda: F.coalesce("category", F.lit("Uncategorized")),
    "stock": lambda: F.replace("stock_status", F.lit("_"), F.lit(" ")), "volatility": lambda: S.volatility_class("volatility"),
    "discount": lambda: F.when(F.col("active_discounts") > 0, "discounted").otherwise("not discounted"), "price_range": lambda: S.price_band("current_avg_price"),
    "competitor": lambda: F.when(F.col("competitors_count") > 1, "multi competitor").otherwise("single competitor"),
}

GROUP_AGGS = lambda: [
    F.count(F.lit(1)).alias("count"), S.rnd(F.avg("current_avg_price"), 2).alias("avg_price"), S.rnd(F.avg("volatility"), 1).alias("volatility"),
]


def group_entities(e: DataFrame) -> DataFrame:
    """All seven groupings in one pass (grouping sets)."""
    names = list(GROUP_KEYS)
    keyed = e.select("org_id", "current_avg_price", "volatility", *[GROUP_KEYS[n]().alias(f"k_{n}") for n in names])
    vol = keyed.withColumnRenamed("volatility", "_vol")
    sets = [[F.col("org_id"), F.col(f"k_{n}")] for n in names]
    g = vol.groupingSets(sets, "org_id", *[f"k_{n}" for n in names]).agg(
        F.count(F.lit(1)).alias("count"), S.rnd(F.avg("current_avg_price"), 2).alias("avg_price"), S.rnd(F.avg("_vol"), 1).alias("volatility"))
    by = reduce(lambda acc, n: F.when(F.col(f"k_{n}").isNotNull(), n).otherwise(acc), names, F.lit(None).cast("string"))
    return g.select("org_id", by.alias("group_by"), F.coalesce(*[F.col(f"k_{n}") for n in names]).alias("key"), "count", "avg_price", "volatility")


def entity_pages(e: DataFrame) -> DataFrame:
    """Every category's entities by brand and every brand's entities by category."""
    cat, brand = F.coalesce("category", F.lit("Uncategorized")), F.coalesce("brand", F.lit("Unknown brand"))
    g = e.groupBy("org_id", cat.alias("category"), brand.alias("brand")).agg(*GROUP_AGGS())
    kind = lambda name, page, key: F.struct(F.lit(name).alias("page"), F.col(page).alias("value"), F.col(key).alias("key"))
    return g.select("org_id", F.inline(F.array(kind("category", "category", "brand"), kind("brand", "brand", "category"))), "count", "avg_price", "volatility")


def entity_page(e: DataFrame, kind: str, value: str) -> DataFrame:
    return entity_pages(e).where((F.col("page") == kind) & (F.lower("value") == value.lower()))


def product_summary(e: DataFrame, c: DataFrame) -> DataFrame:
    g = e.groupBy("org_id").agg(
        S.rnd(F.avg("current_avg_price"), 2).alias("average_price"), n_if(F.col("volatility") >= 10).alias("volatile"), n_if(F.col("active_discounts") > 0).alias("discounted"),
        n_if(F.col("stale")).alias("stale"), n_if(F.col("missing_price")).alias("missing_price"), F.count(F.lit(1)).alias("entities"))
    k = c.groupBy("org_id").agg(n_if(F.col("store_count") > 1).alias("multi_store_groups"), F.max("savings_pct").alias("best_saving_pct"))
    return g.join(k, "org_id")


def product_insights(t: Tables, limit: int = 32) -> DataFrame:
    """Tagged selections from all entities of each tenant, the most volatile first in each."""
    e = product_entities(t, with_sparkline=False)
    pct = F.concat(F.format_string("%.1f", "volatility"), F.lit("%"))
    picks = [
        (1, "biggest_price_drops", F.col("market_trend") == "falling", F.lit("success"), F.concat(pct, F.lit(" volatility")), 6),
        (2, "biggest_price_increases", F.col("market_trend") == "rising", F.lit("warning"), F.concat(pct, F.lit(" volatility")), 6),
        (3, "unstable_products", F.col("volatility") >= 10, F.when(F.col("volatility") >= 25, "critical").otherwise("warning"), pct, 8),
        (4, "most_discounted", F.col("active_discounts") > 0, F.lit("info"), F.concat(F.col("active_discounts").cast("string"), F.lit(" discounts")), 8),
        (5, "stock_recovery_or_disappearing", F.col("stock_status").isin("out_of_stock", "mixed"),
         F.when(F.col("stock_status") == "out_of_stock", "critical").otherwise("warning"), F.replace("stock_status", F.lit("_"), F.lit(" ")), 8),
    ]
    tag = lambda b, kind, sev, metric: F.struct(F.lit(b).cast("bigint").alias("block"), F.lit(kind).alias("type"), sev.alias("severity"), metric.alias("metric"), F.lit(0).alias("_"))
    tags = F.array_compact(F.array(*[F.when(cond, tag(b, kind, sev, metric)) for b, kind, cond, sev, metric, _ in picks]))
    wanted = sort_order("volatility_desc")
    rows = e.withColumn("_tags", tags).select("*", F.inline("_tags")).drop("_", "_tags")
    placed = top_k(rows, ["org_id", "block"], wanted, 8, rank="place").select(
        "org_id", "entity_id", F.col("canonical_title").alias("title"), "block", "type", "severity", "metric", "place")
    quota = F.create_map(*[F.lit(x) for b, *_, k in picks for x in (b, k)])
    kept = placed.where(F.col("place") <= F.element_at(quota, F.col("block").cast("int")))
    return top_k(kept, ["org_id"], [F.asc("block"), F.asc("place")], limit)
