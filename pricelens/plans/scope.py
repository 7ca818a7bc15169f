"""Shared bases: filtered observations, newest observation per listing, listing dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators.ordered import latest_per_key, with_previous
from ..sources.catalog import Tables
from .filters import Filters


def confirmed_matches(t: Tables) -> DataFrame:
    return t.matches.where(F.col("status") == "confirmed").select("listing_id", "match_id", "product_id")


def with_confirmed_match(listings: DataFrame, t: Tables) -> DataFrame:
    """Listings with their confirmed own product; unmatched listings stay.

    Products grow with the catalogue and their files are small for what they hold, so they are merged, never sent whole to every task.
    """
    cat = t.categories.select(F.col("category_id").alias("_cat"), F.col("name").alias("category_name"))
    own = t.my_products.select(
        "product_id", F.col("name").alias("product_name"), F.col("brand").alias("product_brand"), F.col("sku").alias("product_sku"),
        F.col("gtin").alias("product_gtin"), F.col("category_id"),
    )
    return (
        listings.join(confirmed_matches(t), "listing_id", "left")
        .join(own.hint("merge"), "product_id", "left")
        .join(cat, F.col("category_id") == F.col("_cat"), "left")
        .drop("_cat")
    )


def store_names(t: Tables) -> DataFrame:
    return t.stores.select("store_id", F.col("name").alias("store_name"))


def listing_dims(t: Tables) -> DataFrame:
    cols = ["listing_id", "org_id", "store_id", "title", "url", "brand", "image_url", "last_scraped_at", "selector_failure_count",
            "last_snapshot_currency"]
    return with_confirmed_match(t.listings.select(*cols), t).join(store_names(t), "store_id")


def listing_predicates(f: Filters, t: Tables) -> list[Column]:
    """Filters that keep or drop a listing with all its observations."""
    out = []
    if f.competitor is not None:
        out.append((F.col("store_id").cast("string") == f.competitor) | (F.lower("store_name") == f.competitor.lower()))
    if f.category is not None:
        out.append((F.col("category_id") == f.category) | (F.lower(F.coalesce("category_name", F.lit(""))) == f.category.lower()))
    if f.brand is not None:
        out.append(F.lower(F.coalesce("product_brand", "brand", F.lit("Unknown"))) == f.brand.lower())
    if f.stale_only:
        out.append(F.col("last_scraped_at").isNull() | (F.col("last_scraped_at") < t.ago(hours=24)))
    if f.reviewed_only:
        out.append(F.col("match_id").isNotNull())
    return out


def snapshot_predicates(f: Filters) -> list[Column]:
    out = []
    if f.availability is not None:
        out.append(F.col("availability") == f.availability)
    if f.discount_only:
        out.append(F.col("old_price") > F.col("price"))
    if f.in_stock_only:
        out.append(F.col("availability") == "in_stock")
    if f.low_confidence_only:
        out.append(F.col("confidence") < 0.7)
    if f.min_price is not None:
        out.append(F.col("price") >= f.min_price)
    if f.max_price is not None:
        out.append(F.col("price") <= f.max_price)
    return out


def between(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    if low is not None:
        df = df.where(F.col(column) >= F.lit(low))
    if high is not None:
        df = df.where(F.col(column) < F.lit(high))
    return df


def snapshot_scope(t: Tables, f: Filters, low=None, high=None) -> DataFrame:
    """Observations of a period that pass the filters.

    Filters on the listing side decide about a whole listing, so they become one semi-join and the
    observations stay narrow; names and products are joined later and only by plans that show them.
    """
    df = between(t.snapshots, "scraped_at", low, high)
    for p in snapshot_predicates(f):
        df = df.where(p)
    preds = listing_predicates(f, t)
    if preds:
        dims = listing_dims(t)
        for p in preds:
            dims = dims.where(p)
        df = df.join(dims.select("listing_id"), "listing_id", "left_semi")
    return df


def enriched_scope(t: Tables, f: Filters, low=None, high=None) -> DataFrame:
    """Scope rows with listing, store, product and category columns."""
    dims = listing_dims(t).drop("org_id", "store_id").withColumnsRenamed({"title": "listing_title", "image_url": "listing_image_url"})
    for p in listing_predicates(f, t):
        dims = dims.where(p)
    base = between(t.snapshots, "scraped_at", low, high)
    for p in snapshot_predicates(f):
        base = base.where(p)
    return base.join(dims, "listing_id").withColumn("currency", F.coalesce("currency", "last_snapshot_currency", F.lit("EUR")))


def sequenced(t: Tables, df: DataFrame, low=None, high=None, price=True, availability=False) -> DataFrame:
    """Scope rows with the price / availability observed before, per listing."""
    values = {}
    if price:
        values["previous_price"] = "price"
    if availability:
        values["previous_availability"] = "availability"
    sizes = between(t.snapshots, "scraped_at", low, high).select("listing_id", "scraped_at")
    return with_previous(df, values, sizes=sizes)


def latest_scope(t: Tables, f: Filters) -> DataFrame:
    """One row per listing with its newest observation that passes the filters.

    The newest observation is found before anything is joined, so the joins see one row per listing.
    Listings without observations stay unless a filter on observations is set.
    """
    preds = snapshot_predicates(f)
    snaps = t.snapshots
    for p in preds:
        snaps = snaps.where(p)
    cols = ["price", "old_price", "currency", "availability", "confidence", "status", "scraped_at"]
    newest = latest_per_key(snaps, ["listing_id"], cols)
    dims = listing_dims(t)
    for p in listing_predicates(f, t):
        dims = dims.where(p)
    joined = dims.join(newest, "listing_id", "inner" if preds else "left")
    joined = joined.withColumnRenamed("status", "snapshot_status")
    # a listing confirmed for several products counts once, with the smallest product id
    once = joined.groupBy("listing_id").agg(F.min_by(F.struct(*[c for c in joined.columns if c != "listing_id"]), F.coalesce("product_id", F.lit(0))).alias("r"))
    out = once.select("listing_id", "r.*")
    return out.withColumn("currency", F.coalesce("currency", "last_snapshot_currency", F.lit("EUR")))


def entity_key() -> Column:
    """Own product if matched, else the listing."""
    return F.coalesce(F.concat(F.lit("p"), F.col("product_id").cast("string")), F.concat(F.lit("l"), F.col("listing_id").cast("string")))


def changed(cur="price", prev="previous_price") -> Column:
    return F.col(prev).isNotNull() & (F.col(cur) != F.col(prev))


def dropped() -> Column:
    return F.col("previous_price").isNotNull() & (F.col("price") < F.col("previous_price"))


def raised() -> Column:
    return F.col("previous_price").isNotNull() & (F.col("price") > F.col("previous_price"))


def discount0() -> Column:
    """Discount in percent with 0 where there is none."""
    return F.when(F.col("old_price") > F.col("price"), S.dbl(F.col("old_price") - F.col("price")) / S.dbl("old_price") * 100).otherwise(0.0)
