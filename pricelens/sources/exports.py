"""Exports as plans, and the sinks they are written to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators.ordered import latest_per_key
from .catalog import Tables

SNAPSHOT_DAYS, HISTORY_DAYS = 30, 180


def _capped(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def _stores(t: Tables) -> DataFrame:
    return t.stores.select("store_id", F.col("name").alias("store"))


def export_snapshots(t: Tables, days: int = SNAPSHOT_DAYS, limit: int | None = None) -> DataFrame:
    """Observations of the last days, newest first.  No cap unless one is asked for."""
    s = t.snapshots.where(F.col("scraped_at") >= t.ago(days=days))
    j = s.join(t.listings.select("listing_id", F.col("title").alias("listing_title")), "listing_id").join(_stores(t), "store_id")
    out = j.orderBy(F.desc("scraped_at"), F.desc("snapshot_id"))
    return _capped(out, limit).select("scraped_at", F.col("listing_title").alias("title"), "store", S.dbl("price").alias("price"), "currency", "availability", "source", "snapshot_id")


def export_products(t: Tables) -> DataFrame:
    return t.my_products.select("org_id", "sku", "gtin", "brand", "name", S.dbl("my_price").alias("my_price"), "currency")


def export_matches(t: Tables) -> DataFrame:
    own = t.my_products.select("product_id", F.col("name").alias("my_name"), F.col("sku").alias("my_sku"))
    seen = t.listings.select("listing_id", "store_id", F.col("title").alias("competitor_title"))
    j = t.matches.join(own, "product_id").join(seen, "listing_id").join(_stores(t), "store_id")
    return j.select("org_id", "match_id", "my_name", "my_sku", "competitor_title", "store", "method", S.dbl("confidence").alias("confidence"), "status")


def product_intelligence(t: Tables) -> DataFrame:
    """One row per own product over its confirmed listings."""
    newest = latest_per_key(t.snapshots, ["listing_id"], ["price", "old_price", "currency", "availability"])
    ok = t.matches.where(F.col("status") == "confirmed").select("product_id", "listing_id").distinct()
    m = ok.join(t.listings.select("listing_id", "last_scraped_at"), "listing_id").join(newest, "listing_id", "left")
    a = F.col("availability")
    g = m.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("competitors"), S.dbl(F.min("price")).alias("current_min_price"), S.mean("price").alias("current_avg_price"), S.dbl(F.max("price")).alias("current_max_price"),
        F.min_by("currency", F.when(F.col("currency").isNotNull(), F.col("listing_id"))).alias("seen_currency"), F.count_if(a == "in_stock").alias("i"), F.count_if(a == "out_of_stock").alias("o"),
        F.count_if(F.col("old_price") > F.col("price")).alias("discounts"), F.max("last_scraped_at").alias("seen_at"),
    )
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    j = t.my_products.select("org_id", "product_id", "name", "brand", "currency", "updated_at").join(g, "product_id", "left")
    return j.select(
        "org_id", "product_id", F.col("name").alias("canonical_title"), "brand", n("competitors").alias("competitors"), "current_min_price", "current_avg_price", "current_max_price",
        F.coalesce("seen_currency", "currency", F.lit("EUR")).alias("currency"), S.stock_status(n("i"), n("o"), F.lit(0)).alias("stock_status"), n("discounts").alias("active_discounts"),
        F.greatest("seen_at", "updated_at").alias("last_update"))


def product_history(t: Tables, days: int = HISTORY_DAYS, limit: int | None = None) -> DataFrame:
    ok = t.matches.where(F.col("status") == "confirmed").select("listing_id", "product_id")
    own = t.my_products.select("product_id", F.col("name").alias("own_name"))
    names = t.listings.select("listing_id", F.col("title").alias("listing_title"), "url").join(ok, "listing_id", "left").join(own, "product_id", "left")
    names = names.select("listing_id", F.coalesce("own_name", "listing_title", "url").alias("canonical_title"))
    s = t.snapshots.where(F.col("scraped_at") >= t.ago(days=days)).join(names, "listing_id").join(_stores(t), "store_id")
    out = s.orderBy(F.desc("scraped_at"), F.desc("snapshot_id"))
    return _capped(out, limit).select("canonical_title", F.col("store").alias("competitor"), "scraped_at", S.dbl("price").alias("price"), S.dbl("old_price").alias("old_price"), "currency", "availability",
                                      S.dbl("confidence").alias("confidence"), "source", "snapshot_id")


def workbook_slices(t: Tables) -> dict[str, DataFrame]:
    """The two sheets of the analytics workbook as tables."""
    summary = t.listings.groupBy("org_id").agg(F.count(F.lit(1)).alias("value")).select("org_id", F.lit("Monitored products").alias("metric"), "value")
    latest = t.listings.join(_stores(t), "store_id").select(
        "org_id", "listing_id", "title", "store", S.dbl("last_snapshot_price").alias("price"), F.col("last_snapshot_currency").alias("currency"),
        F.col("last_snapshot_availability").alias("availability"), F.col("last_scraped_at").alias("last_scraped"))
    return {"summary": summary, "latest": latest}


def write_export(df: DataFrame, path: str, fmt: str = "csv", partition_by: list[str] | None = None) -> None:
    """CSV with header, JSON lines or Parquet; the files are written by the tasks, never through the driver."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
