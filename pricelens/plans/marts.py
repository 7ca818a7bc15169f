"""Daily marts and crawl reports.  Each mart is one grouped pass, written partition-wise by day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..sources.catalog import Tables
from .products import edges
from .scope import changed, confirmed_matches, discount0, dropped, sequenced

n_if = F.count_if
DAY = lambda: F.to_date("scraped_at").alias("bucket_date")


def rollup_org_day(t: Tables) -> DataFrame:
    per = t.snapshots.groupBy("org_id", DAY(), "listing_id").agg(
        F.count(F.lit(1)).alias("n"), n_if(F.col("status") == "ok").alias("ok"), F.sum("price").alias("p"), F.count("price").alias("pn"))
    g = per.groupBy("org_id", "bucket_date").agg(
        F.count(F.lit(1)).alias("listings"), F.sum("n").alias("snapshots"), F.sum("ok").alias("ok"), S.rnd(S.dbl(F.sum("p")) / F.sum("pn"), 2).alias("avg_price"))
    return g.withColumn("metrics", F.to_json(F.struct("listings", "snapshots", "ok", "avg_price")))


def rollup_store_day(t: Tables) -> DataFrame:
    seq = sequenced(t, t.snapshots, availability=True)
    failed = t.runs.where(F.col("status") == "failed").groupBy("store_id", F.to_date("created_at").alias("bucket_date")).agg(F.count(F.lit(1)).alias("failed"))
    # one row per listing and day first, so listings are counted without telling raw rows apart
    per = seq.groupBy("org_id", "store_id", DAY(), "listing_id").agg(
        F.sum("price").alias("p"), F.count("price").alias("pn"), F.sum(F.when(F.col("price").isNotNull(), discount0())).alias("d"),
        n_if(changed()).alias("changes"), n_if(dropped()).alias("drops"), n_if(changed("availability", "previous_availability")).alias("stock_changes"),
        F.sum("confidence").alias("c"), F.count("confidence").alias("cn"), n_if(F.col("status") == "ok").alias("ok"), F.count(F.lit(1)).alias("n"))
    g = per.groupBy("org_id", "store_id", "bucket_date").agg(
        F.count(F.lit(1)).alias("products_count"), S.rnd(S.dbl(F.sum("p")) / F.sum("pn"), 2).alias("avg_price"), S.rnd(F.sum("d") / F.sum("pn"), 2).alias("avg_discount"),
        F.sum("changes").alias("changes"), F.sum("drops").alias("drops"), F.sum("stock_changes").alias("stock_changes"),
        S.rnd(S.dbl(F.sum("c")) / F.sum("cn"), 3).alias("conf"), F.sum("ok").alias("ok"), F.sum("n").alias("n"),
    ).join(failed, ["store_id", "bucket_date"], "left")
    return g.select(
        "org_id", "store_id", "bucket_date", "products_count", "avg_price", F.coalesce("avg_discount", F.lit(0.0)).alias("avg_discount"),
        S.aggressiveness("drops", S.rnd(F.coalesce("avg_discount", F.lit(0.0)), 0), "changes", "stock_changes", F.coalesce("failed", F.lit(0))).alias("aggressiveness_score"),
        S.quality_score(F.col("avg_price").isNotNull(), F.lit(True), F.col("conf"), F.lit(True), F.col("ok") / F.col("n") >= 0.8, F.lit(True)).alias("data_quality_score"))


def rollup_category_day(t: Tables) -> DataFrame:
    own = t.my_products.select("product_id", "category_id")
    cat = t.categories.select("category_id", F.col("name").alias("category_name"))
    dims = confirmed_matches(t).join(own, "product_id").join(cat, "category_id").select("listing_id", "product_id", "category_name")
    per = sequenced(t, t.snapshots).groupBy("org_id", DAY(), "listing_id").agg(
        F.sum("price").alias("p"), F.count("price").alias("pn"), F.min("price").alias("lo"), F.max("price").alias("hi"), n_if(changed()).alias("changes"))
    per = per.join(dims, "listing_id", "left").withColumn("category_name", F.coalesce("category_name", F.lit("Uncategorized")))
    key = F.coalesce(F.concat(F.lit("p"), F.col("product_id").cast("string")), F.concat(F.lit("l"), F.col("listing_id").cast("string")))
    g = per.groupBy("org_id", "category_name", "bucket_date").agg(
        F.count_distinct(key).alias("products_count"), S.rnd(S.dbl(F.sum("p")) / F.sum("pn"), 2).alias("avg_price"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.sum("changes").alias("changes"))
    return g.select("org_id", "category_name", "bucket_date", "products_count", "avg_price", S.category_volatility("lo", "hi", "avg_price", "changes").alias("volatility_score"))


def _entity_day(t: Tables) -> DataFrame:
    """Observations reduced to one row per listing and day, then attached to entities."""
    a = F.col("availability")
    per = t.snapshots.groupBy("listing_id", DAY()).agg(
        F.min("price").alias("lo"), F.max("price").alias("hi"), F.sum("price").alias("s"), F.count("price").alias("n"), F.max("currency").alias("currency"),
        n_if(a == "in_stock").alias("i"), n_if(a == "out_of_stock").alias("o"), n_if(a.isNull() | ~a.isin("in_stock", "out_of_stock")).alias("u"))
    return per.join(edges(t), "listing_id")


def rollup_product_day(t: Tables) -> DataFrame:
    g = _entity_day(t).groupBy("org_id", F.col("entity_id").alias("entity_key"), "bucket_date").agg(
        S.dbl(F.min("lo")).alias("min_price"), S.rnd(S.dbl(F.sum("s")) / F.sum("n"), 2).alias("avg_price"), S.dbl(F.max("hi")).alias("max_price"),
        S.rnd(F.sum("i") / (F.sum("i") + F.sum("o") + F.sum("u")), 3).alias("stock_ratio"))
    return g.withColumn("volatility_score", S.volatility("min_price", "max_price", "avg_price"))


def price_history(t: Tables) -> DataFrame:
    priced = _entity_day(t).where(F.col("n") > 0)
    g = priced.groupBy("org_id", F.col("entity_id").alias("entity_key"), "bucket_date").agg(
        S.dbl(F.min("lo")).alias("min_price"), S.rnd(S.dbl(F.sum("s")) / F.sum("n"), 2).alias("avg_price"), S.dbl(F.max("hi")).alias("max_price"),
        F.max("currency").alias("currency"), F.count(F.lit(1)).alias("competitors_count"))
    return g.withColumn("volatility_score", S.volatility("min_price", "max_price", "avg_price"))


def availability_history(t: Tables) -> DataFrame:
    g = _entity_day(t).groupBy("org_id", F.col("entity_id").alias("entity_key"), "bucket_date").agg(
        F.sum("i").alias("in_stock_count"), F.sum("o").alias("out_of_stock_count"), F.sum("u").alias("unknown_count"))
    total = F.col("in_stock_count") + F.col("out_of_stock_count") + F.col("unknown_count")
    return g.withColumn("stock_ratio", S.rnd(F.col("in_stock_count") / total, 3))


def write_mart(df: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    """Replace only the partitions present in ``df`` (dynamic overwrite); one task per day writes its files."""
    cols = partitions or ["bucket_date"]
    df.repartition(*[F.col(c) for c in cols]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*cols).parquet(path)


def discovery_summary(runs: DataFrame, pages: DataFrame, categories: DataFrame, products: DataFrame, logs: DataFrame, as_of) -> DataFrame:
    """One row per crawl run."""
    p = pages.groupBy("run_id").agg(F.count(F.lit(1)).alias("pages_discovered"), n_if(F.col("status") == "crawled").alias("pages_crawled"), n_if(F.col("status") == "error").alias("page_errors"))
    c = categories.groupBy("run_id").agg(F.count(F.lit(1)).alias("categories_found"))
    d = products.groupBy("run_id").agg(F.count(F.lit(1)).alias("products_found"), S.mean("price").alias("average_price"), S.dbl(F.min("price")).alias("min_price"), S.dbl(F.max("price")).alias("max_price"))
    e = logs.groupBy("run_id").agg(n_if(F.col("level") == "error").alias("log_errors"))
    j = runs.select("run_id", "started_at", "finished_at")
    for other in (p, c, d, e):
        j = j.join(other, "run_id", "left")
    n = lambda x: F.coalesce(F.col(x), F.lit(0))
    ms = F.greatest(F.lit(0), F.unix_millis(F.coalesce("finished_at", as_of)) - F.unix_millis("started_at"))
    return j.select("run_id", n("pages_discovered").alias("pages_discovered"), n("pages_crawled").alias("pages_crawled"), n("categories_found").alias("categories_found"),
                    n("products_found").alias("products_found"), (n("page_errors") + n("log_errors")).alias("errors"), ms.alias("duration_ms"), "average_price", "min_price", "max_price")


def filter_discovered(d: DataFrame, text: str | None = None, path: str | None = None, discounted: bool = False, missing_price: bool = False) -> DataFrame:
    if text:
        d = d.where(F.contains(F.lower(F.concat_ws(" ", "title", "brand", "sku")), F.lit(text.lower())))
    if path:
        d = d.where(F.col("category_path") == path)
    if discounted:
        d = d.where(F.col("old_price") > F.col("price"))
    if missing_price:
        d = d.where(F.col("price").isNull())
    return d
