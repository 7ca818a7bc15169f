"""Imports: CSV rows, manual observations, discovered products, crawl reports, sitemaps, and their contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import urls as U
from ..operators.ordered import top_k
from ..operators.writes import append_if_absent, first_per_key
from .schemas import ALERT_TYPES, AVAILABILITY, CHANNELS, CURRENCIES

MY_PRODUCT_CSV = "sku STRING, name STRING, brand STRING, gtin STRING, price STRING"
LISTING_CSV = "url STRING, external_id STRING, title STRING"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of CSV files with a header, trimmed; ``row_no`` orders them as they stand in the files."""
    df = spark.read.csv(path, schema=schema, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE", enforceSchema=False)
    return df.withColumn("row_no", F.monotonically_increasing_id())


def import_my_products(rows: DataFrame, existing: DataFrame, currency: str = "EUR") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new products, rejected rows, counts).  ``rows`` carries org_id and row_no; the first row of a SKU wins."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    ok = ~blank("sku") & ~blank("name")
    price = F.col("price").try_cast("double")
    valid = rows.where(ok).select("org_id", "row_no", F.trim("sku").alias("sku"), F.trim("name").alias("name"), "brand", "gtin", F.round(price, 2).cast("decimal(12,2)").alias("my_price"))
    new = append_if_absent(first_per_key(valid, ["org_id", "sku"], ["row_no"]), existing, ["org_id", "sku"]).withColumn("currency", F.lit(currency)).drop("row_no")
    counts = rows.groupBy("org_id").agg(F.count_if(ok).alias("imported"), F.count_if(~ok).alias("skipped"))
    return new, rows.where(~ok), counts


def import_listings(rows: DataFrame, existing: DataFrame, max_errors: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new listings, error texts, counts).  ``rows`` carries org_id, store_id and row_no."""
    ok = F.coalesce(F.col("url").rlike(r"(?i)^https?://"), F.lit(False))
    keyed = rows.where(ok).withColumn("url_hash", U.url_hash("url"))
    new = append_if_absent(first_per_key(keyed, ["store_id", "url_hash"], ["row_no"]), existing, ["store_id", "url_hash"]).drop("row_no")
    bad = rows.where(~ok).select("store_id", "row_no", F.concat(F.lit("Skipped row with invalid URL: "), F.coalesce("url", F.lit("(empty)"))).alias("error"))
    errors = bad if max_errors is None else top_k(bad, ["store_id"], [F.asc("row_no")], max_errors)
    counts = rows.groupBy("store_id").agg(F.count_if(ok).alias("imported"), F.count_if(~ok).alias("skipped"))
    return new, errors, counts


def append_manual(obs: DataFrame, listings: DataFrame) -> DataFrame:
    """Manual price observations that differ from the listing's current price."""
    cur = listings.select("listing_id", "last_snapshot_price")
    differs = F.col("last_snapshot_price").isNull() | (F.abs(F.col("last_snapshot_price").cast("double") - F.col("price").cast("double")) > 0.0001)
    return obs.join(cur, "listing_id").where(differs).drop("last_snapshot_price").withColumns({"status": F.lit("ok"), "confidence": F.lit(1.0), "source": F.lit("manual")})


def promote(discovered: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new listings, counts per store) from found products with title, price and URL."""
    ok = (F.coalesce("title", F.lit("")) != "") & (F.coalesce("price", F.lit(0)) != 0) & (F.coalesce("url", F.lit("")) != "")
    good = discovered.where(ok).select(
        "store_id", "product_id", "url", U.url_hash("normalized_url").alias("url_hash"), "title", "brand", "sku", F.coalesce("gtin", "ean").alias("gtin"), "image_url", F.col("price").alias("last_snapshot_price"))
    new = append_if_absent(first_per_key(good, ["store_id", "url_hash"], ["product_id"]), existing, ["store_id", "url_hash"])
    counts = discovered.groupBy("store_id").agg(F.count_if(ok).alias("imported"), F.count_if(~ok).alias("skipped"))
    return new, counts


REPORT_SCHEMA = {
    "run_id": "BIGINT", "store_id": "BIGINT", "pages": "ARRAY<STRUCT<url: STRING, normalizedUrl: STRING, pageType: STRING, status: STRING, depth: INT>>",
    "categories": "ARRAY<STRUCT<url: STRING, name: STRING, path: STRING, productsFound: INT>>",
    "products": "ARRAY<STRUCT<url: STRING, normalizedUrl: STRING, title: STRING, price: DOUBLE, categoryUrl: STRING>>",
    "logs": "ARRAY<STRUCT<level: STRING, message: STRING>>",
}


def _report_fields(reports: DataFrame, column: str, *names: str) -> DataFrame:
    """Some fields of every report: each document is parsed once, and nothing else of it is kept."""
    schema = ", ".join(f"{n} {REPORT_SCHEMA[n]}" for n in names)
    return S.computed(reports, [], r=F.from_json(column, schema)).select("r.*")


def flatten_report(reports: DataFrame, column: str = "report", keep_logs: int | None = None) -> dict[str, DataFrame]:
    """Nested crawl reports (one JSON document per run) as four tables; a category's id follows from run and URL."""
    of = lambda *names: _report_fields(reports, column, *names)
    pages = of("run_id", "pages").select("run_id", F.inline("pages")).select("run_id", "url", F.coalesce("normalizedUrl", "url").alias("normalized_url"), F.coalesce("pageType", F.lit("unknown")).alias("page_type"),
                                                         F.coalesce("status", F.lit("crawled")).alias("status"), F.coalesce("depth", F.lit(0)).alias("depth"))
    cats = of("run_id", "store_id", "categories").select("run_id", "store_id", F.inline("categories")).select("run_id", "store_id", "url", F.coalesce("name", "url").alias("name"), "path", F.coalesce("productsFound", F.lit(0)).alias("products_found"))
    cats = cats.dropDuplicates(["run_id", "url"]).withColumn("category_id", F.concat_ws("|", F.col("run_id").cast("string"), "url"))
    prods = of("run_id", "store_id", "products").select("run_id", "store_id", F.inline("products")).join(cats.select("run_id", F.col("url").alias("categoryUrl"), "category_id"), ["run_id", "categoryUrl"], "left")
    prods = prods.select("run_id", "store_id", "url", F.coalesce("normalizedUrl", "url").alias("normalized_url"), "title", F.round("price", 2).cast("decimal(12,2)").alias("price"), "category_id")
    logs = of("run_id", "logs").select("run_id", F.posexplode("logs" if keep_logs is None else F.slice("logs", F.greatest(F.size("logs") - keep_logs + 1, F.lit(1)), keep_logs))).select("run_id", F.col("pos").alias("position"), F.coalesce("col.level", F.lit("info")).alias("level"), F.coalesce("col.message", F.lit("")).alias("message"))
    return {"pages": pages, "categories": cats, "products": prods, "logs": logs}


def sitemap_urls(xml: DataFrame, robots: DataFrame) -> DataFrame:
    """Locations of stored sitemaps and ``Sitemap:`` lines of stored robots files.

    ``xml``: root_url, xml.  ``robots``: root_url, text.  Page locations are kept when they look like a category or product.
    """
    def locs(tag):
        return F.regexp_extract_all("xml", F.lit(rf"(?s)<{tag}>(?:(?!</{tag}>).)*?<loc>\s*([^<]*?)\s*</loc>"), 1)
    def clean(tag, keep):
        # inside the array, so that every location is normalised once and not again in a pushed-down filter
        full = F.transform(locs(tag), lambda x: U.normalise_url(F.replace(F.trim(x), F.lit("&amp;"), F.lit("&")), F.col("root_url")))
        return F.explode(F.filter(full, lambda u: u.isNotNull() & keep(u)))
    urls = xml.select("root_url", clean("url", lambda u: U.is_category_url(u) | U.is_product_url(u)).alias("url")).select("root_url", "url", F.lit("page").alias("kind"))
    maps = xml.select("root_url", clean("sitemap", lambda u: F.lit(True)).alias("url"))
    lines = robots.select("root_url", F.explode(F.regexp_extract_all("text", F.lit(r"(?im)^\s*Sitemap:\s*(\S+)"), 1)).alias("url"))
    seeds = maps.select("root_url", "url", F.lit("sitemap").alias("kind")).unionByName(lines.select("root_url", "url", F.lit("sitemap").alias("kind")))
    return urls.unionByName(seeds).distinct()


# ------------------------------------------------------------------------------------------ contracts

MAX_PRICE = 1_000_000


def _len(c: str, low: int | None, high: int | None, optional=True) -> list[tuple[str, Column]]:
    n = F.length(F.col(c))
    rules = []
    if not optional:
        rules.append((f"{c}_missing", F.col(c).isNull()))
    if low:
        rules.append((f"{c}_too_short", n < low))
    if high:
        rules.append((f"{c}_too_long", n > high))
    return rules


def _price(c: str, optional=True) -> list[tuple[str, Column]]:
    rules = [(f"{c}_not_positive", F.col(c) <= 0), (f"{c}_too_high", F.col(c) > MAX_PRICE)]
    return rules if optional else [(f"{c}_missing", F.col(c).isNull()), *rules]


def contracts(name: str) -> list[tuple[str, Column]]:
    """(error, condition) pairs of a declared input contract."""
    url = lambda c: [(f"{c}_invalid", ~F.col(c).rlike(r"(?i)^https?://[^/\s]+"))]
    one_of = lambda c, allowed: [(f"{c}_unknown", F.col(c).isNull() | ~F.col(c).isin(allowed))]
    pct = lambda c: [(f"{c}_out_of_range", (F.col(c) < 0) | (F.col(c) > 100))]
    return {
        "my_product": lambda: [*_len("sku", 1, 100, False), *_len("gtin", None, 20), *_len("brand", None, 100), *_len("name", 2, 500, False), *_price("my_price"), *one_of("currency", CURRENCIES), *url("url")],
        "listing": lambda: [*url("url"), ("url_missing", F.col("url").isNull()), *_len("title", None, 500)],
        "manual_snapshot": lambda: [*_price("price", False), *_price("old_price"), *one_of("currency", CURRENCIES), *one_of("availability", AVAILABILITY)],
        "alert_rule": lambda: [*_len("name", 2, 100, False), *one_of("type", ALERT_TYPES), *pct("threshold_pct"), *pct("price_pct"),
                               ("channels_missing", F.coalesce(F.size("channels"), F.lit(0)) < 1), ("channels_unknown", F.size(F.array_except("channels", F.array(*[F.lit(c) for c in CHANNELS]))) > 0)],
    }[name]()


def validate(df: DataFrame, contract: str) -> DataFrame:
    """Add ``errors``: the names of the broken rules; split valid and quarantined rows on its size."""
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in contracts(contract)])))


def seed_snapshots(spark: SparkSession, as_of, days: int = 31) -> DataFrame:
    """Deterministic history of two listings: a falling price with noise, and a steady one that runs out of stock."""
    d = spark.range(days).withColumnRenamed("id", "d")
    noise = F.round(F.sin(F.col("d") / 3) * 4, 2)
    listing = lambda i, price, cur, avail: F.struct(F.lit(i).cast("bigint").alias("listing_id"), F.round(price, 2).cast("decimal(12,2)").alias("price"), F.lit(cur).alias("currency"), avail.alias("availability"))
    both = F.array(
        listing(1, 210 - F.col("d") * 0.5 + noise, "EUR", F.lit("in_stock")),
        listing(2, 175 + noise, "GBP", F.when(F.col("d") < 5, "out_of_stock").otherwise("in_stock")),
    )
    return d.select("d", (F.lit(as_of) - F.make_dt_interval(days=F.col("d").cast("int"))).alias("scraped_at"), F.inline(both)).withColumn("status", F.lit("ok"))
