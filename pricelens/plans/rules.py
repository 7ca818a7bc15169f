"""Extraction-rule history, work-item reports and due lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import top_k
from ..sources.catalog import Tables

# fixed list of rule fields under version control
SELECTOR_FIELDS = [
    "titleSelector", "priceSelector", "oldPriceSelector", "availabilitySelector", "imageSelector", "brandSelector", "skuSelector",
    "breadcrumbsSelector", "productCardSelector", "cardTitleSelector", "cardPriceSelector", "cardOldPriceSelector", "cardImageSelector",
    "cardLinkSelector", "cardAvailabilitySelector", "paginationNextSelector", "loadMoreSelector", "shippingSelector", "ratingSelector", "priceRegex",
]
# fixed list of failures a repair cannot help with
NON_REPAIRABLE = ["blocked", "captcha", "suspicious", "http_error", "skipped_robots"]


def latest_version(versions: DataFrame) -> DataFrame:
    return versions.groupBy("store_id", "selector_type").agg(
        F.max("version").alias("version"), F.max_by("selector_value", "version").alias("selector_value"), F.max_by("version_id", "version").alias("version_id"))


def long_rules(rules: DataFrame) -> DataFrame:
    """Wide rule rows as (store, field, value); blank values are left out."""
    fields = [c for c in SELECTOR_FIELDS if c in rules.columns]
    rows = rules.select("store_id", F.inline(F.array(*[F.struct(F.lit(f).alias("selector_type"), F.col(f).cast("string").alias("selector_value")) for f in fields])))
    return rows.where(F.trim(F.coalesce("selector_value", F.lit(""))) != "")


def append_versions(versions: DataFrame, rules: DataFrame, source: str = "manual", confidence: float | None = None) -> DataFrame:
    """A new version for every field whose value differs from its latest one."""
    last = latest_version(versions).select("store_id", "selector_type", F.col("version").alias("_v"), F.col("selector_value").alias("previous_value"))
    j = long_rules(rules).join(last, ["store_id", "selector_type"], "left")
    new = j.where(~F.col("previous_value").eqNullSafe(F.col("selector_value")))
    return new.select(
        "store_id", "selector_type", (F.coalesce("_v", F.lit(0)) + 1).alias("version"), "selector_value", "previous_value",
        F.lit(source).alias("source"), F.lit(confidence).cast("double").alias("confidence"))


def rollback(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each named version a new one with its value (``wanted``: version_id, one per store and field)."""
    back = versions.join(wanted.select("version_id"), "version_id", "left_semi").where(F.col("selector_type").isin(SELECTOR_FIELDS))
    last = latest_version(versions).select("store_id", "selector_type", F.col("version").alias("_v"), F.col("selector_value").alias("previous_value"))
    return back.join(last, ["store_id", "selector_type"]).select(
        "store_id", "selector_type", (F.col("_v") + 1).alias("version"), "selector_value", "previous_value", F.lit("rollback").alias("source"),
        F.col("version_id").alias("rolled_back_from"))


def current_rules(versions: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One row per store, one column per field, with the latest values."""
    fields = fields or SELECTOR_FIELDS
    return latest_version(versions).groupBy("store_id").pivot("selector_type", fields).agg(F.max("selector_value"))


def repair_decision(status, failures, has_artifact, enabled, confidence, same_run, last_hour):
    """Reason why a failed extraction is or is not worth a repair, tested in fixed order."""
    return (
        F.when(~enabled, "ai_disabled").when(~has_artifact, "html_artifact_missing")
        .when(status.isin(NON_REPAIRABLE), F.concat(F.lit("non_repairable_"), status))
        .when(same_run > 0, "already_attempted_this_scrape_run").when(last_hour >= 3, "competitor_hourly_limit_reached")
        .when((status == "parse_failed") & (failures >= 1), "parse_failed")
        .when((F.coalesce(confidence, F.lit(1.0)) < 0.45) & (failures >= 1), "low_confidence").otherwise("policy_not_triggered")
    )


def repair_eligible(fails: DataFrame) -> DataFrame:
    c = F.col
    reason = repair_decision(c("status"), c("selector_failure_count"), c("has_html_artifact"), c("ai_enabled"), c("confidence").cast("double"), c("same_run_attempts"), c("attempts_last_hour"))
    return fails.withColumn("reason", reason).withColumn("eligible", F.col("reason").isin("parse_failed", "low_confidence"))


def due_stores(t: Tables) -> DataFrame:
    return due_listings(t, None).select("org_id", "store_id").distinct()


def due_listings(t: Tables, per_store: int | None = 200) -> DataFrame:
    """Active listings of active stores whose next run has come, unless the tenant switched automation off."""
    st = t.stores.where(F.col("status") == "active").select("store_id")
    on = t.settings.select("org_id", "enabled")
    due = t.listings.where(F.col("active") & (F.col("next_run_at") <= t.now)).join(st, "store_id", "left_semi").join(on, "org_id", "left")
    due = due.where(F.coalesce("enabled", F.lit(True))).select("org_id", "store_id", "listing_id", "next_run_at")
    if per_store is None:
        return due
    return top_k(due, ["store_id"], [F.asc("next_run_at"), F.asc("listing_id")], per_store, rank="position")


def due_shipments(t: Tables, as_of, k: int = 25) -> DataFrame:
    on = t.settings.where("enabled").select("org_id")
    due = t.shipments.where(F.col("tracking_enabled") & (F.col("next_check_at") <= F.lit(as_of))).join(on, "org_id", "left_semi")
    first = due.orderBy(F.asc("next_check_at"), F.asc("shipment_id")).limit(k)
    payload = F.to_json(F.struct(F.lit(1).alias("inputVersion"), F.col("shipment_id").cast("string").alias("shipmentId"), F.col("tracking_number").alias("trackingNumber")))
    return first.select("org_id", "shipment_id", "next_check_at", payload.alias("payload"), F.concat(F.lit("shipment:"), F.col("shipment_id").cast("string")).alias("dedupe_key"))


def where_payload(items: DataFrame, field: str, values: list) -> DataFrame:
    return items.where(F.get_json_object("payload", f"$.{field}").isin([str(v) for v in values]))


TERMINAL = ["succeeded", "partial", "failed", "cancelled"]


def prunable(items: DataFrame, keep: int = 3) -> DataFrame:
    """Finished shipment items beyond the newest ``keep`` of their shipment.

    The newest ``keep`` per key are found with a map-side limit and taken away by an anti-join, so the
    long tail of a busy key is never sorted in one task.
    """
    done = items.where((F.col("type") == "shipment_tracking") & F.col("status").isin(TERMINAL))
    ship = F.get_json_object("payload", "$.shipmentId")
    key = F.coalesce(F.concat(F.lit("shipment:"), ship), F.col("dedupe_key"), F.concat(F.lit("job:"), F.col("id").cast("string")))
    keyed = done.withColumn("group_key", key)
    kept = top_k(keyed.select("id", "group_key", "created_at"), ["group_key"], [F.desc("created_at"), F.desc("id")], keep)
    return keyed.join(kept.select("id"), "id", "left_anti").select("id", "group_key", "created_at")


PRIORITY_WEIGHT = {"critical": 0, "high": 10, "normal": 20}


def rank_items(items: DataFrame, settings: DataFrame, as_of, k: int | None = None) -> DataFrame:
    """Backlog report: queued items of tenants below their running limit, by weight less age credit."""
    running = items.where(F.col("status") == "running").groupBy("org_id").agg(F.count(F.lit(1)).alias("running"))
    open_ = items.where((F.col("status") == "queued") & (F.col("scheduled_at") <= F.lit(as_of)))
    j = open_.join(settings.select("org_id", "enabled", "max_concurrent_jobs"), "org_id", "left").join(running, "org_id", "left")
    j = j.where(F.coalesce("enabled", F.lit(True)) & (F.coalesce("running", F.lit(0)) < F.coalesce("max_concurrent_jobs", F.lit(1))))
    weight = F.when(F.col("priority") == "critical", 0).when(F.col("priority") == "high", 10).when(F.col("priority") == "normal", 20).otherwise(30)
    credit = F.least(F.lit(20), F.floor((F.unix_seconds(F.lit(as_of)) - F.unix_seconds("created_at")) / 21600))
    j = j.withColumn("score", (weight - credit).cast("bigint"))
    order = [F.asc("score"), F.asc("scheduled_at"), F.asc("created_at"), F.asc("id")]
    if k is None:
        return j.select("org_id", "id", "priority", "score", "scheduled_at")
    return top_k(j, ["org_id"], order, k, rank="position").select("org_id", "id", "priority", "score", "position")


def dead_letters(items: DataFrame, k: int = 200) -> DataFrame:
    return top_k(items.where(F.col("status") == "dead_letter"), ["org_id"], [F.desc("created_at"), F.desc("id")], k)
