"""Declared schemas of the domain tables (nothing is inferred from files)."""

from __future__ import annotations

DDL = {
    "stores": "store_id BIGINT, org_id BIGINT, name STRING, domain STRING, country_code STRING, currency STRING, "
    "crawl_frequency_minutes INT, js_required BOOLEAN, status STRING, discovery_preset STRING, framework STRING, "
    "last_successful_scrape_at TIMESTAMP",
    "my_products": "product_id BIGINT, org_id BIGINT, sku STRING, gtin STRING, brand STRING, name STRING, "
    "category_id STRING, my_price DECIMAL(12,2), currency STRING, url STRING, image_url STRING, active BOOLEAN, "
    "created_at TIMESTAMP, updated_at TIMESTAMP",
    "listings": "listing_id BIGINT, org_id BIGINT, store_id BIGINT, url STRING, url_hash STRING, title STRING, "
    "brand STRING, sku STRING, gtin STRING, image_url STRING, active BOOLEAN, last_scraped_at TIMESTAMP, "
    "last_change_at TIMESTAMP, next_run_at TIMESTAMP, selector_failure_count INT, last_snapshot_price DECIMAL(12,2), "
    "last_snapshot_currency STRING, last_snapshot_availability STRING, created_at TIMESTAMP",
    "snapshots": "snapshot_id BIGINT, org_id BIGINT, listing_id BIGINT, store_id BIGINT, scraped_at TIMESTAMP, "
    "price DECIMAL(12,2), old_price DECIMAL(12,2), currency STRING, availability STRING, shipping_text STRING, "
    "rating DECIMAL(3,2), title STRING, image_url STRING, status STRING, confidence DECIMAL(3,2), source STRING, "
    "http_status INT, duration_ms INT, run_id BIGINT",
    "runs": "run_id BIGINT, org_id BIGINT, store_id BIGINT, status STRING, started_at TIMESTAMP, finished_at TIMESTAMP, "
    "products_total INT, products_ok INT, products_failed INT, created_at TIMESTAMP",
    "matches": "match_id BIGINT, org_id BIGINT, product_id BIGINT, listing_id BIGINT, method STRING, "
    "confidence DECIMAL(4,3), status STRING, decided_at TIMESTAMP, created_at TIMESTAMP",
    "categories": "category_id STRING, org_id BIGINT, parent_id STRING, name STRING, slug STRING",
    "alert_rules": "rule_id BIGINT, org_id BIGINT, name STRING, type STRING, params STRUCT<thresholdPct: DOUBLE, pricePct: DOUBLE>, "
    "scope_product_id BIGINT, scope_listing_id BIGINT, scope_store_id BIGINT, channels ARRAY<STRING>, active BOOLEAN",
    "notifications": "notification_id BIGINT, org_id BIGINT, rule_id BIGINT, user_id BIGINT, title STRING, body STRING, "
    "channel STRING, status STRING, dedup_key STRING, read_at TIMESTAMP, created_at TIMESTAMP",
    "organizations": "org_id BIGINT, name STRING",
    "memberships": "org_id BIGINT, user_id BIGINT, role STRING",
    "profiles": "user_id BIGINT, email STRING, full_name STRING",
    "pages": "page_id BIGINT, url STRING, html STRING, http_status INT",
    "shipments": "shipment_id BIGINT, org_id BIGINT, tracking_number STRING, display_name STRING, tracking_enabled BOOLEAN, "
    "current_status STRING, previous_status STRING, next_check_at TIMESTAMP, check_interval_override_minutes INT, "
    "delivered_at TIMESTAMP, last_checked_at TIMESTAMP, updated_at TIMESTAMP",
    "provider_checks": "check_id BIGINT, org_id BIGINT, shipment_id BIGINT, provider STRING, state STRING, status STRING, "
    "duration_ms DOUBLE, checked_at TIMESTAMP, excerpt STRING",
    "work_items": "id BIGINT, org_id BIGINT, type STRING, priority STRING, status STRING, dedupe_key STRING, "
    "payload STRING, scheduled_at TIMESTAMP, created_at TIMESTAMP",
    "settings": "org_id BIGINT, enabled BOOLEAN, max_concurrent_jobs INT, competitor_interval_minutes INT",
    "selector_versions": "version_id BIGINT, store_id BIGINT, selector_type STRING, version BIGINT, selector_value STRING, "
    "source STRING, confidence DOUBLE",
    "repair_attempts": "attempt_id BIGINT, org_id BIGINT, store_id BIGINT, listing_id BIGINT, run_id BIGINT, status STRING, "
    "created_at TIMESTAMP",
    "manual_sessions": "session_id BIGINT, org_id BIGINT, store_id BIGINT, url STRING, status STRING, created_at TIMESTAMP",
    "exports": "export_id BIGINT, org_id BIGINT, kind STRING, status STRING, created_at TIMESTAMP",
    "discovery_runs": "run_id BIGINT, org_id BIGINT, store_id BIGINT, status STRING, started_at TIMESTAMP, finished_at TIMESTAMP",
    "discovery_products": "product_id BIGINT, run_id BIGINT, store_id BIGINT, url STRING, normalized_url STRING, title STRING, "
    "price DECIMAL(12,2), currency STRING, availability STRING, image_url STRING, brand STRING, sku STRING, ean STRING, "
    "gtin STRING, category_path STRING, category_url STRING, breadcrumbs ARRAY<STRING>, confidence DOUBLE, source STRING, "
    "errors ARRAY<STRING>, created_at TIMESTAMP",
}

SCHEMAS = DDL  # readers take the DDL text as it is

# fixed vocabularies
AVAILABILITY = ["in_stock", "out_of_stock", "preorder", "limited", "unknown"]
CURRENCIES = ["EUR", "USD", "GBP", "UAH"]
CHANNELS = ["in_app", "email", "webhook"]
ALERT_TYPES = [
    "competitor_cheaper_than_me", "price_drop_pct", "price_rise_pct", "back_in_stock", "out_of_stock", "my_price_above_market_pct",
]
