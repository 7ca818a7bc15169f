"""Registry of queries and the DuckDB statements they are checked against.

A statement may use the names of the common table expressions in ``CTES``; only those it needs
(directly or through another one) are put in front of it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from ..sources.catalog import Tables
from ..sources.testdata import bound


@dataclass
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}
CTES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(name)
        REGISTRY[name] = Query(name, build, sql)
        return build

    return register


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return REGISTRY[name].build(bound(configure(spark), sf_dir))


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def oracle(sql: str) -> str:
    order: list[str] = []
    seen: set[str] = set()

    def resolve(text: str) -> None:
        for name in CTES:
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                resolve(CTES[name])
                order.append(name)

    resolve(sql)
    body = sql.strip()
    if not order:
        return body
    head = ",\n".join(f"{n} AS (\n{CTES[n]}\n)" for n in order)
    if re.match(r"(?i)with\s+recursive\b", body):
        return f"WITH RECURSIVE {head},\n{re.split(r'(?i)with\s+recursive', body, maxsplit=1)[1].lstrip()}"
    if re.match(r"(?i)with\b", body):
        return f"WITH {head},\n{body[4:].lstrip()}"
    return f"WITH {head}\n{body}"


def R(expr: str, digits: int) -> str:
    """Half-up rounding to a double."""
    return f"CAST(round(CAST({expr} AS DECIMAL(28,8)), {digits}) AS DOUBLE)"


def AVG(expr: str, digits: int = 2) -> str:
    return R(f"CAST(sum({expr}) AS DOUBLE) / count({expr})", digits)


def MED(expr: str, digits: int = 2) -> str:
    return R(f"quantile_cont(CAST({expr} AS DOUBLE), 0.5)", digits)


DISC0 = "(CASE WHEN old_price > price THEN CAST(old_price - price AS DOUBLE) / CAST(old_price AS DOUBLE) * 100 ELSE 0 END)"
PREV = "OVER (PARTITION BY listing_id ORDER BY scraped_at, snapshot_id)"

# ---------------------------------------------------------------------------------------------- domain tables

cte("clock", "SELECT max(l_shipdate) + INTERVAL 1 DAY AS as_of FROM lineitem")
cte("stores", """
SELECT DISTINCT s_suppkey % 5 AS store_id, CAST(CASE WHEN s_suppkey % 5 < 3 THEN 0 ELSE 1 END AS BIGINT) AS org_id,
  'STORE_' || (s_suppkey % 5) AS name, 'store' || (s_suppkey % 5) || '.example' AS domain, 'EUR' AS currency,
  CASE WHEN s_suppkey % 5 = 4 THEN 'paused' ELSE 'active' END AS status,
  ['shopify','woocommerce','magento','custom','tilda'][s_suppkey % 5 + 1] AS framework,
  (SELECT as_of FROM clock) - INTERVAL 2 DAY AS last_successful_scrape_at
FROM supplier""")
cte("snapshots", """
SELECT ((l_orderkey * 8 + l_linenumber) * 64 + CAST(l_quantity AS BIGINT)) * 20000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS snapshot_id,
  CAST(CASE WHEN l_suppkey % 5 < 3 THEN 0 ELSE 1 END AS BIGINT) AS org_id, l_partkey * 5 + l_suppkey % 5 AS listing_id, l_suppkey % 5 AS store_id,
  l_shipdate AS scraped_at,
  CASE WHEN l_quantity > 3 THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(12,2)) END AS price,
  CASE WHEN l_quantity > 3 AND l_discount >= 0.05 THEN CAST(l_extendedprice AS DECIMAL(12,2)) END AS old_price,
  'EUR' AS currency, CASE l_returnflag WHEN 'N' THEN 'in_stock' WHEN 'R' THEN 'out_of_stock' ELSE 'unknown' END AS availability,
  CASE WHEN l_linenumber % 3 = 0 THEN '/img/' || (l_partkey * 5 + l_suppkey % 5) || '.jpg' END AS image_url,
  CASE l_quantity WHEN 1 THEN 'captcha' WHEN 2 THEN 'blocked' WHEN 3 THEN 'parse_failed' ELSE 'ok' END AS status,
  CAST(1 - 5 * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(3,2)) AS confidence,
  CASE WHEN l_linestatus = 'O' THEN 'playwright' ELSE 'cheerio' END AS source,
  CAST(l_linenumber * 100 + l_quantity AS BIGINT) AS duration_ms, l_orderkey AS run_id
FROM lineitem""")
cte("newest", f"""
SELECT * FROM snapshots QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY scraped_at DESC, snapshot_id DESC) = 1""")
cte("listings", """
SELECT s.listing_id, s.org_id, s.store_id, s.listing_id // 5 AS part_id,
  'https://store' || s.store_id || '.example/p/' || (CASE WHEN s.listing_id // 5 % 40 = 39 THEN s.listing_id // 5 - 1 ELSE s.listing_id // 5 END) AS url,
  sha256(lower(trim('https://store' || s.store_id || '.example/p/' || (CASE WHEN s.listing_id // 5 % 40 = 39 THEN s.listing_id // 5 - 1 ELSE s.listing_id // 5 END)))) AS url_hash,
  CASE WHEN s.listing_id // 5 % 97 <> 96 THEN p_name END AS title, p_brand AS brand, 'SKU' || (s.listing_id // 5) AS sku,
  CASE WHEN s.listing_id // 5 % 2 = 0 THEN 'G' || (s.listing_id // 5) END AS gtin,
  CASE WHEN s.listing_id // 5 % 4 <> 0 THEN '/img/' || s.listing_id || '.jpg' END AS image_url,
  s.listing_id // 5 % 25 <> 24 AS active, h.last_scraped_at, h.last_change_at,
  h.last_scraped_at + to_days(CAST(s.listing_id % 3 + 1 AS INTEGER)) AS next_run_at,
  CASE WHEN s.status = 'parse_failed' THEN 1 ELSE 0 END AS selector_failure_count,
  s.price AS last_snapshot_price, s.currency AS last_snapshot_currency, s.availability AS last_snapshot_availability, h.created_at
FROM newest s JOIN (SELECT listing_id, min(scraped_at) AS created_at, max(scraped_at) AS last_scraped_at,
  max(scraped_at) FILTER (WHERE status = 'ok') AS last_change_at FROM snapshots GROUP BY 1) h USING (listing_id)
LEFT JOIN part ON p_partkey = s.listing_id // 5""")
cte("my_products", """
SELECT p_partkey * 2 + o AS product_id, CAST(o AS BIGINT) AS org_id, p_partkey AS part_id, 'SKU' || p_partkey AS sku,
  CASE WHEN p_partkey % 2 = 0 THEN 'G' || p_partkey END AS gtin, p_brand AS brand, p_name AS name, 'c' || o || '-' || p_type AS category_id,
  CAST(p_retailprice AS DECIMAL(12,2)) AS my_price, 'EUR' AS currency, 'https://own.example/' || p_partkey AS url,
  TIMESTAMP '1995-01-01' AS created_at, TIMESTAMP '1995-01-01' AS updated_at
FROM part CROSS JOIN (VALUES (0), (1)) x(o)""")
cte("matches", """
SELECT listing_id AS match_id, org_id, (listing_id // 5) * 2 + org_id AS product_id, listing_id,
  CASE WHEN listing_id // 5 % 2 = 0 THEN 'gtin' ELSE 'sku' END AS method,
  CAST(CASE WHEN listing_id // 5 % 2 = 0 THEN 0.99 ELSE 0.95 END AS DECIMAL(4,3)) AS confidence,
  CASE WHEN listing_id // 5 % 10 <= 6 THEN 'confirmed' WHEN listing_id // 5 % 10 = 7 THEN 'suggested' ELSE 'rejected' END AS status,
  CASE WHEN listing_id // 5 % 10 <> 7 THEN created_at + INTERVAL 1 DAY END AS decided_at, created_at
FROM listings WHERE listing_id // 5 % 10 < 9""")
cte("confirmed", "SELECT * FROM matches WHERE status = 'confirmed'")
cte("categories", """
SELECT DISTINCT 'c' || o || '-' || p_type AS category_id, CAST(o AS BIGINT) AS org_id, p_type AS name FROM part CROSS JOIN (VALUES (0), (1)) x(o)""")
cte("runs", """
SELECT o_orderkey AS run_id, CAST(CASE WHEN o_custkey % 5 < 3 THEN 0 ELSE 1 END AS BIGINT) AS org_id, o_custkey % 5 AS store_id,
  CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'partial' ELSE 'failed' END AS status,
  o_orderdate + INTERVAL 95 DAY + INTERVAL 1 MINUTE AS started_at,
  CASE WHEN o_orderstatus <> 'P' OR o_orderkey % 4 <> 0 THEN o_orderdate + INTERVAL 95 DAY + to_minutes(o_orderkey % 30 + 2) END AS finished_at,
  o_orderkey % 20 + 1 AS products_total, o_orderdate + INTERVAL 95 DAY AS created_at
FROM orders""")
cte("organizations", "SELECT DISTINCT org_id, 'ORG_' || org_id AS name FROM stores")
cte("memberships", """
SELECT c_custkey % 2 AS org_id, c_custkey AS user_id, ['owner','manager','viewer'][c_nationkey % 3 + 1] AS role FROM customer
UNION ALL SELECT (c_custkey + 1) % 2, c_custkey, ['owner','manager','viewer'][c_nationkey % 3 + 1] FROM customer WHERE c_custkey % 10 = 0""")
cte("profiles", "SELECT c_custkey AS user_id, 'u' || c_custkey || '@example.org' AS email, c_name AS full_name FROM customer")
cte("alert_rules", """
SELECT s_suppkey AS rule_id, CAST(CASE WHEN s_suppkey % 5 < 3 THEN 0 ELSE 1 END AS BIGINT) AS org_id, 'rule ' || s_suppkey AS name,
  ['competitor_cheaper_than_me','price_drop_pct','price_rise_pct','back_in_stock','out_of_stock','my_price_above_market_pct'][s_suppkey % 6 + 1] AS type,
  CASE WHEN s_suppkey % 4 <> 0 THEN 5.0 + s_nationkey END AS threshold_pct, CASE WHEN s_suppkey % 4 = 0 THEN 3.0 + s_nationkey END AS price_pct,
  CASE WHEN s_suppkey % 7 = 3 THEN s_suppkey * 2 + (CASE WHEN s_suppkey % 5 < 3 THEN 0 ELSE 1 END) END AS scope_product_id,
  CASE WHEN s_suppkey % 7 = 4 THEN s_suppkey * 5 + s_suppkey % 5 END AS scope_listing_id,
  CASE WHEN s_suppkey % 7 < 3 THEN s_suppkey % 5 END AS scope_store_id, s_suppkey % 2 = 0 AS by_email, s_suppkey % 11 <> 10 AS active
FROM supplier""")
cte("notifications", """
SELECT o_orderkey AS notification_id, o_custkey % 2 AS org_id, o_orderkey % 100 AS rule_id, o_custkey AS user_id, 'Notice ' || o_orderpriority AS title,
  CASE WHEN o_orderstatus = 'O' THEN o_orderdate + INTERVAL 95 DAY + INTERVAL 1 DAY END AS read_at, o_orderdate + INTERVAL 95 DAY AS created_at
FROM orders""")
cte("provider_checks", """
SELECT event_id AS check_id, user_id % 2 AS org_id, user_id AS shipment_id,
  ['ups','postal_ninja','parcelsapp','ship24','17track','yanwen'][event_id % 6 + 1] AS provider,
  CASE WHEN event_type IN ('purchase','click') THEN 'success' WHEN event_type = 'signup' THEN 'captcha' WHEN event_type = 'view' THEN 'not_found' ELSE 'failed' END AS state,
  CASE WHEN event_type IN ('purchase','click') THEN ['registered','in_transit','customs','out_for_delivery','delivered','exception','returned','info_received'][CAST(json_extract_string(props, '$.k') AS INTEGER) % 8 + 1] END AS status,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value AS duration_ms, ts AS checked_at, event_type
FROM events""")
cte("shipments", """
SELECT user_id AS shipment_id, user_id % 2 AS org_id, '1Z' || lpad(CAST(user_id AS VARCHAR), 16, '0') AS tracking_number, user_id % 9 <> 8 AS tracking_enabled,
  ['in_transit','customs','out_for_delivery','delivered','exception','returned','info_received','pending'][user_id % 8 + 1] AS current_status,
  min(ts) + to_hours(user_id % 48) AS next_check_at, CASE WHEN user_id % 6 = 0 THEN user_id % 30 * 60 END AS check_interval_override_minutes, min(ts) AS first_ts
FROM events GROUP BY user_id""")
cte("work_items", """
SELECT o_orderkey AS id, o_custkey % 2 AS org_id, CASE WHEN o_orderkey % 3 = 0 THEN 'competitor_scrape' ELSE 'shipment_tracking' END AS type,
  CASE o_orderpriority[1] WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '5' THEN 'low' ELSE 'normal' END AS priority,
  ['queued','running','succeeded','partial','failed','cancelled','dead_letter'][o_orderkey % 7 + 1] AS status,
  CASE WHEN o_orderkey % 5 <> 0 THEN 'shipment:' || o_custkey END AS dedupe_key,
  CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_custkey % 500 AS VARCHAR) END AS payload_shipment,
  o_orderdate + INTERVAL 95 DAY + to_hours(o_orderkey % 48) AS scheduled_at, o_orderdate + INTERVAL 95 DAY AS created_at
FROM orders""")
cte("selector_versions", """
SELECT p_partkey AS version_id, p_partkey % 5 AS store_id,
  ['titleSelector','priceSelector','oldPriceSelector','availabilitySelector','imageSelector'][p_size % 5 + 1] AS selector_type,
  p_partkey + 1 AS version, '.' || replace(p_name, ' ', '-') AS selector_value FROM part""")
cte("repair_attempts", """
SELECT snapshot_id AS attempt_id, org_id, store_id, listing_id, run_id, ['applied','failed','skipped'][run_id % 3 + 1] AS status, scraped_at AS created_at
FROM snapshots WHERE status = 'parse_failed'""")
cte("manual_sessions", """
SELECT snapshot_id AS session_id, org_id, store_id, 'https://store' || store_id || '.example/p/' || (listing_id // 5) AS url,
  ['waiting_for_manual_action','browser_opened','paused','completed','cancelled','expired'][run_id % 6 + 1] AS status, scraped_at AS created_at
FROM snapshots WHERE status = 'captcha'""")
cte("exports_t", """
SELECT c_custkey AS export_id, c_custkey % 2 AS org_id, ['snapshots_csv','products_csv','matches_csv','analytics_xlsx'][c_custkey % 4 + 1] AS kind,
  ['ready','failed','queued'][c_custkey % 3 + 1] AS status, (SELECT as_of FROM clock) - to_days(CAST(c_custkey % 60 AS INTEGER)) AS created_at FROM customer""")
cte("discovery_runs", """
SELECT o_orderkey AS run_id, CAST(CASE WHEN o_custkey % 5 < 3 THEN 0 ELSE 1 END AS BIGINT) AS org_id, o_custkey % 5 AS store_id,
  CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'partial' ELSE 'failed' END AS status, o_orderdate + INTERVAL 95 DAY AS started_at,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL 95 DAY + to_minutes(o_orderkey % 90) END AS finished_at
FROM orders""")
cte("discovery_products", """
SELECT listing_id AS product_id, part_id AS run_id, store_id, url, 'https://store' || store_id || '.example/p/' || part_id AS normalized_url, title,
  last_snapshot_price AS price, last_snapshot_availability AS availability, image_url, brand,
  CASE WHEN store_id IN (0, 1, 3) THEN sku END AS sku, CASE WHEN store_id IN (1, 4) THEN 'E' || part_id END AS ean,
  CASE WHEN store_id IN (2, 3, 4) THEN gtin END AS gtin, 'shop / ' || coalesce(brand, 'none') AS category_path,
  'https://store' || store_id || '.example/shop/' || lower(replace(brand, '#', '')) AS category_url,
  CASE WHEN last_snapshot_price IS NULL THEN 0.5 ELSE 0.8 END AS confidence, last_scraped_at AS created_at, part_id
FROM listings""")
cte("discovery_pages", """
SELECT page_id, page_id AS run_id, url, ['crawled','crawled','crawled','queued','error'][page_id % 5 + 1] AS status FROM pages""")
cte("discovery_logs", """
SELECT run_id, CASE WHEN status = 'captcha' THEN 'warn' ELSE 'error' END AS level FROM snapshots WHERE status <> 'ok'""")
cte("tracking_pages", """
SELECT doc_id AS page_id, ['ups','postal_ninja','parcelsapp','ship24','17track','yanwen'][doc_id % 6 + 1] AS provider,
  '1Z' || lpad(CAST(doc_id AS VARCHAR), 16, '0') AS tracking_number,
  text || chr(10) || chr(10) || CASE WHEN doc_id % 13 = 12 THEN 'no number' ELSE lower('1Z' || lpad(CAST(doc_id AS VARCHAR), 16, '0')) END || chr(10)
  || ph[doc_id % 12 + 1] || chr(10) || ph[(doc_id + 5) % 7 + 1] AS text
FROM documents CROSS JOIN (SELECT ['Delivered','Return to sender','Out for delivery','Held by customs','Delivery failed','In transit','Label created',
  'Tracking number not found','Please verify you are human','Access denied','Upgrade your plan','nothing here'] AS ph) x""")
