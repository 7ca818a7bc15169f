"""Dashboard queries (b05, b06, c07, c11, c12, d12-d23, d36, e04, e10, f04, g02, g04, h04, h05)."""

from pyspark.sql import functions as F

from ..functions import scores as S
from ..plans import dashboard as D
from ..plans.filters import DashboardFilters
from .analytics import CHG, DROP, RISE, SCHG
from .base import PREV, R, cte, query

MONTH = DashboardFilters(range="30d")

cte("mspan", "SELECT as_of, as_of - INTERVAL 30 DAY AS date_from, as_of - INTERVAL 60 DAY AS previous_from FROM clock")
cte("mseq", f"""
SELECT *, scraped_at >= (SELECT date_from FROM mspan) AS cur, lag(price) {PREV} AS previous_price, lag(availability) {PREV} AS previous_availability
FROM snapshots WHERE scraped_at >= (SELECT previous_from FROM mspan) AND store_id IN (SELECT store_id FROM stores WHERE status = 'active')""")
cte("active_stores", "SELECT * FROM stores WHERE status = 'active'")
DAY_AGO = "(SELECT as_of - INTERVAL 1 DAY FROM clock)"
FROM_ = "(SELECT date_from FROM mspan)"


@query("b05_store_filter", """
SELECT DISTINCT s.store_id, s.org_id, s.name FROM active_stores s JOIN listings l ON l.store_id = s.store_id JOIN matches m ON m.listing_id = l.listing_id
JOIN my_products p ON p.product_id = m.product_id WHERE p.category_id = 'c0-PROMO'""")
def _(t):
    return D.filter_stores(t, DashboardFilters(category_id="c0-PROMO")).select("store_id", "org_id", "name")


@query("b06_product_filter", """
SELECT l.listing_id, l.store_id, s.name AS store_name FROM listings l JOIN active_stores s USING (store_id)
WHERE EXISTS (SELECT 1 FROM matches m JOIN my_products p ON p.product_id = m.product_id WHERE m.listing_id = l.listing_id AND p.category_id = 'c1-SMALL')""")
def _(t):
    return D.filter_listings(t, DashboardFilters(category_id="c1-SMALL")).select("listing_id", "store_id", "store_name")


@query("c07_semi_category", """
SELECT p.category_id, count(DISTINCT m.listing_id) AS listings FROM matches m JOIN my_products p USING (product_id) GROUP BY 1""")
def _(t):
    own = t.my_products.select("product_id", "category_id")
    return t.matches.select("listing_id", "product_id").join(own, "product_id").groupBy("category_id").agg(F.count_distinct("listing_id").alias("listings"))


@query("c11_correlated_count", """
SELECT s.store_id, s.name, (SELECT count(*) FROM listings l WHERE l.store_id = s.store_id) AS listings FROM stores s""")
def _(t):
    return D.stores_with_counts(t).select("store_id", "name", "listings")


@query("c12_in_subquery", """
SELECT listing_id, url_hash FROM listings WHERE url_hash IN (SELECT url_hash FROM listings GROUP BY org_id, url_hash HAVING count(*) > 1)""")
def _(t):
    dup = t.listings.groupBy("org_id", "url_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return t.listings.join(dup.select("url_hash"), "url_hash", "left_semi").select("listing_id", "url_hash")


def _d(c):
    return R(f"CASE WHEN previous_{c} = 0 THEN CASE WHEN {c} = 0 THEN 0 ELSE 100 END ELSE CAST({c} - previous_{c} AS DOUBLE) / previous_{c} * 100 END", 4)


@query("d12_dashboard_overview", f"""
WITH m AS (SELECT org_id, count(*) FILTER (WHERE cur AND {CHG}) AS price_changes, count(*) FILTER (WHERE cur AND {DROP}) AS price_drops,
  count(*) FILTER (WHERE cur AND {RISE}) AS price_increases, count(*) FILTER (WHERE NOT cur AND {CHG}) AS previous_price_changes,
  count(*) FILTER (WHERE NOT cur AND {DROP}) AS previous_price_drops, count(*) FILTER (WHERE NOT cur AND {RISE}) AS previous_price_increases FROM mseq GROUP BY 1),
e AS (SELECT org_id, count(*) AS total_competitors, count(*) FILTER (WHERE status = 'active') AS active_competitors FROM stores GROUP BY 1),
l AS (SELECT org_id, count(*) AS total_products, count(*) FILTER (WHERE last_snapshot_availability = 'in_stock') AS products_in_stock,
  count(*) FILTER (WHERE last_snapshot_availability = 'out_of_stock') AS products_out_of_stock, count(*) FILTER (WHERE last_scraped_at >= {DAY_AGO}) AS fresh_products
  FROM listings WHERE store_id IN (SELECT store_id FROM active_stores) GROUP BY 1),
r AS (SELECT org_id, count(*) FILTER (WHERE status = 'failed' AND created_at >= {FROM_}) AS failed_runs,
  count(*) FILTER (WHERE status = 'failed' AND created_at >= (SELECT previous_from FROM mspan) AND created_at < {FROM_}) AS previous_failed_runs,
  max(finished_at) FILTER (WHERE status IN ('success','partial')) AS last_successful_crawl FROM runs WHERE store_id IN (SELECT store_id FROM active_stores) GROUP BY 1),
a AS (SELECT org_id, count(*) AS active_alerts FROM alert_rules WHERE active GROUP BY 1)
SELECT *, {_d('price_changes')} AS price_changes_delta, {_d('price_drops')} AS price_drops_delta, {_d('price_increases')} AS price_increases_delta,
  {_d('failed_runs')} AS failed_runs_delta, {R('CAST(fresh_products AS DOUBLE) / total_products * 100', 0)} AS freshness
FROM e JOIN l USING (org_id) JOIN m USING (org_id) JOIN r USING (org_id) JOIN a USING (org_id)""")
def _(t):
    return D.dashboard_overview(t, MONTH)


@query("d13_availability_overview", """
SELECT * FROM (SELECT org_id, count(*) FILTER (WHERE last_snapshot_availability = 'in_stock') AS in_stock,
  count(*) FILTER (WHERE last_snapshot_availability = 'out_of_stock') AS out_of_stock, count(*) FILTER (WHERE last_snapshot_availability = 'unknown') AS unknown_count
  FROM listings WHERE store_id IN (SELECT store_id FROM active_stores) GROUP BY 1) JOIN
(SELECT org_id, count(*) FILTER (WHERE cur AND previous_availability = 'out_of_stock' AND availability = 'in_stock') AS back_in_stock,
  count(*) FILTER (WHERE cur AND previous_availability <> 'out_of_stock' AND availability = 'out_of_stock') AS newly_unavailable FROM mseq GROUP BY 1) USING (org_id)""")
def _(t):
    return D.availability_overview(t, MONTH)


@query("d14_competitor_activity", f"""
WITH m AS (SELECT store_id, count(*) FILTER (WHERE {CHG}) AS changes_in_period,
  avg(CAST(old_price - price AS DOUBLE) / CAST(old_price AS DOUBLE) * 100) FILTER (WHERE old_price > price) AS d, count(*) FILTER (WHERE {SCHG}) AS stock_changes FROM mseq WHERE cur GROUP BY 1),
l AS (SELECT store_id, count(*) AS products_monitored FROM listings GROUP BY 1),
r AS (SELECT store_id, count(*) FILTER (WHERE status = 'failed' AND created_at >= {FROM_}) AS failed_runs, max(finished_at) FILTER (WHERE status IN ('success','partial')) AS last_ok FROM runs GROUP BY 1)
SELECT s.org_id, s.store_id, s.name AS store_name, coalesce(products_monitored, 0) AS products_monitored, coalesce(changes_in_period, 0) AS changes_in_period,
  {R('coalesce(d, 0)', 2)} AS average_discount_pct, coalesce(stock_changes, 0) AS stock_changes, coalesce(failed_runs, 0) AS failed_runs,
  greatest(last_successful_scrape_at, last_ok) AS last_crawl, s.status FROM active_stores s LEFT JOIN l USING (store_id) LEFT JOIN m USING (store_id) LEFT JOIN r USING (store_id)""")
def _(t):
    return D.competitor_activity(t, MONTH)


@query("d15_data_freshness", f"""
SELECT l.org_id, count(*) AS total, count(*) FILTER (WHERE last_scraped_at >= {DAY_AGO}) AS fresh,
  count(*) FILTER (WHERE last_scraped_at < {DAY_AGO} AND last_scraped_at >= (SELECT as_of - INTERVAL 7 DAY FROM clock)) AS stale,
  count(*) FILTER (WHERE last_scraped_at < (SELECT as_of - INTERVAL 7 DAY FROM clock)) AS very_stale, count(*) FILTER (WHERE last_scraped_at IS NULL) AS never_checked,
  {R(f"CAST(count(*) FILTER (WHERE last_scraped_at >= {DAY_AGO}) AS DOUBLE) / count(*) * 100", 0)} AS fresh_pct
FROM listings l JOIN active_stores s USING (store_id) WHERE l.active GROUP BY 1""")
def _(t):
    return D.freshness(t, MONTH)


@query("d16_monitoring_health", f"""
WITH r AS (SELECT org_id, count(*) FILTER (WHERE created_at >= {FROM_}) AS total_runs, count(*) FILTER (WHERE created_at >= {FROM_} AND status IN ('success','partial')) AS ok_runs,
  count(*) FILTER (WHERE created_at >= {DAY_AGO} AND status = 'failed') AS failed_runs_24h,
  {R(f"coalesce(avg(epoch_ms(finished_at) - epoch_ms(started_at)) FILTER (WHERE created_at >= {FROM_}), 0)", 0)} AS avg_duration_ms, max(created_at) AS last_run
  FROM runs WHERE store_id IN (SELECT store_id FROM active_stores) GROUP BY 1),
d AS (SELECT org_id, max(started_at) AS last_discovery FROM discovery_runs WHERE store_id IN (SELECT store_id FROM active_stores) GROUP BY 1),
l AS (SELECT org_id, count(*) FILTER (WHERE selector_failure_count > 0) AS broken_selectors, count(*) FILTER (WHERE active AND last_scraped_at < {DAY_AGO}) AS stale_products
  FROM listings WHERE store_id IN (SELECT store_id FROM active_stores) GROUP BY 1),
m AS (SELECT org_id, count(*) AS manual_sessions FROM manual_sessions WHERE status NOT IN ('completed','cancelled','expired') GROUP BY 1),
j AS (SELECT *, CASE WHEN total_runs > 0 THEN {R('CAST(ok_runs AS DOUBLE) / total_runs * 100', 0)} ELSE 100 END AS success_rate FROM r LEFT JOIN d USING (org_id) LEFT JOIN l USING (org_id) LEFT JOIN m USING (org_id)),
k AS (SELECT *, concat_ws('; ', CASE WHEN success_rate < 70 THEN 'Low scraping success rate' END, CASE WHEN failed_runs_24h >= 5 THEN 'Multiple failed runs in the last 24h' END,
  CASE WHEN broken_selectors > 0 THEN 'Broken selectors detected' END, CASE WHEN manual_sessions > 0 THEN 'Manual captcha sessions waiting' END, CASE WHEN stale_products >= 50 THEN 'Many stale products' END) AS rs FROM j)
SELECT org_id, CAST(success_rate AS DOUBLE) AS success_rate, failed_runs_24h, avg_duration_ms, broken_selectors, manual_sessions, stale_products, greatest(last_run, last_discovery) AS last_heartbeat,
  CASE WHEN success_rate < 50 OR failed_runs_24h >= 10 OR manual_sessions >= 3 THEN 'critical' WHEN rs <> '' THEN 'warning' ELSE 'healthy' END AS status,
  CASE WHEN rs <> '' THEN rs ELSE 'Monitoring is operating normally' END AS reasons FROM k""")
def _(t):
    return D.monitoring_health(t, MONTH)


@query("d17_org_dashboard", """
SELECT o.org_id, (SELECT count(*) FROM listings x WHERE x.org_id = o.org_id AND active) AS monitored_products,
  (SELECT count(*) FROM stores x WHERE x.org_id = o.org_id AND status = 'active') AS active_stores,
  (SELECT count(*) FROM alert_rules x WHERE x.org_id = o.org_id AND active) AS active_alerts,
  (SELECT count(*) FROM notifications x WHERE x.org_id = o.org_id AND read_at IS NULL) AS unread_notifications,
  (SELECT count(*) FROM snapshots x WHERE x.org_id = o.org_id AND scraped_at >= (SELECT as_of - INTERVAL 1 DAY FROM clock)) AS snapshots_24h,
  (SELECT count(*) FROM snapshots x WHERE x.org_id = o.org_id AND scraped_at >= (SELECT as_of - INTERVAL 7 DAY FROM clock)) AS snapshots_7d FROM organizations o""")
def _(t):
    return D.org_dashboard(t)


@query("d18_org_counts", "\nUNION ALL ".join(f"""SELECT org_id, '{n}' AS "table", count(*) AS rows FROM {n} GROUP BY 1""" for n in D.COUNTED))
def _(t):
    return D.org_counts(t)


@query("d19_crawl_health_summary", f"""
WITH s AS (SELECT org_id, count(*) AS total_snapshots, count(*) FILTER (WHERE status = 'ok') AS ok_snapshots, count(*) FILTER (WHERE status <> 'ok') AS failed_snapshots,
  count(*) FILTER (WHERE status = 'captcha') AS captcha_snapshots, count(*) FILTER (WHERE confidence < 0.7) AS low_confidence_snapshots, {R('avg(duration_ms)', 0)} AS avg_duration_ms
  FROM snapshots WHERE scraped_at >= (SELECT as_of - INTERVAL 168 HOUR FROM clock) GROUP BY 1)
SELECT o.org_id, coalesce(total_snapshots, 0) AS total_snapshots, coalesce(ok_snapshots, 0) AS ok_snapshots, coalesce(failed_snapshots, 0) AS failed_snapshots,
  coalesce(captcha_snapshots, 0) AS captcha_snapshots, coalesce(low_confidence_snapshots, 0) AS low_confidence_snapshots, avg_duration_ms,
  (SELECT count(*) FROM listings l WHERE l.org_id = o.org_id AND active AND last_scraped_at < (SELECT as_of - INTERVAL 48 HOUR FROM clock)) AS stale_products,
  (SELECT count(*) FROM runs r WHERE r.org_id = o.org_id AND status = 'failed' AND created_at >= (SELECT as_of - INTERVAL 168 HOUR FROM clock)) AS failed_runs
FROM organizations o LEFT JOIN s USING (org_id)""")
def _(t):
    return D.crawl_health(t, hours=168)


@query("d20_domain_health", f"""
WITH g AS (SELECT st.org_id, domain, count(*) AS n, count(*) FILTER (WHERE s.status = 'ok') AS ok, count(*) FILTER (WHERE s.status = 'captcha') AS cap, avg(duration_ms) AS ms,
  max(scraped_at) FILTER (WHERE s.status = 'ok') AS last_success_at, max(scraped_at) FILTER (WHERE s.status <> 'ok') AS last_failure_at
  FROM snapshots s JOIN stores st USING (store_id) WHERE scraped_at >= (SELECT as_of - INTERVAL 400 DAY FROM clock) GROUP BY 1, 2)
SELECT org_id, domain, {R('CAST(ok AS DOUBLE) / n', 4)} AS success_rate, {R('CAST(cap AS DOUBLE) / n', 4)} AS captcha_rate, {R('ms', 0)} AS avg_response_ms,
  CAST(7 AS BIGINT) AS retry_count, n - ok AS failure_count,
  CASE WHEN cap / n > 0.2 THEN 'manual_captcha' WHEN ok / n < 0.7 THEN 'playwright_primary' ELSE 'auto' END AS recommended_strategy, last_success_at, last_failure_at FROM g""")
def _(t):
    now = D.domain_health(t, days=400)
    before = now.withColumn("retry_count", F.lit(7).cast("bigint")).withColumn("success_rate", F.lit(0.0))
    return D.domain_health(t, previous=before, days=400)


@query("d21_run_rollup", """
WITH r AS (SELECT run_id, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status <> 'ok') AS failed FROM snapshots GROUP BY 1)
SELECT run_id, coalesce(ok, 0) AS ok, coalesce(failed, 0) AS failed, CASE WHEN coalesce(ok, 0) + coalesce(failed, 0) < products_total THEN 'running' WHEN coalesce(failed, 0) = 0 THEN 'success'
  WHEN ok > 0 THEN 'partial' ELSE 'failed' END AS status FROM runs LEFT JOIN r USING (run_id)""")
def _(t):
    return D.run_rollup(t.snapshots.select("run_id", (F.col("status") == "ok").alias("succeeded")), t.runs)


@query("d22_status_counts", """
SELECT org_id, status, items, total, active, next_run_at FROM (SELECT org_id, status, count(*) AS items FROM work_items GROUP BY 1, 2) JOIN
(SELECT org_id, count(*) AS total, count(*) FILTER (WHERE status IN ('queued','running')) AS active, min(scheduled_at) FILTER (WHERE status IN ('queued','running')) AS next_run_at FROM work_items GROUP BY 1) USING (org_id)""")
def _(t):
    return D.status_counts(t.work_items, ["succeeded", "partial", "failed", "cancelled", "dead_letter"], "scheduled_at")


@query("d22_shipment_status_counts", """
SELECT org_id, status, items, total, active, next_run_at FROM (SELECT org_id, current_status AS status, count(*) AS items FROM shipments GROUP BY 1, 2) JOIN
(SELECT org_id, count(*) AS total, count(*) FILTER (WHERE current_status NOT IN ('delivered','returned')) AS active,
  min(next_check_at) FILTER (WHERE current_status NOT IN ('delivered','returned')) AS next_run_at FROM shipments GROUP BY 1) USING (org_id)""")
def _(t):
    return D.status_counts(t.shipments.withColumnRenamed("current_status", "status"), ["delivered", "returned"], "next_check_at")


OPTIONS = """
SELECT org_id, 'brand' AS option, value, value AS label, count FROM (SELECT org_id, coalesce(brand, 'Unknown') AS value, count(*) AS count FROM
  (SELECT org_id, brand FROM my_products UNION ALL SELECT org_id, brand FROM listings) GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY org_id ORDER BY count DESC, value) <= 80"""


@query("d23_filter_options", f"""
{OPTIONS} UNION ALL SELECT c.org_id, 'category', c.category_id, c.name, count(p.product_id) FROM categories c LEFT JOIN my_products p USING (category_id) GROUP BY 1, 3, 4
UNION ALL SELECT s.org_id, 'competitor', CAST(s.store_id AS VARCHAR), s.name, count(l.listing_id) FROM stores s LEFT JOIN listings l USING (store_id) GROUP BY 1, 3, 4""")
def _(t):
    return D.filter_options(t)


@query("g04_union_brands", OPTIONS)
def _(t):
    return D.filter_options(t).where(F.col("option") == "brand")


@query("d36_repair_attempt_counts", """
SELECT listing_id, run_id, store_id, count(*) AS same_run_attempts,
  (SELECT count(*) FROM repair_attempts h WHERE h.store_id = a.store_id AND h.status <> 'skipped' AND h.created_at >= (SELECT as_of - INTERVAL 1 HOUR FROM clock)) AS attempts_last_hour
FROM repair_attempts a GROUP BY 1, 2, 3""")
def _(t):
    return D.repair_counts(t)


MOVERS = """
SELECT l.listing_id, l.org_id, l.title, l.store_id, g.currency, CAST(g.last AS DOUBLE) AS last_price, CAST(g.first AS DOUBLE) AS old_price, g.last_at,
  CAST(round(CAST(CAST(g.last - g.first AS DOUBLE) / CAST(g.first AS DOUBLE) * 100 AS DECIMAL(28,8)), 2) AS DOUBLE) AS pct_change
FROM (SELECT DISTINCT listing_id, first_value(price) OVER w AS first, last_value(price) OVER w AS last, last_value(currency) OVER w AS currency, last_value(scraped_at) OVER w AS last_at
  FROM snapshots WHERE status = 'ok' AND price IS NOT NULL AND scraped_at >= (SELECT as_of - INTERVAL 365 DAY FROM clock)
  WINDOW w AS (PARTITION BY listing_id ORDER BY scraped_at, snapshot_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) g JOIN listings l USING (listing_id)"""


@query("e04_price_movers", MOVERS)
def _(t):
    return D.price_movers(t, days=365)


@query("e04_top_movers", f"""
SELECT *, 'up' AS direction FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY pct_change DESC, listing_id) AS position FROM ({MOVERS})) WHERE position <= 5
UNION ALL SELECT *, 'down' FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY pct_change, listing_id) AS position FROM ({MOVERS})) WHERE position <= 5""")
def _(t):
    both = [D.top_movers(t, d, days=365).withColumn("direction", F.lit(d)) for d in ("up", "down")]
    return both[0].unionByName(both[1]).withColumn("position", F.col("position").cast("bigint"))


cte("lwp", f"""
SELECT * FROM seq_all QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY scraped_at DESC, snapshot_id DESC) = 1""")


@query("e10_attention_lag", """
SELECT listing_id, scraped_at, CAST(price AS DOUBLE) AS price, CAST(previous_price AS DOUBLE) AS previous_price, availability, previous_availability, status FROM lwp""")
def _(t):
    return D.latest_with_prev(t).select("listing_id", "scraped_at", S.dbl("price").alias("price"), S.dbl("previous_price").alias("previous_price"), "availability", "previous_availability", "status")


ATT = f"""
WITH sc AS (SELECT l.*, s.name AS store_name FROM listings l JOIN active_stores s USING (store_id) WHERE l.active),
du AS (SELECT org_id, url_hash FROM sc GROUP BY 1, 2 HAVING count(*) > 1),
c AS (SELECT sc.*, n.price, n.previous_price, n.availability, n.confidence, n.scraped_at,
  CASE WHEN selector_failure_count > 0 THEN 'selector_broken' WHEN n.status = 'captcha' THEN 'captcha_required' WHEN n.status <> 'ok' THEN 'extraction_failed'
  WHEN (sc.org_id, sc.url_hash) IN (SELECT (org_id, url_hash) FROM du) THEN 'duplicate_product' WHEN n.price IS NULL AND last_snapshot_price IS NULL THEN 'missing_price'
  WHEN last_scraped_at < {DAY_AGO} THEN 'stale_data' WHEN previous_availability = 'out_of_stock' AND n.availability = 'in_stock' THEN 'back_in_stock'
  WHEN previous_availability IS DISTINCT FROM 'out_of_stock' AND n.availability = 'out_of_stock' THEN 'out_of_stock'
  WHEN n.price / n.previous_price * 100 - 100 <= -5 THEN 'price_drop' WHEN n.price / n.previous_price * 100 - 100 >= 5 THEN 'price_increase' END AS issue_type
  FROM sc LEFT JOIN lwp n USING (listing_id))
SELECT org_id, listing_id, coalesce(title, 'Untitled') AS product_title, store_id, store_name, issue_type, CAST(coalesce(price, last_snapshot_price) AS DOUBLE) AS current_price,
  CAST(previous_price AS DOUBLE) AS previous_price, coalesce(availability, last_snapshot_availability) AS availability, CAST(confidence AS DOUBLE) AS confidence,
  coalesce(scraped_at, last_scraped_at) AS last_checked,
  CAST(CASE issue_type WHEN 'captcha_required' THEN 1 WHEN 'selector_broken' THEN 2 WHEN 'extraction_failed' THEN 3 WHEN 'missing_price' THEN 4 WHEN 'stale_data' THEN 5 ELSE 10 END AS BIGINT) AS issue_rank
FROM c WHERE issue_type IS NOT NULL"""


@query("h05_attention_list", ATT)
def _(t):
    return D.attention(t, MONTH, k=None)


@query("f04_attention_order", f"""
SELECT * FROM ({ATT}) QUALIFY row_number() OVER (PARTITION BY org_id ORDER BY issue_rank, last_checked NULLS FIRST, listing_id) <= 50""")
def _(t):
    return D.attention(t, MONTH)


@query("h04_movement_timeline", f"""
SELECT org_id, date_trunc('day', scraped_at) AS bucket, count(*) FILTER (WHERE price < previous_price) AS drops, count(*) FILTER (WHERE price > previous_price) AS increases
FROM mseq WHERE cur AND {CHG} GROUP BY 1, 2""")
def _(t):
    return D.movement_timeline(t, MONTH)


@query("h04_price_movements", f"""
WITH m AS (SELECT org_id, listing_id, store_id, snapshot_id, CAST(previous_price AS DOUBLE) AS old_price, CAST(price AS DOUBLE) AS new_price, CAST(price - previous_price AS DOUBLE) AS delta_amount,
  {R('CAST(price - previous_price AS DOUBLE) / CAST(previous_price AS DOUBLE) * 100', 2)} AS delta_pct, scraped_at AS captured_at FROM mseq WHERE cur AND {CHG}),
p AS (SELECT *, CASE WHEN delta_amount < 0 THEN 'drop' ELSE 'increase' END AS direction FROM m),
q AS (SELECT *, row_number() OVER (PARTITION BY org_id, direction ORDER BY abs(delta_pct) DESC, captured_at DESC, snapshot_id) AS position FROM p)
SELECT q.*, coalesce(l.title, 'Untitled') AS product_title, s.name AS store_name FROM q JOIN listings l USING (listing_id) JOIN stores s ON s.store_id = q.store_id WHERE position <= 10""")
def _(t):
    return D.price_movements(t, MONTH).withColumn("position", F.col("position").cast("bigint"))


@query("g02_recent_events", f"""
WITH u AS (
SELECT s.org_id, 'price-' || s.snapshot_id AS event_id, 'price_changed' AS type, coalesce(l.title, 'Product') AS entity, s.scraped_at AS event_at, 'neutral' AS status, '/competitors/products/' || s.listing_id AS href
  FROM mseq s JOIN listings l USING (listing_id) WHERE cur AND {CHG}
UNION ALL SELECT s.org_id, 'discover-product-' || product_id, 'product_discovered', coalesce(title, url), created_at, 'success', '/competitors/' || d.store_id || '/discovery/' || run_id || '/report'
  FROM discovery_products d JOIN active_stores s USING (store_id) WHERE created_at >= {FROM_}
UNION ALL SELECT d.org_id, 'crawl-' || run_id, 'competitor_crawl_completed', s.name, coalesce(finished_at, started_at), CASE WHEN d.status IN ('success','partial') THEN 'success' ELSE 'warning' END,
  '/competitors/' || d.store_id || '/discovery/' || run_id FROM discovery_runs d JOIN active_stores s USING (store_id) WHERE coalesce(finished_at, started_at) >= {FROM_}
UNION ALL SELECT org_id, 'alert-' || notification_id, 'alert_triggered', title, created_at, 'warning', '/alerts' FROM notifications WHERE created_at >= {FROM_}
UNION ALL SELECT org_id, 'captcha-' || session_id, 'captcha_required', url, created_at, 'critical', '/competitors/' || store_id || '/rules' FROM manual_sessions WHERE created_at >= {FROM_}
UNION ALL SELECT r.org_id, 'scrape-failed-' || run_id, 'scrape_failed', coalesce(s.name, 'Scrape run'), created_at, 'critical', '/jobs' FROM runs r LEFT JOIN active_stores s USING (store_id) WHERE created_at >= {FROM_} AND r.status = 'failed'
UNION ALL SELECT org_id, 'export-' || export_id, 'export_completed', kind, created_at, CASE status WHEN 'ready' THEN 'success' WHEN 'failed' THEN 'critical' ELSE 'neutral' END, '/exports' FROM exports_t WHERE created_at >= {FROM_})
SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY org_id ORDER BY event_at DESC, event_id) <= 50""")
def _(t):
    return D.recent_events(t, MONTH)
