"""Analytics-centre queries (b01-b04, b10, c01-c03, d01-d11, e01-e07, f02-f05, g01, h03, h09, h10)."""

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import ordered
from ..plans import analytics as A
from ..plans import scope as SC
from ..plans.filters import Filters, resolve_dashboard_range, resolve_range, time_bucket
from .base import AVG, DISC0, MED, PREV, R, cte, query

ALL, YEAR = Filters(range="all"), Filters(range="1y")

cte("dims", """
SELECT l.listing_id, l.org_id, l.store_id, l.title, l.url, l.brand, l.image_url, l.last_scraped_at, s.name AS store_name, m.match_id, m.product_id,
  p.name AS product_name, p.brand AS product_brand, p.category_id, c.name AS category_name
FROM listings l JOIN stores s USING (store_id) LEFT JOIN confirmed m ON m.listing_id = l.listing_id
LEFT JOIN my_products p ON p.product_id = m.product_id LEFT JOIN categories c ON c.category_id = p.category_id""")
cte("latest_scope", """
SELECT d.*, n.price, n.old_price, n.currency, n.availability, n.confidence, n.status AS snapshot_status, n.scraped_at
FROM dims d JOIN newest n USING (listing_id)""")
cte("seq_all", f"""
SELECT *, lag(price) {PREV} AS previous_price, lag(availability) {PREV} AS previous_availability FROM snapshots""")
cte("span", """
SELECT as_of, as_of - INTERVAL 365 DAY AS date_from, as_of - INTERVAL 730 DAY AS previous_from FROM clock""")
cte("seq_cur", f"""
SELECT *, lag(price) {PREV} AS previous_price, lag(availability) {PREV} AS previous_availability
FROM snapshots WHERE scraped_at >= (SELECT date_from FROM span)""")
cte("seq_prev", f"""
SELECT *, lag(price) {PREV} AS previous_price, lag(availability) {PREV} AS previous_availability
FROM snapshots WHERE scraped_at >= (SELECT previous_from FROM span) AND scraped_at < (SELECT date_from FROM span)""")

CHG = "previous_price IS NOT NULL AND price <> previous_price"
DROP = "previous_price IS NOT NULL AND price < previous_price"
RISE = "previous_price IS NOT NULL AND price > previous_price"
SCHG = "previous_availability <> availability"
KEY = "coalesce('p' || product_id, 'l' || listing_id)"


@query("b01_range_window", """
SELECT x.name AS range, CAST(count(*) FILTER (WHERE scraped_at >= as_of - to_days(x.days)) AS BIGINT) AS in_period,
  CAST(count(*) FILTER (WHERE scraped_at >= as_of - to_days(2 * x.days) AND scraped_at < as_of - to_days(x.days)) AS BIGINT) AS in_previous
FROM snapshots, clock, (VALUES ('24h', 1), ('7d', 7), ('30d', 30), ('90d', 90), ('1y', 365)) x(name, days) GROUP BY 1""")
def _(t):
    cols = []
    for name in ("24h", "7d", "30d", "90d", "1y"):
        p = resolve_range(name, t.as_of)
        at = F.col("scraped_at")
        cols.append(F.struct(
            F.lit(name).alias("range"), F.count_if(at >= F.lit(p.date_from)).alias("in_period"),
            F.count_if((at >= F.lit(p.previous_from)) & (at < F.lit(p.previous_to))).alias("in_previous")).alias(f"r{name}"))
    return t.snapshots.agg(*cols).select(F.inline(F.array(*[F.col(f"`r{n}`") for n in ("24h", "7d", "30d", "90d", "1y")])))


@query("b02_dashboard_range", """
SELECT x.name AS range, CAST(count(*) FILTER (WHERE scraped_at >= as_of - to_days(x.days)) AS BIGINT) AS in_period,
  CAST(count(*) FILTER (WHERE scraped_at >= as_of - to_days(2 * x.days) AND scraped_at < as_of - to_days(x.days)) AS BIGINT) AS in_previous
FROM snapshots, clock, (VALUES ('today', 0), ('7d', 7), ('30d', 30)) x(name, days) GROUP BY 1""")
def _(t):
    cols = []
    for name in ("today", "7d", "30d"):
        p = resolve_dashboard_range(name, t.as_of)
        at = F.col("scraped_at")
        cols.append(F.struct(
            F.lit(name).alias("range"), F.count_if(at >= F.lit(p.date_from)).alias("in_period"),
            F.count_if((at >= F.lit(p.previous_from)) & (at < F.lit(p.previous_to))).alias("in_previous")).alias(f"r{name}"))
    return t.snapshots.agg(*cols).select(F.inline(F.array(*[F.col(f"`r{n}`") for n in ("today", "7d", "30d")])))


@query("b03_snapshot_scope", """
SELECT s.org_id, s.snapshot_id, s.listing_id, d.store_name, d.product_id, d.category_name, CAST(s.price AS DOUBLE) AS price,
  coalesce(d.product_name, d.title, d.url) AS product_title
FROM snapshots s JOIN dims d USING (listing_id)
WHERE lower(d.store_name) = 'store_1' AND lower(coalesce(d.category_name, '')) = 'economy' AND s.availability = 'in_stock' AND s.confidence < 0.7
  AND d.match_id IS NOT NULL AND s.old_price > s.price AND s.price >= 1000 AND s.price <= 90000
  AND d.last_scraped_at < (SELECT as_of - INTERVAL 1 DAY FROM clock)""")
def _(t):
    f = Filters(range="all", competitor="STORE_1", category="economy", availability="in_stock", discount_only=True, in_stock_only=True,
                stale_only=True, low_confidence_only=True, reviewed_only=True, min_price=1000.0, max_price=90000.0)
    return SC.enriched_scope(t, f).select(
        "org_id", "snapshot_id", "listing_id", "store_name", "product_id", "category_name", S.dbl("price").alias("price"),
        F.coalesce("product_name", "listing_title", "url").alias("product_title"))


@query("b04_latest_scope", """
SELECT org_id, listing_id, store_name, product_id, category_name, CAST(price AS DOUBLE) AS price, availability, snapshot_status, scraped_at
FROM (SELECT d.*, n.price, n.availability, n.status AS snapshot_status, n.scraped_at FROM dims d JOIN
  (SELECT * FROM snapshots WHERE confidence < 0.7 QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY scraped_at DESC, snapshot_id DESC) = 1) n USING (listing_id))
WHERE lower(coalesce(product_brand, brand, 'Unknown')) <> ''""")
def _(t):
    return SC.latest_scope(t, Filters(range="all", low_confidence_only=True)).select(
        "org_id", "listing_id", "store_name", "product_id", "category_name", S.dbl("price").alias("price"), "availability", "snapshot_status", "scraped_at")


@query("b10_time_bucket", """
SELECT 'hour' AS unit, date_trunc('hour', ts) AS bucket, count(*) AS n FROM events GROUP BY 2
UNION ALL SELECT 'day', date_trunc('day', ts), count(*) FROM events GROUP BY 2
UNION ALL SELECT 'month', date_trunc('month', ts), count(*) FROM events GROUP BY 2""")
def _(t):
    e = t.provider_checks
    # hours are the finest unit: the coarser buckets add up the hourly counts
    hours = e.groupBy(time_bucket("checked_at", "24h").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    each = F.array(*[F.struct(F.lit(u).alias("unit"), time_bucket("hour", r).alias("bucket")) for u, r in (("hour", "24h"), ("day", "30d"), ("month", "all"))])
    return hours.select(F.inline(each), "n").groupBy("unit", "bucket").agg(F.sum("n").alias("n"))


@query("c01_inner_equi", """
SELECT l.org_id, st.name AS store_name, l.brand, count(*) AS n, CAST(sum(s.price) AS DOUBLE) AS total
FROM snapshots s JOIN listings l USING (listing_id) JOIN stores st ON st.store_id = l.store_id GROUP BY 1, 2, 3""")
def _(t):
    # observations shrink to one row per listing before the join
    per = t.snapshots.groupBy("listing_id").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("p"))
    j = per.join(t.listings.select("listing_id", "org_id", "store_id", "brand"), "listing_id").join(SC.store_names(t), "store_id")
    return j.groupBy("org_id", "store_name", "brand").agg(F.sum("n").alias("n"), S.dbl(F.sum("p")).alias("total"))


@query("c02_left_confirmed_match", """
SELECT listing_id, match_id, product_id, product_name, category_name FROM dims""")
def _(t):
    return SC.with_confirmed_match(t.listings.select("listing_id"), t).select("listing_id", "match_id", "product_id", "product_name", "category_name")


@query("c03_left_using", f"""
SELECT s.store_id, CAST(count(*) FILTER (WHERE {CHG}) AS BIGINT) AS price_changes, coalesce(max(f.failed), 0) AS failed_runs
FROM seq_all s LEFT JOIN (SELECT store_id, count(*) AS failed FROM runs WHERE status = 'failed' GROUP BY 1) f USING (store_id) GROUP BY 1""")
def _(t):
    moves = SC.sequenced(t, t.snapshots).groupBy("store_id").agg(F.count_if(SC.changed()).alias("price_changes"))
    failed = t.runs.where(F.col("status") == "failed").groupBy("store_id").agg(F.count(F.lit(1)).alias("failed_runs"))
    return moves.join(failed, "store_id", "left").na.fill(0, ["failed_runs"])


def _overview_sql():
    cur, prev = "seq_cur", "seq_prev"
    def part(src, tag):
        return f"""
SELECT org_id, count(DISTINCT store_id) AS {tag}active_competitors, {AVG('price')} AS {tag}avg_price, {MED('price')} AS {tag}median_price,
  {R(f"avg({DISC0}) FILTER (WHERE price IS NOT NULL)", 2)} AS {tag}avg_discount,
  count(*) FILTER (WHERE {CHG}) AS {tag}price_changes, count(*) FILTER (WHERE {DROP}) AS {tag}price_drops,
  count(*) FILTER (WHERE {RISE}) AS {tag}price_increases, count(*) FILTER (WHERE {SCHG}) AS {tag}stock_changes,
  count(*) FILTER (WHERE status <> 'ok') AS {tag}failed_extractions
FROM {src} GROUP BY 1"""
    return f"""
WITH cur_o AS ({part(cur, '')}), prev_o AS ({part(prev, 'previous_')}),
prev_l AS (SELECT org_id, count(DISTINCT listing_id) FILTER (WHERE old_price > price) AS previous_discounted_products,
  count(DISTINCT listing_id) FILTER (WHERE availability = 'in_stock') AS previous_in_stock_products,
  count(DISTINCT listing_id) FILTER (WHERE availability = 'out_of_stock') AS previous_out_of_stock_products,
  count(DISTINCT listing_id) FILTER (WHERE confidence < 0.7) AS previous_low_confidence_products FROM seq_prev GROUP BY 1),
prev_t AS (SELECT s.org_id, count(DISTINCT coalesce('p' || m.product_id, 'l' || s.listing_id)) AS previous_total_products
  FROM seq_prev s LEFT JOIN confirmed m USING (listing_id) GROUP BY 1),
now_o AS (SELECT org_id, count(DISTINCT {KEY}) AS total_products, count(*) FILTER (WHERE old_price > price) AS discounted_products,
  count(*) FILTER (WHERE availability = 'in_stock') AS in_stock_products, count(*) FILTER (WHERE availability = 'out_of_stock') AS out_of_stock_products,
  count(*) FILTER (WHERE last_scraped_at < (SELECT as_of - INTERVAL 24 HOUR FROM clock)) AS stale_products,
  count(*) FILTER (WHERE confidence < 0.7) AS low_confidence_products,
  count(*) FILTER (WHERE last_scraped_at >= (SELECT as_of - INTERVAL 24 HOUR FROM clock)) AS fresh_products FROM latest_scope GROUP BY 1),
al AS (SELECT org_id, count(*) AS active_alerts FROM alert_rules WHERE active GROUP BY 1)
SELECT * FROM now_o LEFT JOIN cur_o USING (org_id) LEFT JOIN prev_o USING (org_id) LEFT JOIN prev_l USING (org_id) LEFT JOIN prev_t USING (org_id) LEFT JOIN al USING (org_id)"""


@query("d01_overview_kpis", _overview_sql())
def _(t):
    return A.overview(t, YEAR)


def _trend_sql(src="seq_all"):
    return f"""
SELECT org_id, date_trunc('month', scraped_at) AS bucket, {AVG('price')} AS average_price, {MED('price')} AS median_price,
  CAST(min(price) AS DOUBLE) AS min_price, CAST(max(price) AS DOUBLE) AS max_price, {R(f'avg({DISC0})', 2)} AS average_discount,
  count(*) FILTER (WHERE {DROP}) AS drops, count(*) FILTER (WHERE {RISE}) AS increases, count(*) FILTER (WHERE {CHG}) AS changes
FROM {src} WHERE price IS NOT NULL GROUP BY 1, 2"""


def _delta(cur, prev):
    return f"CASE WHEN {prev} = 0 THEN CASE WHEN {cur} = 0 THEN 0 ELSE 100 END ELSE {R(f'({cur} - {prev}) / abs({prev}) * 100', 1)} END"


def _kpi_sql():
    rows = []
    for i, (label, cur, prev, rule) in enumerate(A.KPIS):
        c = f"coalesce(CAST({cur} AS DOUBLE), 0)"
        if isinstance(rule, tuple):
            st = f"CASE WHEN {c} {'>' if rule[0] == 'above' else '<'} {rule[1]} THEN '{rule[2]}' ELSE '{rule[3]}' END"
        else:
            st = f"'{rule}'"
        if cur in ("avg_price", "median_price"):
            text = f"'€' || format('{{:,.2f}}', {c})"
        elif cur == "avg_discount":
            text = f"CASE WHEN {c} > 0 THEN '+' ELSE '' END || format('{{:.1f}}', {R(c, 1)}) || '%'"
        else:
            text = f"format('{{:,}}', CAST({c} AS BIGINT)) || '{'%' if cur == 'freshness' else ''}'"
        d = _delta(c, f"coalesce(CAST({prev} AS DOUBLE), 0)") if prev else "CAST(NULL AS DOUBLE)"
        rows.append(f"SELECT org_id, CAST({i + 1} AS BIGINT) AS position, '{label}' AS label, {c} AS numeric_value, {text} AS value, {st} AS status, CAST({d} AS DOUBLE) AS delta FROM o")
    union = "\nUNION ALL ".join(rows)
    return f"""
WITH o AS (SELECT *, {R('CAST(fresh_products AS DOUBLE) / total_products * 100', 0)} AS freshness FROM ({_overview_sql()})),
tr AS ({_trend_sql('seq_cur')}),
sp AS (SELECT org_id, string_agg(CAST(CAST(average_price AS DECIMAL(12,2)) AS VARCHAR), '|' ORDER BY bucket) AS sparkline FROM tr GROUP BY 1)
SELECT k.*, sp.sparkline FROM ({union}) k LEFT JOIN sp USING (org_id)"""


@query("d02_overview_deltas", _kpi_sql())
def _(t):
    return A.kpi_deltas(t, YEAR)


@query("d03_market_trend", _trend_sql())
def _(t):
    return A.market_trend(t, ALL)


def _clamp(e):
    return f"greatest(0.0, least(100.0, {R(e, 2)}))"


COMP_SQL = f"""
WITH st AS (SELECT org_id, store_id, count(DISTINCT listing_id) AS monitored_products,
  count(DISTINCT listing_id) FILTER (WHERE availability = 'in_stock') AS in_stock, {AVG('price')} AS avg_price, {MED('price')} AS median_price,
  CAST(min(price) AS DOUBLE) AS min_price, CAST(max(price) AS DOUBLE) AS max_price, {R(f'avg({DISC0})', 2)} AS avg_discount,
  count(*) FILTER (WHERE {CHG}) AS price_changes, count(*) FILTER (WHERE {DROP}) AS price_drops, count(*) FILTER (WHERE {RISE}) AS price_increases,
  count(*) FILTER (WHERE {SCHG}) AS stock_changes, {R('CAST(sum(confidence) AS DOUBLE) / count(confidence)', 3)} AS conf,
  count(*) FILTER (WHERE status = 'ok') / count(*) AS ok_share, max(scraped_at) AS seen FROM seq_all GROUP BY 1, 2),
fa AS (SELECT store_id, count(*) AS failed, max(coalesce(finished_at, started_at)) AS last_failed FROM runs WHERE status = 'failed' GROUP BY 1),
j AS (SELECT st.*, coalesce(fa.failed, 0) AS failed_scrapes, fa.last_failed, s.name AS store_name FROM st LEFT JOIN fa USING (store_id) JOIN stores s USING (store_id))
SELECT org_id, store_id, store_name, monitored_products, avg_price, median_price, min_price, max_price, avg_discount,
  {R('CAST(in_stock AS DOUBLE) / monitored_products', 2)} AS stock_ratio, price_changes, price_drops, price_increases, stock_changes, failed_scrapes,
  greatest(seen, last_failed) AS last_crawl,
  CAST({_clamp('(price_drops * 2 + round(avg_discount) * 1.5 + price_changes + stock_changes * 0.5 + failed_scrapes * 0.5) * 5')} AS DOUBLE) AS aggressiveness_score,
  {R('(max_price - min_price) / avg_price * 100', 1)} AS volatility_score,
  {R('22 + 16 + 22 * conf + 16 + CASE WHEN ok_share >= 0.8 THEN 16 ELSE 0 END + 8', 0)} AS data_quality_score FROM j"""


@query("d04_competitor_analytics", COMP_SQL)
def _(t):
    return A.competitor_analytics(t, ALL)


@query("h10_problem_competitors", f"""
SELECT * FROM ({COMP_SQL}) QUALIFY row_number() OVER (PARTITION BY org_id ORDER BY data_quality_score, price_changes DESC, store_id) <= 12""")
def _(t):
    return A.problem_competitors(t, ALL)


CAT_SQL = f"""
WITH e AS (SELECT s.*, d.product_id, d.category_id, coalesce(d.category_name, 'Uncategorized') AS category FROM seq_all s JOIN dims d USING (listing_id)),
g AS (SELECT org_id, category_id, category, count(DISTINCT {KEY}) AS products_count, count(DISTINCT store_id) AS competitors_count, {AVG('price')} AS avg_price,
  {MED('price')} AS median_price, CAST(min(price) AS DOUBLE) AS min_price, CAST(max(price) AS DOUBLE) AS max_price, {R(f'avg({DISC0})', 2)} AS avg_discount,
  {R("CAST(count(DISTINCT listing_id) FILTER (WHERE availability = 'in_stock') AS DOUBLE) / count(DISTINCT listing_id)", 2)} AS stock_ratio,
  count(*) FILTER (WHERE {CHG}) AS price_changes FROM e GROUP BY 1, 2, 3),
fl AS (SELECT DISTINCT org_id, category, first_value(CAST(price AS DOUBLE)) OVER w AS first_price, last_value(CAST(price AS DOUBLE)) OVER w AS last_price FROM e
  WHERE price IS NOT NULL WINDOW w AS (PARTITION BY org_id, category ORDER BY scraped_at, snapshot_id, listing_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT g.*, first_price, last_price, CAST({_clamp('(max_price - min_price) / avg_price * 100 * 0.7 + price_changes * 5')} AS DOUBLE) AS volatility_score,
  CASE WHEN (last_price - first_price) / first_price * 100 <= -3 THEN 'falling' WHEN (last_price - first_price) / first_price * 100 >= 3 THEN 'rising' ELSE 'stable' END AS trend
FROM g JOIN fl USING (org_id, category)"""


@query("d05_category_analytics", CAT_SQL)
def _(t):
    return A.category_analytics(t, ALL)


@query("e05_category_first_last", f"SELECT org_id, category, first_price, last_price FROM ({CAT_SQL})")
def _(t):
    return A.category_first_last(t, ALL)


@query("d06_availability_trend", """
SELECT org_id, date_trunc('month', scraped_at) AS bucket, count(DISTINCT listing_id) FILTER (WHERE availability = 'in_stock') AS in_stock,
  count(DISTINCT listing_id) FILTER (WHERE availability = 'out_of_stock') AS out_of_stock,
  count(DISTINCT listing_id) FILTER (WHERE availability IS NULL OR availability = 'unknown') AS unknown_count,
  count(*) FILTER (WHERE previous_availability IS DISTINCT FROM 'out_of_stock' AND availability = 'out_of_stock') AS newly_unavailable,
  count(*) FILTER (WHERE previous_availability = 'out_of_stock' AND availability = 'in_stock') AS back_in_stock
FROM seq_all GROUP BY 1, 2""")
def _(t):
    return A.availability_trend(t, ALL)


QUAL_SQL = f"""
WITH l AS (SELECT org_id, count(*) FILTER (WHERE price IS NULL) AS missing_price_count, count(*) FILTER (WHERE image_url IS NULL) AS missing_image_count,
  count(*) FILTER (WHERE confidence < 0.7) AS low_confidence_products,
  count(*) FILTER (WHERE last_scraped_at < (SELECT as_of - INTERVAL 1 DAY FROM clock)) AS stale_products,
  count(*) FILTER (WHERE snapshot_status <> 'ok') AS never_successfully_scraped,
  count(*) FILTER (WHERE last_scraped_at >= (SELECT as_of - INTERVAL 1 DAY FROM clock)) AS fresh_products, count(*) AS total_products FROM latest_scope GROUP BY 1),
s AS (SELECT org_id, count(*) FILTER (WHERE status <> 'ok') AS failed_extractions, count(*) FILTER (WHERE status = 'ok') AS ok_count, count(*) AS total_snapshots FROM snapshots GROUP BY 1),
j AS (SELECT *, {R('CAST(ok_count AS DOUBLE) / total_snapshots * 100', 0)} AS success_rate, {R('CAST(fresh_products AS DOUBLE) / total_products * 100', 0)} AS freshness FROM l JOIN s USING (org_id))
SELECT *, {R('(success_rate + freshness) / 2', 0)} AS data_quality_score FROM j"""


@query("d07_quality_summary", QUAL_SQL)
def _(t):
    return A.quality_summary(t, ALL)


@query("d08_confidence_histogram", """
SELECT org_id, CASE WHEN confidence >= 0.9 THEN '90-100' WHEN confidence >= 0.75 THEN '75-89' WHEN confidence >= 0.5 THEN '50-74' ELSE '<50' END AS band, count(*) AS count
FROM snapshots GROUP BY 1, 2""")
def _(t):
    return A.confidence_bands(t, ALL)


@query("d09_extraction_health_trend", """
SELECT org_id, date_trunc('month', scraped_at) AS bucket, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status <> 'ok') AS failed FROM snapshots GROUP BY 1, 2""")
def _(t):
    return A.extraction_health(t, ALL)


@query("d10_run_success_trend", f"""
SELECT org_id, date_trunc('day', created_at) AS bucket, count(*) FILTER (WHERE status IN ('success','partial')) AS success,
  count(*) FILTER (WHERE status = 'failed') AS failed, count(*) AS total,
  {R("CAST(count(*) FILTER (WHERE status IN ('success','partial')) AS DOUBLE) / count(*) * 100", 0)} AS success_rate FROM runs GROUP BY 1, 2""")
def _(t):
    return A.run_success(t, ALL)


OPS_SQL = """
SELECT org_id, coalesce(repair_attempts, 0) AS repair_attempts, coalesce(waiting_sessions, 0) AS waiting_sessions FROM
(SELECT org_id, count(*) AS repair_attempts FROM repair_attempts GROUP BY 1) a FULL JOIN
(SELECT org_id, count(*) AS waiting_sessions FROM manual_sessions WHERE status IN ('waiting_for_manual_action','browser_opened','paused') GROUP BY 1) m USING (org_id)"""


@query("d11_ops_counts", OPS_SQL)
def _(t):
    return A.ops_counts(t, ALL)


@query("e01_latest_snapshot", """
SELECT listing_id, snapshot_id, org_id, CAST(price AS DOUBLE) AS price, CAST(old_price AS DOUBLE) AS old_price, availability, status, scraped_at FROM newest""")
def _(t):
    l = ordered.latest_per_key(t.snapshots, ["listing_id"], ["snapshot_id", "org_id", "price", "old_price", "availability", "status", "scraped_at"])
    return l.withColumns({c: S.dbl(c) for c in ("price", "old_price")})


@query("e02_price_lag", "SELECT snapshot_id, listing_id, CAST(price AS DOUBLE) AS price, CAST(previous_price AS DOUBLE) AS previous_price FROM seq_all")
def _(t):
    return SC.sequenced(t, t.snapshots).select("snapshot_id", "listing_id", S.dbl("price").alias("price"), S.dbl("previous_price").alias("previous_price"))


@query("e03_availability_lag", "SELECT snapshot_id, listing_id, availability, previous_availability FROM seq_all")
def _(t):
    return SC.sequenced(t, t.snapshots, price=False, availability=True).select("snapshot_id", "listing_id", "availability", "previous_availability")


EVENTS_SQL = """
SELECT e.org_id, e.listing_id, snapshot_id, d.product_id, coalesce(d.product_name, d.title, d.url) AS product_title, d.store_name, availability,
  previous_availability, scraped_at, metric
FROM (SELECT *, count(*) OVER (PARTITION BY listing_id) AS metric FROM seq_all WHERE previous_availability <> availability OR availability = 'out_of_stock') e
JOIN dims d USING (listing_id)"""


@query("e06_availability_events", EVENTS_SQL)
def _(t):
    return A.availability_events(t, ALL)


@query("e06_availability_lists", f"""
WITH ev AS ({EVENTS_SQL}),
a AS (SELECT *, 'newly_unavailable' AS list FROM ev WHERE previous_availability IS DISTINCT FROM 'out_of_stock' AND availability = 'out_of_stock'
  QUALIFY row_number() OVER (PARTITION BY org_id ORDER BY scraped_at DESC, snapshot_id DESC) <= 25),
b AS (SELECT *, 'back_in_stock' AS list FROM ev WHERE previous_availability = 'out_of_stock' AND availability = 'in_stock'
  QUALIFY row_number() OVER (PARTITION BY org_id ORDER BY scraped_at DESC, snapshot_id DESC) <= 25),
c AS (SELECT *, 'unstable' AS list FROM ev QUALIFY row_number() OVER (PARTITION BY org_id ORDER BY metric DESC, scraped_at DESC, snapshot_id DESC) <= 25)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def _(t):
    return A.availability_lists(t, ALL)


def _moves_sql():
    return f"""
WITH ch AS (SELECT org_id, listing_id, snapshot_id, CAST(previous_price AS DOUBLE) AS old_price, CAST(price AS DOUBLE) AS new_price,
  CAST(price - previous_price AS DOUBLE) AS delta_amount, CAST(price - previous_price AS DOUBLE) / CAST(previous_price AS DOUBLE) * 100 AS delta_pct, scraped_at AS moved_at FROM seq_all WHERE {CHG}),
vo AS (SELECT org_id, listing_id, CAST(0 AS BIGINT) AS snapshot_id, CAST(min(price) AS DOUBLE) AS old_price, CAST(max(price) AS DOUBLE) AS new_price,
  CAST(max(price) AS DOUBLE) - CAST(min(price) AS DOUBLE) AS delta_amount, (CAST(max(price) AS DOUBLE) - CAST(min(price) AS DOUBLE)) / (CAST(sum(price) AS DOUBLE) / count(price)) * 100 AS delta_pct,
  max(scraped_at) AS moved_at, CAST(count(price) AS DOUBLE) AS metric FROM snapshots WHERE price IS NOT NULL GROUP BY 1, 2),
di AS (SELECT org_id, listing_id, CAST(0 AS BIGINT) AS snapshot_id, CAST(old_price AS DOUBLE) AS old_price, CAST(price AS DOUBLE) AS new_price, CAST(old_price - price AS DOUBLE) AS delta_amount,
  CAST(old_price - price AS DOUBLE) / CAST(old_price AS DOUBLE) * 100 AS delta_pct, scraped_at AS moved_at FROM latest_scope WHERE old_price > price),
mi AS (SELECT org_id, listing_id, CAST(price AS DOUBLE) AS new_price, scraped_at AS moved_at FROM latest_scope WHERE price IS NULL),
sl AS (SELECT org_id, listing_id, CAST(price AS DOUBLE) AS new_price, last_scraped_at AS moved_at, (epoch((SELECT as_of FROM clock)) - epoch(last_scraped_at)) / 3600 AS metric FROM latest_scope
  WHERE last_scraped_at < (SELECT as_of - INTERVAL 1 DAY FROM clock)),
u AS (SELECT 'drop' AS kind, *, abs(delta_pct) AS metric FROM ch WHERE delta_amount < 0
  UNION ALL SELECT 'increase', *, abs(delta_pct) FROM ch WHERE delta_amount > 0
  UNION ALL SELECT 'volatile', * FROM vo WHERE delta_pct > 0 UNION ALL SELECT 'discounted', *, delta_pct FROM di
  UNION ALL SELECT 'frequent', * FROM vo WHERE metric > 1
  UNION ALL SELECT 'missing', org_id, listing_id, 0, NULL, new_price, NULL, NULL, moved_at, NULL FROM mi
  UNION ALL SELECT 'stale', org_id, listing_id, 0, NULL, new_price, NULL, NULL, moved_at, metric FROM sl),
r AS (SELECT *, row_number() OVER (PARTITION BY org_id, kind ORDER BY round(abs(coalesce(metric, delta_pct, 0)), 6) DESC, moved_at DESC, listing_id, snapshot_id) AS position FROM u)
SELECT r.org_id, kind, d.product_id, r.listing_id, coalesce(d.product_name, d.title, d.url) AS product_title, d.store_name, old_price, new_price, delta_amount,
  delta_pct, moved_at, metric, position FROM r JOIN dims d USING (listing_id) WHERE position <= 20"""


@query("h03_product_movements", _moves_sql())
def _(t):
    return A.product_movements(t, ALL)


@query("g01_union_movements", f"""
SELECT 'drop' AS kind, org_id, count(*) AS n FROM seq_all WHERE {DROP} GROUP BY 2 UNION ALL
SELECT 'increase', org_id, count(*) FROM seq_all WHERE {RISE} GROUP BY 2 UNION ALL
SELECT 'volatile', org_id, count(*) FROM (SELECT org_id, listing_id FROM snapshots GROUP BY 1, 2 HAVING max(price) > min(price)) GROUP BY 2 UNION ALL
SELECT 'discounted', org_id, count(*) FROM latest_scope WHERE old_price > price GROUP BY 2 UNION ALL
SELECT 'frequent', org_id, count(*) FROM (SELECT org_id, listing_id FROM snapshots GROUP BY 1, 2 HAVING count(price) > 1) GROUP BY 2 UNION ALL
SELECT 'missing', org_id, count(*) FROM latest_scope WHERE price IS NULL GROUP BY 2 UNION ALL
SELECT 'stale', org_id, count(*) FROM latest_scope WHERE last_scraped_at < (SELECT as_of - INTERVAL 1 DAY FROM clock) GROUP BY 2""")
def _(t):
    return A.all_movements(t, ALL).groupBy("kind", "org_id").agg(F.count(F.lit(1)).alias("n"))


@query("f02_topk_movements", f"SELECT org_id, kind, position, listing_id FROM ({_moves_sql()})")
def _(t):
    return A.product_movements(t, ALL).select("org_id", "kind", F.col("position").cast("bigint").alias("position"), "listing_id")


@query("f03_worst_products", f"""
SELECT org_id, listing_id, product_id, coalesce(product_name, title, url) AS product_title, store_name, CAST(price AS DOUBLE) AS price, currency,
  CAST(confidence AS DOUBLE) AS confidence, snapshot_status, scraped_at, quality_score FROM (
SELECT *, {R("CASE WHEN price IS NOT NULL THEN 22 ELSE 0 END + CASE WHEN coalesce(product_name, title) IS NOT NULL THEN 16 ELSE 0 END + coalesce(confidence, 0) * 22 + CASE WHEN last_scraped_at >= (SELECT as_of - INTERVAL 1 DAY FROM clock) THEN 16 ELSE 0 END + CASE WHEN snapshot_status = 'ok' THEN 16 ELSE 0 END + 8", 0)} AS quality_score
FROM latest_scope) QUALIFY row_number() OVER (PARTITION BY org_id ORDER BY quality_score, scraped_at NULLS FIRST, listing_id) <= 40""")
def _(t):
    return A.worst_products(t, ALL)


@query("f05_downsample", f"""
WITH tr AS (SELECT org_id, date_trunc('day', scraped_at) AS bucket, count(*) AS n FROM snapshots GROUP BY 1, 2),
x AS (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY bucket) - 1 AS i, count(*) OVER (PARTITION BY org_id) AS total FROM tr)
SELECT org_id, bucket, n FROM x WHERE i % CAST(ceil(total / 60.0) AS BIGINT) = 0 AND i / CAST(ceil(total / 60.0) AS BIGINT) < 60""")
def _(t):
    per_day = t.snapshots.groupBy("org_id", F.date_trunc("day", "scraped_at").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return A.downsample(per_day, 60)


def _insights_sql():
    f = lambda e, d: f"format('{{:.{d}f}}', {R(e, d)})"
    def top(src, block, kind, sev, subj, metric, order, k=5):
        return f"""SELECT org_id, {block} AS block, row_number() OVER (PARTITION BY org_id ORDER BY {order}) AS place, '{kind}' AS type, {sev} AS severity, {subj} AS subject, {metric} AS metric
FROM {src} QUALIFY row_number() OVER (PARTITION BY org_id ORDER BY {order}) <= {k}"""
    return f"""
WITH cat AS ({CAT_SQL}), comp AS ({COMP_SQL}), mv AS ({_moves_sql()}), qu AS ({QUAL_SQL}), op AS ({OPS_SQL}),
u AS ({top("(SELECT * FROM cat WHERE trend = 'falling')", 1, 'price_drop_trend', "'success'", 'category', f('volatility_score', 0) + " || ' volatility'", 'price_changes DESC, products_count DESC, category')}
UNION ALL {top('(SELECT * FROM comp WHERE aggressiveness_score >= 25)', 2, 'aggressive_competitor', "CASE WHEN aggressiveness_score >= 60 THEN 'critical' ELSE 'warning' END", 'store_name', f('aggressiveness_score', 0) + " || '/100'", 'aggressiveness_score DESC, price_changes DESC, store_id')}
UNION ALL {top("(SELECT * FROM mv WHERE kind = 'discounted')", 3, 'discount_spike', "'info'", 'product_title', f('delta_pct', 1) + " || '%'", 'position')}
UNION ALL {top("(SELECT * FROM mv WHERE kind = 'volatile')", 4, 'unusual_activity', "'warning'", 'product_title', f('delta_pct', 1) + " || '%'", 'position')}
UNION ALL {top("(SELECT * FROM mv WHERE kind = 'stale')", 5, 'stale_monitoring', "'warning'", 'product_title', f('metric', 0) + " || 'h'", 'position')}
UNION ALL {top("(SELECT * FROM qu JOIN op USING (org_id) WHERE waiting_sessions > 0 OR failed_extractions > 0)", 6, 'stale_monitoring', "CASE WHEN failed_extractions > 10 THEN 'critical' ELSE 'warning' END", "'Data collection quality needs attention'", f('data_quality_score', 0) + " || '/100'", 'org_id', 1)})
SELECT org_id, CAST(block AS BIGINT) AS block, place, type, severity, subject, metric FROM u"""


@query("h09_market_insights", _insights_sql())
def _(t):
    return A.market_insights(t, ALL).withColumns({c: F.col(c).cast("bigint") for c in ("block", "place")})
