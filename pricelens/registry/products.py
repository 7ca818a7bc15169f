"""Product-mart queries (a12, b07, b08, c04, c06, c08, d24-d28, d37-d42, e07, e09, e11, e13, f01, f06, f08, g03, h01, h02, h06-h08, i30)."""

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators.ordered import latest_per_key, top_k
from ..plans import products as P
from ..plans.filters import EntityFilters
from .base import AVG, PREV, R, cte, query

cte("edges_c", """
SELECT org_id, 'p' || product_id AS entity_id, product_id, listing_id FROM confirmed
UNION ALL SELECT org_id, 'l' || listing_id, NULL, listing_id FROM listings WHERE listing_id NOT IN (SELECT listing_id FROM confirmed)""")
cte("members_c", """
SELECT e.org_id, e.entity_id, e.product_id, l.listing_id, l.store_id, s.name AS store_name, coalesce(l.title, l.url) AS title, l.title AS raw_title, l.brand, l.sku, l.gtin,
  coalesce(l.image_url, n.image_url) AS image_url, coalesce(n.price, l.last_snapshot_price) AS price, n.old_price, coalesce(n.currency, l.last_snapshot_currency) AS currency,
  n.availability, n.scraped_at AS seen_at, l.last_scraped_at, l.last_change_at
FROM edges_c e JOIN listings l USING (listing_id) JOIN newest n USING (listing_id) JOIN stores s ON s.store_id = l.store_id""")
cte("hist_c", """
SELECT entity_id, min(price) AS hmin, max(price) AS hmax, CAST(sum(price) AS DOUBLE) / count(price) AS havg,
  arg_min(price, (scraped_at, snapshot_id, s.listing_id)) AS hfirst, arg_max(price, (scraped_at, snapshot_id, s.listing_id)) AS hlast
FROM snapshots s JOIN edges_c USING (listing_id) WHERE price IS NOT NULL AND scraped_at >= (SELECT as_of - INTERVAL 120 DAY FROM clock) GROUP BY 1""")


def _vol(lo, hi, avg):
    return f"CASE WHEN {avg} > 0 THEN {R(f'CAST({hi} - {lo} AS DOUBLE) / {avg} * 100', 1)} ELSE 0 END"


cte("entities_c", f"""
SELECT *, {_vol('coalesce(hmin, cmin)', 'coalesce(hmax, cmax)', 'coalesce(havg, current_avg_price)')} AS volatility,
  CASE WHEN in_stock_count > 0 AND out_stock_count > 0 THEN 'mixed' WHEN in_stock_count > 0 THEN 'in_stock' WHEN out_stock_count > 0 THEN 'out_of_stock' ELSE 'unknown' END AS stock_status,
  CASE WHEN hfirst IS NULL OR hlast IS NULL THEN 'unknown' WHEN {_vol('coalesce(hmin, cmin)', 'coalesce(hmax, cmax)', 'coalesce(havg, current_avg_price)')} >= 12 THEN 'volatile'
    WHEN CAST(hlast - hfirst AS DOUBLE) / CAST(hfirst AS DOUBLE) * 100 <= -3 THEN 'falling' WHEN CAST(hlast - hfirst AS DOUBLE) / CAST(hfirst AS DOUBLE) * 100 >= 3 THEN 'rising' ELSE 'stable' END AS market_trend,
  least(0.98, {R("CASE WHEN matched THEN 0.62 ELSE 0.42 END + CASE WHEN competitors_count > 1 THEN 0.12 ELSE 0 END + CASE WHEN has_gtin THEN 0.14 ELSE 0 END + CASE WHEN has_sku THEN 0.08 ELSE 0 END + CASE WHEN brand <> '' THEN 0.06 ELSE 0 END + CASE WHEN cmin IS NOT NULL THEN 0.05 ELSE 0 END", 2)}) AS confidence
FROM (
SELECT b.*, coalesce(g.n, 0) AS competitors_count, g.cmin, g.cmax, g.current_avg_price, coalesce(g.i, 0) AS in_stock_count, coalesce(g.o, 0) AS out_stock_count, coalesce(g.u, 0) AS unknown_stock_count,
  coalesce(g.d, 0) AS active_discounts, CASE WHEN matched THEN greatest(g.lc, g.ls, b.upd) ELSE greatest(g.lc, g.ls, b.discovered_at) END AS last_change,
  CASE WHEN matched THEN greatest(g.ls, b.upd) ELSE coalesce(g.ls, b.discovered_at) END AS updated_at, matched AND coalesce(g.n, 0) > 1 AS duplicate_risk,
  coalesce(g.gt, false) OR own_gtin AS has_gtin, coalesce(g.sk, false) OR own_gtin IS NOT NULL AS has_sku, h.hmin, h.hmax, h.havg, h.hfirst, h.hlast, g.img
FROM (SELECT p.org_id, 'p' || product_id AS entity_id, product_id AS id, 'normalized' AS entity_type, p.name AS canonical_title, brand, c.name AS category, p.category_id, true AS matched, created_at AS discovered_at,
    updated_at AS upd, gtin IS NOT NULL AS own_gtin, coalesce(lower(gtin), 'mp:' || product_id) AS cluster_key, lower(concat_ws(' ', p.name, brand, sku, gtin)) AS own_text FROM my_products p JOIN categories c USING (category_id)
  UNION ALL SELECT l.org_id, 'l' || listing_id, listing_id, 'raw_competitor', coalesce(title, url), brand, NULL, NULL, false, created_at, NULL, false,
    coalesce(lower(gtin), nullif(regexp_replace(lower(coalesce(brand, '') || ' ' || coalesce(title, '')), '[^a-z0-9]+', ' ', 'g'), '')), lower(concat_ws(' ', title, brand, sku, gtin, url, s.name))
  FROM listings l JOIN stores s USING (store_id) WHERE listing_id NOT IN (SELECT listing_id FROM confirmed)) b
LEFT JOIN (SELECT entity_id, count(*) AS n, min(price) AS cmin, max(price) AS cmax, {AVG('price')} AS current_avg_price, count(*) FILTER (WHERE availability = 'in_stock') AS i,
    count(*) FILTER (WHERE availability = 'out_of_stock') AS o, count(*) FILTER (WHERE availability = 'unknown') AS u, count(*) FILTER (WHERE old_price > price) AS d, max(last_change_at) AS lc,
    max(last_scraped_at) AS ls, bool_or(gtin IS NOT NULL) AS gt, bool_or(sku IS NOT NULL) AS sk, arg_min(image_url, listing_id) FILTER (WHERE image_url IS NOT NULL) AS img FROM members_c GROUP BY 1) g USING (entity_id)
LEFT JOIN hist_c h USING (entity_id))""")
cte("tl_c", f"""
SELECT e.org_id, e.entity_id, s.listing_id, st.name AS store_name, s.snapshot_id, s.scraped_at, s.price, s.old_price, s.availability, s.confidence, s.previous_price, s.previous_availability
FROM seq_all s JOIN edges_c e USING (listing_id) JOIN stores st ON st.store_id = s.store_id""")

ENTITY_COLS = ["org_id", "entity_id", "entity_type", "canonical_title", "brand", "category", "image_url", "competitors_count", "current_min_price", "current_avg_price", "current_max_price",
               "hist_min", "hist_avg", "hist_max", "first_price", "last_price", "in_stock_count", "out_stock_count", "unknown_stock_count", "active_discounts", "last_change", "updated_at",
               "matched", "duplicate_risk", "stale", "missing_price", "has_gtin", "has_sku", "volatility", "market_trend", "stock_status", "confidence", "cluster_key", "currency"]
H01 = f"""
SELECT org_id, entity_id, entity_type, canonical_title, brand, category, img AS image_url, competitors_count, CAST(cmin AS DOUBLE) AS current_min_price, current_avg_price, CAST(cmax AS DOUBLE) AS current_max_price,
  CAST(hmin AS DOUBLE) AS hist_min, {R('havg', 4)} AS hist_avg, CAST(hmax AS DOUBLE) AS hist_max, CAST(hfirst AS DOUBLE) AS first_price, CAST(hlast AS DOUBLE) AS last_price,
  in_stock_count, out_stock_count, unknown_stock_count, active_discounts, last_change, updated_at, matched, duplicate_risk, coalesce(updated_at, discovered_at) < (SELECT as_of - INTERVAL 1 DAY FROM clock) AS stale,
  cmin IS NULL AS missing_price, has_gtin, has_sku, CAST(volatility AS DOUBLE) AS volatility, market_trend, stock_status, CAST(confidence AS DOUBLE) AS confidence, cluster_key, 'EUR' AS currency, discovered_at, category_id, own_text FROM entities_c"""
PICK = ", ".join(ENTITY_COLS)


@query("h01_product_entities", f"SELECT {PICK} FROM ({H01})")
def _(t):
    return P.product_entities(t).select(*ENTITY_COLS)


@query("g03_union_entities", "SELECT org_id, entity_type, count(*) AS entities, CAST(sum(competitors_count) AS BIGINT) AS listings FROM entities_c GROUP BY 1, 2")
def _(t):
    return P.product_entities(t, False).groupBy("org_id", "entity_type").agg(F.count(F.lit(1)).alias("entities"), F.sum("competitors_count").alias("listings"))


@query("h01_entity_members", """
SELECT org_id, entity_id, listing_id, store_name, title, CAST(price AS DOUBLE) AS price, CAST(old_price AS DOUBLE) AS old_price, availability, seen_at FROM members_c""")
def _(t):
    return P.members(t).select("org_id", "entity_id", "listing_id", "store_name", "title", S.dbl("price").alias("price"), S.dbl("old_price").alias("old_price"), "availability", "seen_at")


@query("i30_search_text", "SELECT entity_id, own_text FROM entities_c")
def _(t):
    return P.product_entities(t, False).select("entity_id", "own_text")


SPARK = f"""
SELECT org_id, entity_id, day, price FROM (SELECT e.org_id, e.entity_id, CAST(s.scraped_at AS DATE) AS day, {AVG('s.price')} AS price FROM snapshots s JOIN edges_c e USING (listing_id)
WHERE s.price IS NOT NULL AND s.scraped_at >= (SELECT as_of - INTERVAL 45 DAY FROM clock) GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY day DESC) <= 16"""


@query("e09_sparkline", f"""
SELECT entity_id, string_agg(strftime(day, '%Y-%m-%d') || '=' || CAST(CAST(price AS DECIMAL(12,2)) AS VARCHAR), '|' ORDER BY day) AS sparkline, count(*) AS points FROM ({SPARK}) GROUP BY 1""")
def _(t):
    s = P.sparkline(t)
    text = F.transform("sparkline", lambda x: F.concat(x["day"].cast("string"), F.lit("="), x["price"].cast("decimal(12,2)").cast("string")))
    return s.select("entity_id", F.array_join(text, "|").alias("sparkline"), F.size("sparkline").cast("bigint").alias("points"))


@query("b07_entity_filter", f"""
SELECT entity_id FROM ({H01}) WHERE (contains(own_text, 'ring') OR entity_id IN (SELECT entity_id FROM members_c WHERE contains(lower(concat_ws(' ', raw_title, sku, gtin)), 'ring')))
  AND lower(coalesce(category, '')) = 'economy' AND entity_id IN (SELECT entity_id FROM members_c WHERE store_id = 1) AND current_avg_price >= 1000 AND current_avg_price <= 80000
  AND in_stock_count > 0 AND out_stock_count > 0 AND active_discounts > 0
  AND (contains(lower(concat_ws(' ', canonical_title, brand)), 'ring') OR entity_id IN (SELECT entity_id FROM members_c WHERE contains(lower(raw_title), 'ring')))""")
def _(t):
    f = EntityFilters(search="ring", category="Economy", competitor=1, min_price=1000.0, max_price=80000.0, availability="in_stock", stock="mixed", discount="discounted", specs={"motor": "Ring"})
    return P.filter_entities(P.product_entities(t, False), P.members(t), f, t).select("entity_id")


@query("b08_entity_advanced_filter", f"""
WITH e AS ({H01})
SELECT x.preset, count(*) AS n FROM e, (VALUES ('newly_discovered'), ('stale_data'), ('missing_prices'), ('high_discounts'), ('price_drops'), ('stock_changes'), ('only_matched'), ('only_unmatched'), ('only_duplicates')) x(preset)
WHERE CASE preset WHEN 'newly_discovered' THEN discovered_at >= (SELECT as_of - INTERVAL 7 DAY FROM clock) WHEN 'stale_data' THEN stale WHEN 'missing_prices' THEN missing_price WHEN 'high_discounts' THEN active_discounts > 0
  WHEN 'price_drops' THEN last_price < first_price * 0.97 WHEN 'stock_changes' THEN in_stock_count > 0 AND out_stock_count > 0 WHEN 'only_matched' THEN matched WHEN 'only_unmatched' THEN NOT matched ELSE duplicate_risk END GROUP BY 1""")
def _(t):
    names = ["newly_discovered", "stale_data", "missing_prices", "high_discounts", "price_drops", "stock_changes", "only_matched", "only_unmatched", "only_duplicates"]
    g = P.product_entities(t, False).agg(*[F.count_if(P.advanced(n, t)).alias(n) for n in names])
    return g.select(F.inline(F.array(*[F.struct(F.lit(n).alias("preset"), F.col(n).alias("n")) for n in names]))).where(F.col("n") > 0)


@query("c04_anti_unmatched", "SELECT listing_id, store_id FROM listings l WHERE NOT EXISTS (SELECT 1 FROM confirmed c WHERE c.listing_id = l.listing_id)")
def _(t):
    ok = t.matches.where(F.col("status") == "confirmed").select("listing_id")
    return t.listings.select("listing_id", "store_id").join(ok, "listing_id", "left_anti")


TEMPL = """CASE store_id WHEN 1 THEN 'https://store1.example/?s=' || q || '&post_type=product' WHEN 2 THEN 'https://store2.example/catalogsearch/result/?q=' || q
  WHEN 4 THEN 'https://store4.example/search/?q=' || q ELSE 'https://store' || store_id || '.example/search?q=' || q END"""


@query("c06_not_in_missing_stores", f"""
WITH c AS (SELECT e.org_id, e.entity_id, s.store_id, s.name AS store_name, s.status, url_encode(concat_ws(' ', e.brand, e.canonical_title)) AS q FROM entities_c e JOIN stores s USING (org_id)
  WHERE NOT EXISTS (SELECT 1 FROM members_c m WHERE m.entity_id = e.entity_id AND m.store_id = s.store_id))
SELECT org_id, entity_id, store_id, store_name, status, (SELECT count(*) FROM listings l WHERE l.store_id = c.store_id) AS scraped_count, {TEMPL} AS search_url FROM c""")
def _(t):
    return P.missing_stores(t)


@query("c08_lateral_latest", """
SELECT l.listing_id, x.image_url, x.scraped_at FROM listings l, LATERAL (SELECT image_url, scraped_at FROM snapshots s WHERE s.listing_id = l.listing_id AND s.image_url IS NOT NULL ORDER BY scraped_at DESC, snapshot_id DESC LIMIT 1) x""")
def _(t):
    return latest_per_key(t.snapshots.where(F.col("image_url").isNotNull()), ["listing_id"], ["image_url", "scraped_at"])


@query("d24_price_stats", """
WITH w AS (SELECT *, (SELECT as_of FROM clock) AS a FROM tl_c WHERE price IS NOT NULL)
SELECT org_id, entity_id, CAST(list_sort(list(price))[count(*) // 2 + 1] AS DOUBLE) AS median, CAST(min(price) FILTER (WHERE scraped_at >= a - INTERVAL 30 DAY) AS DOUBLE) AS best_30d,
  CAST(max(price) FILTER (WHERE scraped_at >= a - INTERVAL 30 DAY) AS DOUBLE) AS worst_30d, CAST(min(price) FILTER (WHERE scraped_at >= a - INTERVAL 90 DAY) AS DOUBLE) AS best_90d,
  CAST(max(price) FILTER (WHERE scraped_at >= a - INTERVAL 90 DAY) AS DOUBLE) AS worst_90d FROM w GROUP BY 1, 2""")
def _(t):
    return P.price_stats(P.timeline(t, None), t)


@query("d25_daily_spread", f"""
SELECT org_id, entity_id, CAST(scraped_at AS DATE) AS day, CAST(min(price) AS DOUBLE) AS min_price, {AVG('price')} AS avg_price, CAST(max(price) AS DOUBLE) AS max_price FROM tl_c WHERE price IS NOT NULL GROUP BY 1, 2, 3""")
def _(t):
    return P.daily_spread(P.timeline(t, None))


GROUPS = {
    "brand": "coalesce(brand, 'Unknown brand')", "category": "coalesce(category, 'Uncategorized')", "stock": "replace(stock_status, '_', ' ')",
    "volatility": "CASE WHEN volatility >= 20 THEN 'high volatility' WHEN volatility >= 8 THEN 'medium volatility' ELSE 'low volatility' END",
    "discount": "CASE WHEN active_discounts > 0 THEN 'discounted' ELSE 'not discounted' END",
    "price_range": "CASE WHEN current_avg_price IS NULL THEN 'missing price' WHEN current_avg_price < 500 THEN '< 500' WHEN current_avg_price < 1500 THEN '500-1499' WHEN current_avg_price < 3000 THEN '1500-2999' WHEN current_avg_price < 5000 THEN '3000-4999' ELSE '5000+' END",
    "competitor": "CASE WHEN competitors_count > 1 THEN 'multi competitor' ELSE 'single competitor' END",
}


@query("d26_group_summary", "\nUNION ALL ".join(
    f"SELECT org_id, '{n}' AS group_by, {e} AS key, count(*) AS count, {R('avg(current_avg_price)', 2)} AS avg_price, {R('avg(volatility)', 1)} AS volatility FROM entities_c GROUP BY 1, 3" for n, e in GROUPS.items()))
def _(t):
    return P.group_entities(P.product_entities(t, False))


PAGES = " UNION ALL ".join(
    f"SELECT org_id, '{a}' AS page, {GROUPS[a]} AS value, {GROUPS[b]} AS key, count(*) AS count, {R('avg(current_avg_price)', 2)} AS avg_price, {R('avg(volatility)', 1)} AS volatility FROM entities_c GROUP BY 1, 3, 4"
    for a, b in (("category", "brand"), ("brand", "category")))


@query("d27_category_brand_pages", PAGES)
def _(t):
    return P.entity_pages(P.product_entities(t, False))


@query("d28_identifier_sets", """
SELECT DISTINCT m.org_id, m.product_id, x.kind, CASE x.kind WHEN 'sku' THEN sku WHEN 'gtin' THEN gtin ELSE raw_title END AS value FROM members_c m, (VALUES ('sku'), ('gtin'), ('title')) x(kind)
WHERE m.product_id IS NOT NULL AND CASE x.kind WHEN 'sku' THEN sku WHEN 'gtin' THEN gtin ELSE raw_title END <> ''""")
def _(t):
    return P.identifier_sets(t)


STORES = [f"STORE_{i}" for i in range(5)]


@query("d37_price_pivot", "SELECT org_id, entity_id, CAST(scraped_at AS DATE) AS day, " + ", ".join(
    f"CAST(arg_max(price, (scraped_at, snapshot_id)) FILTER (WHERE store_name = '{s}') AS DOUBLE) AS \"{s}\"" for s in STORES) + " FROM tl_c WHERE price IS NOT NULL GROUP BY 1, 2, 3")
def _(t):
    return P.price_pivot(P.timeline(t, None), STORES)


@query("d38_discount_timeline", f"""
SELECT org_id, entity_id, CAST(scraped_at AS DATE) AS day, {R('max(CAST(old_price - price AS DOUBLE) / CAST(old_price AS DOUBLE) * 100)', 2)} AS max_discount FROM tl_c WHERE old_price > price GROUP BY 1, 2, 3""")
def _(t):
    return P.discount_timeline(P.timeline(t, None))


@query("d39_entity_availability_days", """
SELECT org_id, entity_id, CAST(scraped_at AS DATE) AS day, count(*) FILTER (WHERE availability = 'in_stock') AS in_stock, count(*) FILTER (WHERE availability = 'out_of_stock') AS out_of_stock,
  count(*) FILTER (WHERE availability NOT IN ('in_stock','out_of_stock')) AS unknown FROM tl_c GROUP BY 1, 2, 3""")
def _(t):
    return P.availability_days(P.timeline(t, None))


@query("d40_activity_heatmap", """
WITH d AS (SELECT DISTINCT org_id, entity_id, CAST(scraped_at AS DATE) AS day FROM tl_c QUALIFY dense_rank() OVER (PARTITION BY entity_id ORDER BY CAST(scraped_at AS DATE) DESC) <= 14),
s AS (SELECT DISTINCT entity_id, store_name FROM tl_c), n AS (SELECT entity_id, CAST(scraped_at AS DATE) AS day, store_name, count(*) AS n FROM tl_c GROUP BY 1, 2, 3)
SELECT d.org_id, d.entity_id, d.day, s.store_name, coalesce(n.n, 0) AS observations FROM d JOIN s USING (entity_id) LEFT JOIN n ON n.entity_id = d.entity_id AND n.day = d.day AND n.store_name = s.store_name""")
def _(t):
    return P.activity_heatmap(P.timeline(t, None))


cte("leader_c", """
SELECT org_id, entity_id, CAST(scraped_at AS DATE) AS day, store_name AS leader FROM tl_c WHERE price IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY entity_id, CAST(scraped_at AS DATE) ORDER BY price, scraped_at, snapshot_id, store_name) = 1""")


@query("d41_cheapest_rotation", "SELECT org_id, entity_id, leader AS store_name, count(*) AS days FROM leader_c GROUP BY 1, 2, 3")
def _(t):
    return P.cheapest_rotation(P.timeline(t, None))


@query("e11_cheapest_streak", """
WITH x AS (SELECT *, first_value(leader) OVER (PARTITION BY entity_id ORDER BY day DESC) AS cur FROM leader_c),
y AS (SELECT *, sum(CASE WHEN leader <> cur THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY day DESC) AS misses FROM x)
SELECT org_id, entity_id, cur AS store_name, count(*) AS streak_days FROM y WHERE misses = 0 GROUP BY 1, 2, 3""")
def _(t):
    return P.cheapest_streak(P.timeline(t, None))


@query("e13_price_position", f"""
WITH x AS (SELECT *, min(price) OVER (PARTITION BY entity_id) AS lo, max(price) OVER (PARTITION BY entity_id) AS hi FROM members_c)
SELECT org_id, entity_id, listing_id, store_name, CAST(price AS DOUBLE) AS price, CASE WHEN hi > lo THEN {R('CAST(price - lo AS DOUBLE) / CAST(hi - lo AS DOUBLE) * 100', 1)} END AS price_position_pct FROM x""")
def _(t):
    return P.price_position(P.members(t))


@query("h02_product_detail", f"""
WITH g AS (SELECT entity_id, arg_min(store_name, (price, listing_id)) FILTER (WHERE price IS NOT NULL) AS cheapest_competitor, CAST(max(price) AS DOUBLE) AS highest_price, CAST(min(price) AS DOUBLE) AS min_price,
  {R('max(CAST(old_price - price AS DOUBLE) / CAST(old_price AS DOUBLE) * 100) FILTER (WHERE old_price > price)', 2)} AS current_discount_pct FROM members_c GROUP BY 1)
SELECT e.org_id, e.entity_id, canonical_title, cheapest_competitor, highest_price, min_price, current_avg_price AS average_price, current_discount_pct,
  CASE WHEN competitors_count > 0 THEN {R('CAST(in_stock_count AS DOUBLE) / competitors_count', 2)} ELSE 0 END AS stock_ratio, CAST(volatility AS DOUBLE) AS volatility_score, market_trend,
  {R('CAST(cmax AS DOUBLE) - CAST(cmin AS DOUBLE)', 2)} AS competitor_spread, {R('(CAST(cmax AS DOUBLE) - CAST(cmin AS DOUBLE)) / CAST(cmax AS DOUBLE) * 100', 1)} AS spread_pct, in_stock_count, out_stock_count, 'EUR' AS currency,
  CAST(confidence AS DOUBLE) AS confidence, competitors_count FROM entities_c e LEFT JOIN g USING (entity_id)""")
def _(t):
    return P.product_details(t)


CLUST = f"""
WITH h AS (SELECT org_id, cluster_key, count(*) AS entities, max(last_change) AS last_change FROM entities_c GROUP BY 1, 2),
r AS (SELECT org_id, cluster_key, entity_id AS representative, canonical_title AS title, brand, category FROM entities_c
  QUALIFY row_number() OVER (PARTITION BY org_id, cluster_key ORDER BY entity_type <> 'normalized', competitors_count DESC, confidence DESC, entity_id) = 1),
m AS (SELECT e.org_id, e.cluster_key, m.* EXCLUDE (org_id) FROM members_c m JOIN entities_c e USING (entity_id)
  QUALIFY row_number() OVER (PARTITION BY e.org_id, e.cluster_key, m.listing_id ORDER BY seen_at DESC, m.entity_id DESC) = 1),
g AS (SELECT org_id, cluster_key, count(*) AS members, count(DISTINCT store_id) AS store_count, CAST(min(price) AS DOUBLE) AS min_price, {AVG('price')} AS avg_price, CAST(max(price) AS DOUBLE) AS max_price,
  arg_min(store_name, (price, store_name, listing_id)) FILTER (WHERE price IS NOT NULL) AS cheapest_store, arg_min(store_name, (-price, store_name, listing_id)) FILTER (WHERE price IS NOT NULL) AS highest_store,
  count(*) FILTER (WHERE availability = 'in_stock') AS in_stock_stores, count(*) FILTER (WHERE availability = 'out_of_stock') AS out_of_stock_stores FROM m GROUP BY 1, 2)
SELECT r.*, entities, coalesce(members, 0) AS members, coalesce(store_count, 0) AS store_count, min_price, avg_price, max_price, cheapest_store, highest_store,
  CASE WHEN max_price <> min_price THEN {R('(max_price - min_price) / max_price * 100', 1)} END AS savings_pct, coalesce(in_stock_stores, 0) AS in_stock_stores, coalesce(out_of_stock_stores, 0) AS out_of_stock_stores, last_change
FROM h JOIN r USING (org_id, cluster_key) LEFT JOIN g USING (org_id, cluster_key)"""


@query("h06_clusters", CLUST)
def _(t):
    return P.clusters(t)


@query("f08_cluster_search_sort", f"""
SELECT * FROM ({CLUST}) c WHERE contains(lower(concat_ws(' ', title, brand, category)), 'small')
  OR (org_id, cluster_key) IN (SELECT (e.org_id, e.cluster_key) FROM members_c m JOIN entities_c e USING (entity_id) WHERE contains(lower(m.store_name), 'small'))""")
def _(t):
    keyed = P.members(t).join(P.product_entities(t, False, ["entity_id", "cluster_key"]), "entity_id")
    return P.sort_clusters(P.clusters(t), keyed, "Small", "savings")


@query("d42_product_page_summary", f"""
WITH c AS ({CLUST}), e AS ({H01})
SELECT * FROM (SELECT org_id, {R('avg(current_avg_price)', 2)} AS average_price, count(*) FILTER (WHERE volatility >= 10) AS volatile, count(*) FILTER (WHERE active_discounts > 0) AS discounted,
  count(*) FILTER (WHERE stale) AS stale, count(*) FILTER (WHERE missing_price) AS missing_price, count(*) AS entities FROM e GROUP BY 1)
JOIN (SELECT org_id, count(*) FILTER (WHERE store_count > 1) AS multi_store_groups, max(savings_pct) AS best_saving_pct FROM c GROUP BY 1) USING (org_id)""")
def _(t):
    return P.product_summary(P.product_entities(t, False), P.clusters(t))


def _sorted(where, order, k, extra=""):
    return f"""SELECT * FROM (SELECT org_id, entity_id, row_number() OVER (PARTITION BY org_id ORDER BY {order}updated_at DESC NULLS LAST, discovered_at DESC NULLS LAST, entity_id) AS position,
count(*) OVER (PARTITION BY org_id) AS total_count{extra} FROM ({H01}) WHERE {where}) WHERE position <= {k}"""


@query("f01_dynamic_sort", "\nUNION ALL ".join(
    f"SELECT '{s}' AS sort, org_id, entity_id, position FROM ({_sorted('true', o, 20)})" for s, o in {
        "updated_desc": "", "price_asc": "current_avg_price ASC NULLS LAST, ", "price_desc": "current_avg_price DESC NULLS LAST, ",
        "volatility_desc": "(hist_max - hist_min) / nullif(hist_avg, 0) DESC NULLS LAST, ", "title_asc": "canonical_title, ", "competitors_desc": "competitors_count DESC, "}.items()))
def _(t):
    e = P.product_entities(t, False)
    parts = [P.page(e, P.sort_order(s), 20).select(F.lit(s).alias("sort"), "org_id", "entity_id", "position")
             for s in ("updated_desc", "price_asc", "price_desc", "volatility_desc", "title_asc", "competitors_desc")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("e07_total_count_page", f"SELECT org_id, entity_id, position, total_count FROM ({_sorted('active_discounts > 0', 'current_avg_price DESC NULLS LAST, ', 100)}) WHERE position > 50")
def _(t):
    return P.entity_list(t, EntityFilters(discount="discounted", sort="price_desc", page=2)).select("org_id", "entity_id", "position", "total_count")


@query("f06_latest_n", """
SELECT listing_id, snapshot_id, scraped_at, CAST(price AS DOUBLE) AS price FROM snapshots QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY scraped_at DESC NULLS LAST, snapshot_id DESC) <= 5""")
def _(t):
    newest = top_k(t.snapshots, ["listing_id"], [F.desc_nulls_last("scraped_at"), F.desc("snapshot_id")], 5)
    return newest.select("listing_id", "snapshot_id", "scraped_at", S.dbl("price").alias("price"))


@query("h07_product_events", """
WITH u AS (
SELECT org_id, entity_id, listing_id, scraped_at AS event_at, snapshot_id, 'price_changed' AS type, store_name || ': ' || format('{:.2f}', CAST(previous_price AS DOUBLE)) || ' -> ' || format('{:.2f}', CAST(price AS DOUBLE)) AS label,
  CASE WHEN price < previous_price THEN 'success' ELSE 'warning' END AS status FROM tl_c WHERE price <> previous_price
UNION ALL SELECT org_id, entity_id, listing_id, scraped_at, snapshot_id, 'stock_changed', store_name || ': ' || previous_availability || ' -> ' || availability, CASE WHEN availability = 'out_of_stock' THEN 'critical' ELSE 'success' END
  FROM tl_c WHERE availability <> previous_availability
UNION ALL SELECT org_id, entity_id, listing_id, scraped_at, snapshot_id, 'selector_issue', store_name || ': low extraction confidence', 'warning' FROM tl_c WHERE confidence < 0.65
UNION ALL SELECT org_id, entity_id, listing_id, seen_at, 0, 'snapshot', store_name || ': latest snapshot', CASE WHEN price IS NULL THEN 'warning' ELSE 'neutral' END FROM members_c)
SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY event_at DESC, type, listing_id, snapshot_id) <= 80""")
def _(t):
    return P.product_events(t, days=None)


@query("h08_product_insights", f"""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY (hist_max - hist_min) / nullif(hist_avg, 0) DESC NULLS LAST, updated_at DESC NULLS LAST, discovered_at DESC NULLS LAST, entity_id) AS rk FROM ({H01})),
u AS (SELECT org_id, entity_id, canonical_title AS title, rk, 1 AS block, 'biggest_price_drops' AS type, 'success' AS severity, format('{{:.1f}}', volatility) || '% volatility' AS metric, 6 AS quota FROM e WHERE market_trend = 'falling'
UNION ALL SELECT org_id, entity_id, canonical_title, rk, 2, 'biggest_price_increases', 'warning', format('{{:.1f}}', volatility) || '% volatility', 6 FROM e WHERE market_trend = 'rising'
UNION ALL SELECT org_id, entity_id, canonical_title, rk, 3, 'unstable_products', CASE WHEN volatility >= 25 THEN 'critical' ELSE 'warning' END, format('{{:.1f}}', volatility) || '%', 8 FROM e WHERE volatility >= 10
UNION ALL SELECT org_id, entity_id, canonical_title, rk, 4, 'most_discounted', 'info', active_discounts || ' discounts', 8 FROM e WHERE active_discounts > 0
UNION ALL SELECT org_id, entity_id, canonical_title, rk, 5, 'stock_recovery_or_disappearing', CASE WHEN stock_status = 'out_of_stock' THEN 'critical' ELSE 'warning' END, replace(stock_status, '_', ' '), 8 FROM e WHERE stock_status IN ('out_of_stock','mixed')),
p AS (SELECT *, row_number() OVER (PARTITION BY org_id, block ORDER BY rk) AS place FROM u QUALIFY place <= quota)
SELECT org_id, entity_id, title, CAST(block AS BIGINT) AS block, type, severity, metric, place FROM p QUALIFY row_number() OVER (PARTITION BY org_id ORDER BY block, place) <= 32""")
def _(t):
    return P.product_insights(t)
