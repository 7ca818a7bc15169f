"""Web-page queries (k01-k24) over the stored pages and over one product page per listing."""

from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import urls as U
from ..plans import pages as PG
from .base import R, cte, query

cte("pp", """
SELECT listing_id AS page_id, listing_id % 5 AS kind, store_id, part_id, url, coalesce(title, 'no name') || ' no ' || listing_id || ' model' AS title, brand, sku, gtin,
  CAST(coalesce(last_snapshot_price, 19.99) AS DOUBLE) AS price, CASE WHEN last_snapshot_availability = 'out_of_stock' THEN 'out_of_stock' ELSE 'in_stock' END AS availability FROM listings""")
ENC = "array_to_string(list_transform(string_split({x}, ''), lambda c: CASE WHEN ord(c) > 126 OR ord(c) < 33 THEN replace(url_encode(c), '+', '%20') ELSE c END), '')"
cte("page_hosts", "SELECT *, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, regexp_replace(url, '[?#].*$', '') AS bare FROM pages")
cte("page_links", f"""
SELECT page_id, url AS from_url, position, origin || {ENC.format(x="CASE WHEN length(href) > 1 THEN regexp_replace(href, '/$', '') ELSE href END")} AS to_url FROM (
SELECT page_id, url, origin, i - 1 AS position, replace(hrefs[i], '&amp;', '&') AS href FROM (SELECT *, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS hrefs FROM page_hosts), UNNEST(range(1, len(hrefs) + 1)) x(i))
WHERE NOT regexp_matches(href, '(?i)/(?:account|konto|login|signin|register|cart|warenkorb|checkout|kasse|wishlist|compare|search|suche)(?:/|$)')""")


@query("k01_normalise_urls", """
SELECT page_id, CASE WHEN regexp_matches(url, 'page=2') THEN rtrim(bare, '/') || '?page=2&ref=x' ELSE rtrim(bare, '/') END AS url FROM page_hosts""")
def _(t):
    return t.pages.select("page_id", U.normalise_url(F.col("url"), F.col("url")).alias("url"))


@query("k02_url_kind", """
SELECT page_id, false AS is_category, false AS is_product, len(list_filter(string_split(regexp_extract(bare, '^https?://[^/]+(.*)$', 1), '/'), lambda s: s <> '')) AS depth FROM page_hosts
UNION ALL SELECT -1 - page_id, false, true, 2 FROM pp""")
def _(t):
    own = PG.url_kinds(t.product_pages)
    return PG.url_kinds(t.pages).unionByName(own.withColumn("page_id", -1 - F.col("page_id")))


@query("k03_link_graph", "SELECT page_id, from_url, position, to_url FROM page_links")
def _(t):
    return PG.links(t.pages).withColumn("position", F.col("position").cast("bigint"))


REACH = """
WITH RECURSIVE l AS (SELECT DISTINCT url AS from_url, 'https://store' || store_id || '.example/p/' || (part_id + i) AS to_url FROM pp, (VALUES (1), (2), (3)) x(i)
  UNION SELECT DISTINCT url, 'https://store' || store_id || '.example/shop/x' FROM pp UNION SELECT DISTINCT url, 'https://store' || store_id || '.example' || '/' FROM pp UNION SELECT DISTINCT url, url || '?page=2' FROM pp),
s AS (SELECT DISTINCT 'https://store' || store_id || '.example/p/' || part_id AS start_url FROM pp),
r AS (SELECT start_url, start_url AS url, 0 AS depth FROM s UNION SELECT r.start_url, l.to_url, r.depth + 1 FROM r JOIN l ON l.from_url = r.url WHERE r.depth < 3 AND (r.depth < 1 OR regexp_matches(l.to_url, '/(p|shop)/')))
SELECT start_url, url, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY 1, 2"""


@query("k04_frontier", REACH)
def _(t):
    edges = PG.links(t.product_pages).select("from_url", "to_url")
    starts = t.product_pages.select(F.concat(F.lit("https://store"), F.col("store_id").cast("string"), F.lit(".example/p/"), F.floor(F.col("page_id") / 5).cast("string")).alias("start_url"))
    return PG.reachable(edges, starts, 3).withColumn("depth", F.col("depth").cast("bigint"))


UNESC = "replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


def _inner(tag):
    inner = f"regexp_replace(regexp_extract(html, '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1), '<[^>]*>', '', 'g')"
    return f"nullif(trim(regexp_replace({UNESC.format(x=inner)}, '\\s+', ' ', 'g')), '')"


@query("k05_page_head", f"""
SELECT page_id, {_inner('title')} AS title, {_inner('h1')} AS h1, CAST(NULL AS VARCHAR) AS canonical_url, regexp_extract(html, '<html lang="([^"]*)"', 1) AS language FROM pages""")
def _(t):
    return PG.page_head(t.pages)


@query("k06_classify_page", """
SELECT page_id, CASE kind WHEN 0 THEN 'product' WHEN 1 THEN 'category' ELSE 'content' END AS page_type, CAST(CASE kind WHEN 0 THEN 0.65 WHEN 1 THEN 0.67 ELSE 0.32 END AS DOUBLE) AS confidence,
  CASE kind WHEN 0 THEN 'schema_product,' WHEN 1 THEN 'schema_product,schema_item_list,' ELSE '' END || 'repeated_product_cards(3),listing_controls,product_url' AS signals FROM pp
UNION ALL SELECT -1 - page_id, 'content', 0.25, '' FROM pages""")
def _(t):
    both = t.product_pages.select("page_id", "url", "html").unionByName(t.pages.select((-1 - F.col("page_id")).alias("page_id"), "url", "html"))
    return PG.classify_pages(both).withColumn("signals", F.array_join("signals", ","))


LOOSE = "(?i)" + "|".join(f"(?:{p})" for p in PG.LOOSE)


@query("k07_classify_response", f"""
SELECT page_id, CASE WHEN st IN (403, 429) THEN 'blocked' WHEN st IN (0, 404, 500) THEN 'http_error' WHEN regexp_matches(html, '{LOOSE}') THEN 'captcha' WHEN st = 200 AND length(html) < 1024 THEN 'suspicious' ELSE 'ok' END AS loose,
  CASE WHEN st IN (403, 429) THEN 'blocked' WHEN st IN (0, 404, 500) THEN 'http_error' ELSE 'ok' END AS strict FROM (SELECT *, [200, 200, 200, 403, 429, 500, 404, 0, 301][page_id % 9 + 1] AS st FROM pages)""")
def _(t):
    st = F.element_at(F.array(*[F.lit(x) for x in (200, 200, 200, 403, 429, 500, 404, 0, 301)]), (F.col("page_id") % 9 + 1).cast("int"))
    p = t.pages.withColumn("http_status", st)
    return p.select("page_id", PG.classify_response("http_status", "html").alias("loose"), PG.classify_response("http_status", "html", strict=True).alias("strict"))


FW = "list_max(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(html, '(?is){p.replace(chr(39), chr(39) * 2)}') THEN {{'s': {w}, 'o': {-i}, 'n': '{n}'}} END" for i, (n, w, p) in enumerate(PG.FRAMEWORKS)) + "], lambda x: x IS NOT NULL))"


@query("k08_detect_framework", f"""
SELECT page_id, coalesce(f.n, 'custom') AS framework, CAST(coalesce(f.s, 0.35) AS DOUBLE) AS confidence FROM (SELECT page_id, {FW} AS f FROM pages)
UNION ALL SELECT -1 - page_id, CASE kind WHEN 3 THEN 'nextjs' ELSE 'custom' END, CASE kind WHEN 3 THEN 0.72 ELSE 0.35 END FROM pp""")
def _(t):
    own = t.product_pages.select((-1 - F.col("page_id")).alias("page_id"), "html")
    return PG.detect_framework(t.pages.select("page_id", "html").unionByName(own))


@query("k09_structured_products", """
SELECT page_id, title, price, price + 100 AS old_price, 'EUR' AS currency, url AS product_url, '/img/' || page_id || '.jpg' AS image_url, availability, brand, sku, gtin FROM pp WHERE kind < 2""")
def _(t):
    return PG.structured_products(t.product_pages).drop("place", "from_list", "rating")


@query("k10_payload_products", """
SELECT page_id, 'next_data' AS source, title, price, 'EUR' AS currency, url AS product_url, sku, brand FROM pp WHERE kind = 3""")
def _(t):
    return PG.payload_products(t.product_pages).select("page_id", "source", "title", "price", "currency", "product_url", "sku", "brand")


@query("k11_meta_product", """
SELECT page_id, title, CASE WHEN kind = 2 THEN price END AS price, CASE WHEN kind = 2 THEN 'EUR' END AS currency, CASE WHEN kind = 2 THEN '/img/' || page_id || '.jpg' END AS image_url, CASE WHEN kind = 2 THEN availability END AS availability FROM pp""")
def _(t):
    return PG.meta_product(t.product_pages)


@query("k12_visible_text_product", """
SELECT page_id, title, price, price + 100 AS old_price, 'EUR' AS currency, availability FROM pp WHERE kind = 4""")
def _(t):
    return PG.text_product(t.product_pages)


K13 = f"""
SELECT page_id, title, price, CASE WHEN kind = 4 THEN price + 100 END AS old_price, 'EUR' AS currency, availability, CASE WHEN kind <> 4 THEN '/img/' || page_id || '.jpg' END AS image_url, 'mixed' AS source_path,
  CAST(CASE kind WHEN 0 THEN 1.0 WHEN 2 THEN 0.95 ELSE 0.9 END AS DOUBLE) AS confidence FROM pp WHERE kind IN (0, 2, 4)"""


@query("k13_extraction_cascade", K13)
def _(t):
    return PG.extract_products(t.product_pages).select("page_id", "title", "price", "old_price", "currency", "availability", "image_url", "source_path", "confidence")


@query("k14_field_confidence", """
SELECT page_id, CAST(0.7 AS DOUBLE) AS title_confidence, CAST(0.75 AS DOUBLE) AS price_confidence, CAST(0.6 AS DOUBLE) AS availability_confidence, CAST(CASE WHEN kind <> 4 THEN 0.6 END AS DOUBLE) AS image_url_confidence,
  CAST(CASE WHEN kind <> 4 THEN 0.663 ELSE 0.683 END AS DOUBLE) AS field_mean FROM pp WHERE kind IN (0, 2, 4)""")
def _(t):
    e = PG.extract_products(t.product_pages)
    return e.select("page_id", "title_confidence", "price_confidence", "availability_confidence", "image_url_confidence", "field_mean")


@query("k15_repeated_blocks", """
SELECT page_id, 'a|||' AS signature, CAST(6 AS BIGINT) AS members, true AS is_largest FROM pp UNION ALL SELECT page_id, 'div|product-card||', 3, false FROM pp UNION ALL SELECT page_id, 'p|||', 4, false FROM pp WHERE kind = 4""")
def _(t):
    return PG.repeated_blocks(t.product_pages)


@query("k16_merge_cards", """
SELECT page_id, title, price, CASE WHEN kind <> 4 THEN url END AS product_url, CASE WHEN kind < 2 THEN 'json-ld' WHEN kind = 3 THEN 'payload' ELSE 'text' END AS source, CAST(CASE WHEN kind < 2 THEN 0.95 WHEN kind = 3 THEN 0.85 ELSE 0.6 END AS DOUBLE) AS confidence FROM pp WHERE kind <> 2""")
def _(t):
    return PG.merge_cards(t.product_pages).select("page_id", "title", "price", "product_url", "source", "confidence")


@query("k16_card_stats", """
SELECT page_id, CAST(1 AS BIGINT) AS cards, CAST(CASE WHEN kind < 2 THEN 0.95 WHEN kind = 3 THEN 0.85 ELSE 0.6 END AS DOUBLE) AS confidence, CAST(kind < 2 AS BIGINT) AS structured, CAST(kind = 3 AS BIGINT) AS payload, CAST(kind = 4 AS BIGINT) AS text FROM pp WHERE kind <> 2""")
def _(t):
    return PG.card_stats(PG.merge_cards(t.product_pages))


@query("k17_categories", f"""
SELECT page_id, 'Item' AS name, 'Home / ' || brand AS path, CAST(NULL AS BIGINT) AS estimate, CAST(kind <> 2 AS BIGINT) AS products_found, CAST(CASE WHEN kind <> 2 THEN 0.85 ELSE 0.55 END AS DOUBLE) AS confidence FROM pp
UNION ALL SELECT -1 - page_id, {_inner('h1')}, array_to_string(list_filter(string_split(regexp_extract(bare, '^https?://[^/]+(.*)$', 1), '/'), lambda s: s <> ''), ' / '), NULL, 0, 0.55 FROM page_hosts""")
def _(t):
    own = PG.page_categories(t.product_pages, cards=True)
    return own.unionByName(PG.page_categories(t.pages.withColumn("page_id", -1 - F.col("page_id")))).drop("crumbs")


@query("k18_pagination_links", """
SELECT page_id, CAST(position AS BIGINT) AS position, CASE position WHEN 1 THEN url || '?page=2' WHEN 2 THEN 'https://store' || store_id || '.example/shop/x' ELSE 'https://store' || store_id || '.example/p/' || (part_id + position - 2) END AS to_url
FROM pp, (VALUES (1), (2), (3), (4), (5)) x(position)""")
def _(t):
    return PG.pagination(t.product_pages)


@query("k19_enrich_from_detail", """
SELECT page_id, title, price, CAST(CASE kind WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 3 THEN 0.85 ELSE 0.7 END AS DOUBLE) AS confidence, CASE kind WHEN 0 THEN 'product_detail' WHEN 1 THEN 'json-ld' WHEN 3 THEN 'payload' ELSE 'product_detail' END AS source FROM pp WHERE kind <> 2""")
def _(t):
    ident = F.concat(F.lit("page:"), F.col("page_id").cast("string"))
    cards = PG.merge_cards(t.product_pages).withColumn("normalized_url", ident)
    detail = PG.extract_products(t.product_pages).withColumn("normalized_url", ident).drop("page_id", "confidence")
    return PG.enrich_from_detail(cards, detail).select("page_id", "title", "price", S.rnd("confidence", 4).alias("confidence"), "source")


@query("k20_rendering_strategy", """
SELECT page_id, CASE kind WHEN 2 THEN 'js_heavy' WHEN 3 THEN 'hybrid' ELSE 'static_html' END AS strategy, CASE kind WHEN 2 THEN 'playwright_primary' WHEN 3 THEN 'playwright_fallback' ELSE 'cheerio' END AS scraping_mode,
  CAST(CASE kind WHEN 2 THEN 0.76 WHEN 3 THEN 0.72 ELSE 0.78 END AS DOUBLE) AS confidence, CASE kind WHEN 3 THEN 'nextjs' ELSE 'custom' END AS framework, CAST(kind <> 2 AS BIGINT) AS cards FROM pp""")
def _(t):
    return PG.rendering(t.product_pages)


@query("k21_scrape_profile", f"""
WITH p AS (SELECT regexp_extract(origin, '^https?://(.*)$', 1) AS host, regexp_matches(html, '(?i)cloudflare|cf-chl|akamai|perimeterx|datadome|hcaptcha|g-recaptcha|recaptcha|bot protection|just a moment') OR regexp_matches(html, '{LOOSE}') OR length(html) < 1024 AS b,
  length(trim(regexp_replace({UNESC.format(x="regexp_replace(regexp_replace(regexp_extract(html, '(?is)<body>(.*?)(?:</body>|$)', 1), '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')")}, '\\s+', ' ', 'g'))) < 600 AS js FROM page_hosts),
g AS (SELECT host, count(*) AS pages, bool_or(b) AS b, bool_or(js) AS js FROM p GROUP BY 1)
SELECT host, pages, CASE WHEN js THEN 'high' ELSE 'low' END AS crawl_difficulty, CASE WHEN b THEN 'high' ELSE 'low' END AS anti_bot_risk, CASE WHEN js THEN 'low' ELSE 'medium' END AS stability,
  CAST(CASE WHEN b THEN 10 WHEN js THEN 7 ELSE 5 END AS BIGINT) AS delay_seconds, CASE WHEN NOT b AND NOT js THEN 'balanced' ELSE 'safe' END AS crawl_preset FROM g""")
def _(t):
    return PG.scrape_profile(t.pages)


@query("k22_store_metadata", f"""
WITH p AS (SELECT *, regexp_replace(regexp_extract(origin, '^https?://(.*)$', 1), '^www\\.', '') AS domain FROM page_hosts), f AS (SELECT domain, page_id, html, trim(regexp_replace({_inner('h1')}, '\\s+(?:[|–—-])\\s+.*$', '')) AS nm, nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS language FROM p),
n AS (SELECT domain, arg_min(nm, page_id) FILTER (WHERE length(nm) BETWEEN 2 AND 80) AS nm, arg_min(language, page_id) FILTER (WHERE language IS NOT NULL) AS language,
  arg_min(CASE WHEN contains(html, '€') THEN 'EUR' WHEN contains(html, '$') THEN 'USD' ELSE 'GBP' END, page_id) FILTER (WHERE contains(html, '€') OR contains(html, '$') OR contains(html, '£')) AS money FROM f GROUP BY 1)
SELECT domain, CASE WHEN nm IS NULL OR length(nm) < 2 OR length(nm) > 80 THEN upper(regexp_replace(split_part(domain, '.', 1), '[-_]+', ' ', 'g')) ELSE nm END AS name,
  CASE language WHEN 'de' THEN 'DE' WHEN 'en' THEN 'US' WHEN 'fr' THEN 'FR' WHEN 'es' THEN 'ES' ELSE 'DE' END AS country_code,
  coalesce(money, 'EUR') AS currency, language FROM n""")
def _(t):
    return PG.store_metadata(t.pages)


@query("k23_clean_html", """
WITH c AS (SELECT page_id, length(html) AS original_chars, trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<body>(.*?)(?:</body>|$)', 1), '(?s)<!--.*?-->', '', 'g'), '\\s+', ' ', 'g'), '>\\s+<', '><', 'g')) AS cleaned FROM pages)
SELECT page_id, original_chars, cleaned, sha256(cleaned) AS hash, length(cleaned) AS cleaned_chars FROM c""")
def _(t):
    c = PG.clean_html(t.pages)
    return c.select("page_id", F.col("original_chars").cast("bigint").alias("original_chars"), "cleaned", "hash", F.col("cleaned_chars").cast("bigint").alias("cleaned_chars"))


@query("k24_replay_extraction", """
SELECT page_id, CASE WHEN kind IN (0, 2, 4) THEN 'ok' ELSE 'parse_failed' END AS status, CASE WHEN kind IN (0, 2, 4) THEN price END AS price,
  CASE WHEN kind NOT IN (0, 2, 4) THEN 'price,availability' ELSE concat_ws(',', CASE WHEN page_id % 3 = 0 THEN 'price' END, CASE WHEN availability = 'in_stock' THEN 'availability' END) END AS changed_fields FROM pp""")
def _(t):
    l = t.listings.select(F.col("listing_id").alias("page_id"), (F.coalesce("last_snapshot_price", F.lit(19.99).cast("decimal(12,2)")).cast("double") + F.when(F.col("listing_id") % 3 == 0, 1.0).otherwise(0.0)).alias("stored_price"),
                          F.lit("out_of_stock").alias("stored_availability"))
    return PG.replay(t.product_pages.join(l, "page_id")).select("page_id", "status", "price", F.array_join("changed_fields", ",").alias("changed_fields"))
