"""Matching queries (c05, c09, c10, c13-c15, e08, g05, i14-i18, j01-j09)."""

from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as X
from ..plans import matching as M
from ..plans import products as P
from .base import R, cte, query

STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"


def GRAMS(e):
    return (f"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({e}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), "
            f"lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))")


def SIM(a, b):
    return f"(CAST(len(list_intersect({a}, {b})) AS DOUBLE) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))))"


def TOKENS(e):
    return f"list_filter(regexp_split_to_array(lower(trim(regexp_replace(regexp_replace({e}, '[|/,_:;()\\[\\]{{}}]+', ' ', 'g'), '\\s+', ' ', 'g'))), '[^a-z0-9]+'), lambda x: length(x) > 1 AND NOT list_contains({STOP}, x))"


def KEYOF(title, brand):
    tk = TOKENS(f"coalesce({brand}, '') || ' ' || coalesce({title}, '')")
    return f"array_to_string(list_filter({tk}, lambda x, i: list_position({tk}, x) = i), '-')"


cte("own_titles", f"SELECT DISTINCT org_id, name AS title, {GRAMS('name')} AS g FROM my_products")
cte("seen_titles", f"SELECT DISTINCT org_id, title, {GRAMS('title')} AS g FROM listings WHERE title IS NOT NULL")
cte("title_sims", f"""
SELECT a.org_id, a.title AS left_title, b.title AS right_title, {SIM('a.g', 'b.g')} AS similarity FROM own_titles a JOIN seen_titles b USING (org_id)""")


@query("c09_theta_similarity", f"SELECT org_id, left_title, right_title, {R('similarity', 6)} AS similarity FROM title_sims WHERE similarity >= 0.5")
def _(t):
    return M.similarity_join(t, 0.5).select("org_id", "left_title", "right_title", S.rnd("similarity", 6).alias("similarity"))


@query("c10_cross_single_source", f"""
SELECT org_id, listing_id, title, {R('sim', 6)} AS similarity FROM (SELECT l.org_id, l.listing_id, l.title, {SIM('s.g', GRAMS("'small red ring'"))} AS sim FROM listings l JOIN seen_titles s USING (org_id, title)) WHERE sim >= 0.2""")
def _(t):
    return M.single_source_candidates(t, "small red ring")


@query("i17_trigram_similarity", f"""
SELECT DISTINCT title, brand, {R(SIM(GRAMS('title'), GRAMS("title || ' ' || brand")), 6)} AS similarity FROM listings WHERE title IS NOT NULL""")
def _(t):
    d = t.listings.where(F.col("title").isNotNull()).select("title", "brand").distinct()
    return d.withColumn("similarity", S.rnd(X.trigram_similarity("title", F.concat_ws(" ", "title", "brand")), 6))


EXACT = """
SELECT p.org_id, p.product_id, l.listing_id, 'gtin' AS method, CAST(0.99 AS DOUBLE) AS confidence FROM my_products p JOIN listings l ON l.org_id = p.org_id AND l.gtin = p.gtin
UNION ALL SELECT p.org_id, p.product_id, l.listing_id, 'sku', 0.95 FROM my_products p JOIN listings l ON l.org_id = p.org_id AND lower(l.sku) = lower(p.sku)"""


@query("j01_exact_matches", EXACT)
def _(t):
    return M.exact_matches(t)


SUGG = f"""
SELECT org_id, product_id, listing_id, arg_max(method, confidence) AS method, {R('max(confidence)', 3)} AS confidence FROM (
SELECT * FROM ({EXACT}) QUALIFY row_number() OVER (PARTITION BY org_id, method ORDER BY product_id, listing_id) <= 200
UNION ALL SELECT org_id, product_id, listing_id, 'title_similarity', least(0.85, similarity) FROM (
  SELECT p.org_id, p.product_id, l.listing_id, s.similarity FROM title_sims s JOIN my_products p ON p.org_id = s.org_id AND p.name = s.left_title
  JOIN listings l ON l.org_id = s.org_id AND l.title = s.right_title WHERE s.similarity >= 0.5
  QUALIFY row_number() OVER (PARTITION BY p.org_id ORDER BY s.similarity DESC, p.product_id, l.listing_id) <= 200)) GROUP BY 1, 2, 3"""


@query("j02_match_suggestions", SUGG)
def _(t):
    return M.suggestions(t)


@query("g05_union_matches", f"SELECT org_id, method, count(*) AS n FROM ({SUGG}) GROUP BY 1, 2")
def _(t):
    return M.suggestions(t).groupBy("org_id", "method").agg(F.count(F.lit(1)).alias("n"))


@query("j03_persist_suggestions", f"""
SELECT org_id, product_id, listing_id, method, confidence, 'suggested' AS status FROM ({SUGG}) s WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.product_id = s.product_id AND m.listing_id = s.listing_id)""")
def _(t):
    return M.persist_suggestions(M.suggestions(t), t.matches)


@query("c05_anti_decided_pairs", f"""
SELECT * FROM ({EXACT}) e WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.status IN ('confirmed','rejected') AND m.product_id = e.product_id AND m.listing_id = e.listing_id)""")
def _(t):
    return M.without_decided(M.exact_matches(t), t.matches)


cte("pairs_c", """
SELECT l.org_id, p.product_id, l.listing_id, p.name AS my_title, p.brand AS my_brand, p.sku AS my_sku, p.gtin AS my_gtin, l.title AS other_title, l.brand AS other_brand, l.sku AS other_sku, l.gtin AS other_gtin
FROM listings l JOIN my_products p ON p.org_id = l.org_id AND p.part_id = l.part_id + (CASE WHEN l.store_id < 2 THEN 1 WHEN l.store_id = 2 THEN 0 ELSE 2 END) WHERE l.title IS NOT NULL""")


def _pairs(t):
    l = t.listings.where(F.col("title").isNotNull())
    shift = F.when(F.col("store_id") < 2, 1).when(F.col("store_id") == 2, 0).otherwise(2)
    l = l.select("org_id", "listing_id", ((F.floor(F.col("listing_id") / 5) + shift) * 2 + F.col("org_id")).alias("product_id"), *[F.col(c).alias(f"other_{c}") for c in ("title", "brand", "sku", "gtin")])
    own = t.my_products.select("product_id", F.col("name").alias("my_title"), *[F.col(c).alias(f"my_{c}") for c in ("brand", "sku", "gtin")])
    return l.join(own, "product_id")


_A, _B = TOKENS("my_title"), TOKENS("other_title")
SCORES = f"""
WITH x AS (SELECT *, CASE WHEN len({_A}) = 0 OR len({_B}) = 0 THEN 0 ELSE CAST(len(list_intersect({_A}, {_B})) AS DOUBLE) / greatest(len(list_distinct({_A})), len(list_distinct({_B}))) END AS ts,
  coalesce(lower(my_brand) = lower(other_brand), false) AS bm, coalesce(my_gtin = other_gtin, false) AS gm, coalesce(lower(my_sku) = lower(other_sku), false) AS sm FROM pairs_c)
SELECT org_id, product_id, listing_id, CAST(CASE WHEN gm THEN 0.99 WHEN sm THEN 0.95 ELSE {R('least(0.92, ts * 0.55 + CASE WHEN bm THEN 0.18 ELSE 0 END)', 3)} END AS DOUBLE) AS score,
  CASE WHEN gm THEN 'gtin' WHEN sm THEN 'sku' WHEN bm AND ts >= 0.45 THEN 'brand_model' WHEN 0 > ts THEN 'spec_similarity' ELSE 'title_similarity' END AS method,
  CASE WHEN gm THEN 'GTIN exact match' WHEN sm THEN 'SKU exact match' ELSE concat_ws('; ', CASE WHEN ts >= 0.55 THEN 'Title token overlap ' || format('{{:.2f}}', ts) END, CASE WHEN bm THEN 'Brand exact match' END) END AS reasons FROM x"""


@query("j04_match_scores", SCORES)
def _(t):
    s = M.score_pairs(_pairs(t))
    return s.select("org_id", "product_id", "listing_id", "score", "method", F.array_join("reasons", "; ").alias("reasons"))


@query("i16_title_overlap", f"""
SELECT DISTINCT my_title, other_title, {R(f"CASE WHEN len({_A}) = 0 OR len({_B}) = 0 THEN 0 ELSE CAST(len(list_intersect({_A}, {_B})) AS DOUBLE) / greatest(len(list_distinct({_A})), len(list_distinct({_B}))) END", 6)} AS overlap FROM pairs_c""")
def _(t):
    return _pairs(t).select("my_title", "other_title").distinct().withColumn("overlap", S.rnd(X.title_overlap("my_title", "other_title"), 6))


@query("i15_product_key", f"SELECT listing_id, {KEYOF('title', 'brand')} AS product_key FROM listings")
def _(t):
    return t.listings.select("listing_id", X.product_key("title", "brand").alias("product_key"))


@query("i14_normalise_title", """
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(text), '[®©]|["''`´]', '', 'g'), '[|/,_:;()\\[\\]{}]+', ' ', 'g'), '[\\s\\x{00A0}\\x{000B}]+', ' ', 'g')) AS title FROM documents""")
def _(t):
    return t.tracking_source.select("doc_id", X.normalise_title("text").alias("title"))


CAND = f"""
WITH src AS (SELECT p.*, s.title, s.store_id, s.listing_id, s.brand AS lbrand, s.sku AS lsku, s.gtin AS lgtin, coalesce(x.similarity, 0) AS sim
  FROM my_products p JOIN listings s ON s.org_id = p.org_id LEFT JOIN title_sims x ON x.org_id = p.org_id AND x.left_title = p.name AND x.right_title = s.title
  WHERE (x.similarity >= 0.2 OR s.gtin = p.gtin OR lower(s.sku) = lower(p.sku))),
ok AS (SELECT *, coalesce(lgtin = gtin, false) AS gm, coalesce(lower(lsku) = lower(sku), false) AS sm, coalesce(lower(lbrand) = lower(brand), false) AS bm FROM src
  WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.status IN ('confirmed','rejected') AND m.product_id = src.product_id AND m.listing_id = src.listing_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY product_id, store_id ORDER BY CASE WHEN gm THEN 1 WHEN sm THEN 2 ELSE 3 END, round(sim, 9) DESC, listing_id) AS position FROM ok QUALIFY position <= 6)
SELECT org_id, product_id, store_id, listing_id, position, CAST(CASE WHEN gm THEN 0.99 WHEN sm THEN 0.95 ELSE {R('least(0.92, sim + CASE WHEN bm THEN 0.12 ELSE 0 END)', 3)} END AS DOUBLE) AS similarity,
  CASE WHEN gm THEN 'gtin' WHEN sm THEN 'sku' WHEN bm AND sim >= 0.35 THEN 'brand_model' ELSE 'title_similarity' END AS method FROM rk"""


@query("j05_cross_store_candidates", CAND)
def _(t):
    return M.cross_store_candidates(t)


@query("e08_topk_per_store", """
SELECT org_id, store_id, brand, listing_id, position FROM (SELECT *, row_number() OVER (PARTITION BY store_id, brand ORDER BY CASE WHEN gtin IS NOT NULL THEN 1 ELSE 2 END, last_snapshot_price DESC NULLS LAST, listing_id) AS position FROM listings) WHERE position <= 6""")
def _(t):
    from ..operators.ordered import top_k

    cls = F.when(F.col("gtin").isNotNull(), 1).otherwise(2)
    return top_k(t.listings, ["store_id", "brand"], [cls, F.desc_nulls_last("last_snapshot_price"), F.asc("listing_id")], 6, rank="position").select("org_id", "store_id", "brand", "listing_id", "position")


@query("j06_decide_match", """
WITH d AS (SELECT org_id, listing_id // 5 * 2 + org_id AS product_id, listing_id, CASE availability WHEN 'in_stock' THEN 'confirmed' ELSE 'rejected' END AS status, scraped_at AS decided_at FROM snapshots WHERE status = 'captcha'
  QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY scraped_at DESC, CASE availability WHEN 'in_stock' THEN 'confirmed' ELSE 'rejected' END DESC) = 1)
SELECT coalesce(m.org_id, d.org_id) AS org_id, coalesce(m.product_id, d.product_id) AS product_id, coalesce(m.listing_id, d.listing_id) AS listing_id, coalesce(m.method, 'manual') AS method, CAST(coalesce(m.confidence, 1) AS DOUBLE) AS confidence,
  coalesce(d.status, m.status) AS status, coalesce(d.decided_at, m.decided_at) AS decided_at FROM matches m FULL JOIN d ON d.product_id = m.product_id AND d.listing_id = m.listing_id""")
def _(t):
    d = t.snapshots.where(F.col("status") == "captcha").select(
        "org_id", (F.floor(F.col("listing_id") / 5) * 2 + F.col("org_id")).alias("product_id"), "listing_id",
        F.when(F.col("availability") == "in_stock", "confirmed").otherwise("rejected").alias("status"), F.col("scraped_at").alias("decided_at"))
    return M.apply_decisions(t.matches, d).withColumn("confidence", S.dbl("confidence"))


@query("j07_match_by_url", """
WITH r AS (SELECT org_id, store_id, listing_id AS source_id, CASE WHEN listing_id % 2 = 0 THEN 'listing' ELSE 'product' END AS kind, url || CASE WHEN listing_id % 3 = 0 THEN '?new' ELSE '' END AS url, last_snapshot_price AS price FROM listings)
SELECT 'listings' AS part, count(DISTINCT (store_id, url)) FILTER (WHERE source_id % 3 = 0) AS n FROM r
UNION ALL SELECT 'snapshots', count(*) FILTER (WHERE price IS NOT NULL) FROM r
UNION ALL SELECT 'products', count(*) FILTER (WHERE kind = 'listing') FROM r
UNION ALL SELECT 'matches', count(*) FROM (SELECT DISTINCT kind, source_id, CASE WHEN source_id % 3 = 0 THEN url ELSE CAST(k.id AS VARCHAR) END FROM r JOIN (SELECT store_id AS s, url AS u, min(listing_id) AS id FROM listings GROUP BY 1, 2) k ON k.s = store_id AND k.u = replace(r.url, '?new', '')
  UNION SELECT DISTINCT kind, source_id, CAST(source_id AS VARCHAR) FROM r WHERE kind = 'listing')""")
def _(t):
    rows = t.listings.select(
        "org_id", "store_id", F.col("listing_id").alias("source_id"), F.when(F.col("listing_id") % 2 == 0, "listing").otherwise("product").alias("source_kind"),
        F.concat("url", F.when(F.col("listing_id") % 3 == 0, "?new").otherwise("")).alias("url"), "title", F.col("last_snapshot_price").alias("price"),
        F.col("last_snapshot_availability").alias("availability"), F.col("last_scraped_at").alias("observed_at"))
    parts = M.match_by_url(rows, t)
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("j08_discovered_dedup", """
WITH RECURSIVE p AS (SELECT d.*, s.org_id FROM discovery_products d JOIN stores s USING (store_id)),
k AS (SELECT org_id, run_id, product_id, 'url:' || normalized_url AS key FROM p UNION ALL SELECT org_id, run_id, product_id, 'sku:' || sku FROM p WHERE sku IS NOT NULL
  UNION ALL SELECT org_id, run_id, product_id, 'gtin:' || gtin FROM p WHERE gtin IS NOT NULL UNION ALL SELECT org_id, run_id, product_id, 'ean:' || ean FROM p WHERE ean IS NOT NULL),
e AS (SELECT DISTINCT a.product_id AS a, b.product_id AS b FROM k a JOIN k b USING (org_id, run_id, key)),
reach AS (SELECT product_id AS a, product_id AS b FROM discovery_products UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
c AS (SELECT a AS product_id, min(b) AS component FROM reach GROUP BY 1)
SELECT component, min(org_id) AS org_id, min(run_id) AS run_id, count(*) AS merged_rows, arg_min(title, product_id) FILTER (WHERE title IS NOT NULL) AS title, CAST(arg_min(price, product_id) FILTER (WHERE price IS NOT NULL) AS DOUBLE) AS price,
  arg_min(sku, product_id) FILTER (WHERE sku IS NOT NULL) AS sku, arg_min(gtin, product_id) FILTER (WHERE gtin IS NOT NULL) AS gtin, arg_min(ean, product_id) FILTER (WHERE ean IS NOT NULL) AS ean,
  CAST(max(confidence) AS DOUBLE) AS confidence, CASE WHEN bool_or(store_id = 0) THEN 'product_detail' ELSE 'json-ld' END AS source, CASE WHEN bool_or(price IS NULL) THEN 'incomplete_card' ELSE '' END AS errors
FROM p JOIN c USING (product_id) GROUP BY 1""")
def _(t):
    d = M.dedupe_products(t.discovery_products.join(t.stores.select("store_id", "org_id"), "store_id"))
    return d.select("component", "org_id", "run_id", "merged_rows", "title", S.dbl("price").alias("price"), "sku", "gtin", "ean", "confidence", "source", F.coalesce(F.array_join("errors", ","), F.lit("")).alias("errors"))


@query("j09_normalised_products", f"""
SELECT org_id, {KEYOF('canonical_title', 'brand')} AS normalized_key, arg_min(canonical_title, (-confidence, entity_id)) AS canonical_title, arg_min(brand, (-confidence, entity_id)) AS brand, CAST(max(confidence) AS DOUBLE) AS confidence,
  count(*) AS entities, arg_min(entity_id, (-confidence, entity_id)) AS leading_entity FROM entities_c GROUP BY 1, 2""")
def _(t):
    return M.normalised_products(P.product_entities(t, False))


@query("j09_aliases", f"""
SELECT m.org_id, {KEYOF('e.canonical_title', 'e.brand')} AS normalized_key, m.title AS alias, count(*) AS listings FROM members_c m JOIN entities_c e USING (entity_id) WHERE m.title IS NOT NULL GROUP BY 1, 2, 3""")
def _(t):
    return M.product_aliases(P.members(t), P.product_entities(t, False))


@query("j09_specifications", f"""
SELECT org_id, normalized_key, brand, regexp_extract(canonical_title, '\\b(red|blue|green|black|white|grey|gray|silver|gold|rot|schwarz|weiss|blau|grun)\\b', 1) AS colour FROM (
SELECT org_id, {KEYOF('canonical_title', 'brand')} AS normalized_key, arg_min(canonical_title, (-confidence, entity_id)) AS canonical_title, arg_min(brand, (-confidence, entity_id)) AS brand FROM entities_c GROUP BY 1, 2)""")
def _(t):
    s = M.product_specifications(M.normalised_products(P.product_entities(t, False)))
    return s.select("org_id", "normalized_key", "brand", F.coalesce("colour", F.lit("")).alias("colour"))


@query("j09_matching_logs", f"""
SELECT org_id, product_id, listing_id, 'suggested' AS action, method, score FROM ({SCORES})""")
def _(t):
    return M.matching_logs(M.score_pairs(_pairs(t))).drop("reasons")


SPEC_TEXT = "p_name || ' Bosch Performance CX ' || (300 + p_size * 10) || ' Wh ' || (CASE p_size % 3 WHEN 0 THEN '28 Zoll' WHEN 1 THEN '27.5 inch' ELSE '29\"' END) || ' ' || (2000 + p_size % 40) || ' ' || (80 + p_size) || ' mm ' || (CASE p_size % 4 WHEN 0 THEN 'Trekking' WHEN 1 THEN 'E-MTB' WHEN 2 THEN 'Gravel' ELSE 'Rennrad' END) || ' Alu 2' || (p_size % 10) || ',5 kg Shimano XT'"


@query("i18_specs", """
SELECT p_partkey AS product_id, 2000 + p_size % 40 AS year, 300 + p_size * 10 AS battery_wh, CASE p_size % 3 WHEN 0 THEN '28"' WHEN 1 THEN '27.5"' ELSE '29"' END AS wheel_size, 80 + p_size AS travel_mm,
  CAST(20 + p_size % 10 + 0.5 AS DOUBLE) AS weight_kg, 'bosch performance cx' AS motor, 'shimano xt' AS brakes, 'aluminium' AS frame_material, CASE p_size % 4 WHEN 0 THEN 'trekking' WHEN 1 THEN 'e-mtb' WHEN 2 THEN 'gravel' ELSE 'road' END AS bike_type,
  CASE WHEN p_name LIKE 'red %' THEN 'red' WHEN p_name LIKE 'blue %' THEN 'blue' WHEN p_name LIKE 'green %' THEN 'green' END AS colour FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, p_name FROM part)""")
def _(t):
    p = t.parts.withColumn("txt", F.expr(SPEC_TEXT.replace("29\"'", "29\"'")))
    s = p.select(F.col("p_partkey").alias("product_id"), X.specs("txt", "p_brand").alias("s")).select("product_id", "s.*")
    ints = {c: F.col(c).cast("bigint") for c in ("year", "battery_wh", "travel_mm")}
    return s.withColumns(ints).select("product_id", "year", "battery_wh", "wheel_size", "travel_mm", "weight_kg", "motor", "brakes", "frame_material", "bike_type", "colour")


@query("c13_match_review", """
SELECT m.org_id, m.position, m.match_id, p.name AS my_name, p.sku AS my_sku, l.title AS listing_title, l.url, s.name AS store_name, m.method, CAST(m.confidence AS DOUBLE) AS confidence FROM
(SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY confidence DESC, created_at DESC, match_id) AS position FROM matches WHERE status = 'suggested' QUALIFY position <= 200) m
JOIN my_products p USING (product_id) JOIN listings l ON l.listing_id = m.listing_id JOIN stores s ON s.store_id = l.store_id""")
def _(t):
    return M.match_review(t)


@query("c14_prior_good_value", """
SELECT f.snapshot_id, f.listing_id, f.scraped_at, f.status, o.scraped_at AS prior_at, CAST(o.price AS DOUBLE) AS prior_price, o.availability AS prior_availability FROM (SELECT * FROM snapshots WHERE status <> 'ok') f
LEFT JOIN (SELECT f.snapshot_id AS fid, arg_max(o.snapshot_id, (o.scraped_at, o.snapshot_id)) AS oid FROM snapshots f JOIN snapshots o USING (listing_id) WHERE f.status <> 'ok' AND o.status = 'ok' AND (o.scraped_at, o.snapshot_id) < (f.scraped_at, f.snapshot_id) GROUP BY 1) m ON m.fid = f.snapshot_id
LEFT JOIN snapshots o ON o.snapshot_id = m.oid""")
def _(t):
    return M.prior_ok(t)


@query("c15_url_lookup", "SELECT product_id, run_id, run_id || '|' || category_url AS category_id FROM discovery_products")
def _(t):
    return M.category_of_discovered(t.discovery_products, t.discovery_categories).select("product_id", "run_id", "category_id")
