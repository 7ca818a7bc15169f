"""Product matching: exact and similar pairs, suggestions, candidates, decisions and de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as X
from ..functions import urls as U
from ..operators.components import components
from ..operators.ordered import latest_per_key, top_k
from ..operators.similarity import distinct_titles, similar_titles
from ..operators.writes import append_if_absent, first_per_key, upsert
from ..sources.catalog import Tables

PAIR = ["org_id", "product_id", "listing_id"]


def similarity_join(t: Tables, threshold: float = 0.5) -> DataFrame:
    """Similar (own name, listing title) pairs at title level."""
    return similar_titles(distinct_titles(t.my_products, "name"), distinct_titles(t.listings, "title"), threshold)


def exact_matches(t: Tables) -> DataFrame:
    own = t.my_products.select("org_id", "product_id", F.col("gtin").alias("k_gtin"), F.lower("sku").alias("k_sku"))
    seen = t.listings.select("org_id", "listing_id", F.col("gtin").alias("k_gtin"), F.lower("sku").alias("k_sku"))
    pair = lambda key, name, conf: own.where(F.col(key).isNotNull()).join(seen.where(F.col(key).isNotNull()), ["org_id", key]).select(
        *PAIR, F.lit(name).alias("method"), F.lit(conf).alias("confidence"))
    return pair("k_gtin", "gtin", 0.99).unionByName(pair("k_sku", "sku", 0.95))


def top_similar_pairs(t: Tables, k: int, threshold: float = 0.5) -> DataFrame:
    """The ``k`` most similar (product, listing) pairs per tenant, exactly, without building all pairs.

    Pairs of one title pair are ordered by ids, so its first ``k`` need only ``k`` ids of either side.
    """
    sims = similarity_join(t, threshold)
    def ids(df, title, key, prefix):
        first = top_k(df.where(F.col(title).isNotNull()).select("org_id", F.col(title).alias(f"{prefix}_title"), key), ["org_id", f"{prefix}_title"], [F.asc(key)], k, rank=f"{prefix}_rank")
        return first
    own, seen = ids(t.my_products, "name", "product_id", "left"), ids(t.listings, "title", "listing_id", "right")
    width = seen.groupBy("org_id", "right_title").agg(F.count(F.lit(1)).alias("width"))
    j = sims.join(width, ["org_id", "right_title"]).join(own, ["org_id", "left_title"]).where((F.col("left_rank") - 1) * F.col("width") < k)
    j = j.join(seen, ["org_id", "right_title"]).where((F.col("left_rank") - 1) * F.col("width") + F.col("right_rank") <= k)
    return top_k(j.select(*PAIR, "similarity"), ["org_id"], [F.desc("similarity"), F.asc("product_id"), F.asc("listing_id")], k)


def suggestions(t: Tables, k: int = 200, threshold: float = 0.5) -> DataFrame:
    """GTIN, SKU and title suggestions (``k`` of each per tenant); the best method of a pair is kept."""
    exact = top_k(exact_matches(t), ["org_id", "method"], [F.asc("product_id"), F.asc("listing_id")], k)
    fuzzy = top_similar_pairs(t, k, threshold).select(
        *PAIR, F.lit("title_similarity").alias("method"), F.least(F.lit(0.85), F.col("similarity")).alias("confidence"))
    best = exact.unionByName(fuzzy).groupBy(*PAIR).agg(F.max_by("method", "confidence").alias("method"), S.rnd(F.max("confidence"), 3).alias("confidence"))
    return best


def persist_suggestions(found: DataFrame, matches: DataFrame) -> DataFrame:
    new = found.withColumn("status", F.lit("suggested"))
    return append_if_absent(new, matches, ["product_id", "listing_id"])


def without_decided(cand: DataFrame, matches: DataFrame) -> DataFrame:
    decided = matches.where(F.col("status").isin("confirmed", "rejected"))
    return cand.join(decided.select("product_id", "listing_id"), ["product_id", "listing_id"], "left_anti")


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Weighted score of pairs with my_* and other_* columns (title, brand, sku, gtin)."""
    low = lambda c: F.lower(F.nullif(F.col(c), F.lit("")))
    gtin = F.coalesce(F.nullif(F.col("my_gtin"), F.lit("")) == F.col("other_gtin"), F.lit(False))
    sku = F.coalesce(low("my_sku") == low("other_sku"), F.lit(False))
    brand = F.coalesce(low("my_brand") == low("other_brand"), F.lit(False))
    p = pairs.withColumns({
        "title_score": X.title_overlap("my_title", "other_title"), "brand_match": brand, "gtin_match": gtin, "sku_match": sku,
        "_a": X.specs("my_title", "my_brand"), "_b": X.specs("other_title", "other_brand"),
    })
    p = p.withColumn("spec_score", X.spec_similarity(F.col("_a"), F.col("_b"))).drop("_a", "_b")
    mixed = F.least(F.lit(0.92), F.col("title_score") * 0.55 + F.when(F.col("brand_match"), 0.18).otherwise(0.0) + F.col("spec_score") * 0.27)
    score = F.when(F.col("gtin_match"), 0.99).when(F.col("sku_match"), 0.95).otherwise(S.rnd(mixed, 3))
    method = (
        F.when(F.col("gtin_match"), "gtin").when(F.col("sku_match"), "sku").when(F.col("brand_match") & (F.col("title_score") >= 0.45), "brand_model")
        .when(F.col("spec_score") > F.col("title_score"), "spec_similarity").otherwise("title_similarity")
    )
    two = lambda c: F.format_string("%.2f", S.rnd(c, 2))
    soft = F.array_compact(F.array(
        F.when(F.col("title_score") >= 0.55, F.concat(F.lit("Title token overlap "), two("title_score"))),
        F.when(F.col("brand_match"), F.lit("Brand exact match")),
        F.when(F.col("spec_score") >= 0.4, F.concat(F.lit("Spec similarity "), two("spec_score"))),
    ))
    reasons = F.when(F.col("gtin_match"), F.array(F.lit("GTIN exact match"))).when(F.col("sku_match"), F.array(F.lit("SKU exact match"))).otherwise(soft)
    return p.withColumns({"score": score, "method": method, "reasons": reasons})


def cross_store_candidates(t: Tables, sources: DataFrame | None = None, min_sim: float = 0.2, k: int = 6) -> DataFrame:
    """For each own product the ``k`` best listings per store by GTIN, SKU and title, minus decided pairs.

    Title candidates are cut before pairing: of every similarity level of a title only as many listings can
    matter as ``k`` plus the pairs already decided for the product in that store.
    """
    src = (t.my_products if sources is None else sources).select("org_id", "product_id", F.col("name").alias("left_title"), F.col("brand").alias("s_brand"), F.col("sku").alias("s_sku"), F.col("gtin").alias("s_gtin"))
    l = t.listings.select("org_id", "store_id", "listing_id", "title", "url", "brand", "sku", "gtin")
    decided = t.matches.where(F.col("status").isin("confirmed", "rejected")).select("product_id", "listing_id").distinct()
    per_store = decided.join(l.select("listing_id", "store_id"), "listing_id").groupBy("product_id", "store_id").agg(F.count(F.lit(1)).alias("decided"))

    titled = l.where(F.col("title").isNotNull())
    sims = similar_titles(src.select("org_id", F.col("left_title").alias("title")).distinct(), distinct_titles(t.listings, "title"), min_sim)
    sims = sims.withColumn("level", F.round("similarity", 9))
    sizes = titled.groupBy("org_id", "store_id", F.col("title").alias("right_title")).agg(F.count(F.lit(1)).alias("n"))
    levels = sims.join(sizes, ["org_id", "right_title"]).groupBy("org_id", "left_title", "store_id", "level").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("org_id", "left_title", "store_id").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn("better", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    wanted = src.select("org_id", "product_id", "left_title").join(levels, ["org_id", "left_title"])
    wanted = wanted.join(per_store, ["product_id", "store_id"], "left").withColumn("room", F.lit(k) + F.coalesce("decided", F.lit(0)))
    wanted = wanted.where(F.col("better") < F.col("room")).select("org_id", "product_id", "left_title", "store_id", "level", "room")
    # a product takes at most ``room`` listings of a title, so only the first few ids of every title can matter
    most = per_store.agg(F.max("decided")).first()[0] or 0
    placed = top_k(titled.withColumnRenamed("title", "right_title"), ["org_id", "store_id", "right_title"], [F.asc("listing_id")], k + most, rank="place")
    placed = placed.select("org_id", "store_id", "right_title", "place", "listing_id")
    titles = wanted.join(sims.select("org_id", "left_title", "level", "right_title"), ["org_id", "left_title", "level"])
    fuzzy = titles.join(placed, ["org_id", "store_id", "right_title"]).where(F.col("place") <= F.col("room")).select("product_id", "listing_id")

    key = lambda s, c, fold=lambda x: x: src.where(F.col(s).isNotNull()).select("org_id", "product_id", fold(F.col(s)).alias("k")).join(
        l.where(F.col(c).isNotNull()).select("org_id", "listing_id", fold(F.col(c)).alias("k")), ["org_id", "k"]).select("product_id", "listing_id")
    pairs = fuzzy.unionByName(key("s_gtin", "gtin")).unionByName(key("s_sku", "sku", F.lower)).distinct()
    pairs = pairs.join(decided, ["product_id", "listing_id"], "left_anti")
    j = pairs.join(src, "product_id").join(l.drop("org_id"), "listing_id")
    same = lambda a, b: F.coalesce(F.lower(a) == F.lower(b), F.lit(False))
    j = j.withColumns({
        "title_sim": X.trigram_similarity(F.coalesce("title", F.lit("")), F.col("left_title")),
        "gtin_match": F.coalesce(F.col("gtin") == F.col("s_gtin"), F.lit(False)), "sku_match": same("sku", "s_sku"), "brand_match": same("brand", "s_brand"),
    })
    cls = F.when(F.col("gtin_match"), 1).when(F.col("sku_match"), 2).otherwise(3)
    ranked = top_k(j, ["product_id", "store_id"], [cls, F.round("title_sim", 9).desc(), F.asc("listing_id")], k, rank="position")
    sim = F.when(F.col("gtin_match"), 0.99).when(F.col("sku_match"), 0.95).otherwise(F.least(F.lit(0.92), F.col("title_sim") + F.when(F.col("brand_match"), 0.12).otherwise(0.0)))
    method = F.when(F.col("gtin_match"), "gtin").when(F.col("sku_match"), "sku").when(F.col("brand_match") & (F.col("title_sim") >= 0.35), "brand_model").otherwise("title_similarity")
    return ranked.select("org_id", "product_id", "store_id", "listing_id", "position", S.rnd(sim, 3).alias("similarity"), method.alias("method"))


def single_source_candidates(t: Tables, title: str, min_sim: float = 0.2) -> DataFrame:
    """Listings similar to one given title: the source becomes a constant, so no join is needed."""
    sim = X.trigram_similarity(F.coalesce("title", F.lit("")), F.lit(title))
    return t.listings.withColumn("similarity", S.rnd(sim, 6)).where(F.col("similarity") >= min_sim).select("org_id", "listing_id", "title", "similarity")


def apply_decisions(matches: DataFrame, decisions: DataFrame) -> DataFrame:
    """Newest decision per pair wins.  A pair decided by hand that did not exist becomes a manual match."""
    newest = latest_per_key(decisions, ["org_id", "product_id", "listing_id"], ["status", "decided_at"], ["decided_at", "status"])
    merged = upsert(matches.select(*PAIR, "method", "confidence", "status", "decided_at"), newest, PAIR)
    return merged.withColumns({"method": F.coalesce("method", F.lit("manual")), "confidence": F.coalesce("confidence", F.lit(1.0).cast("decimal(4,3)"))})


def match_by_url(rows: DataFrame, t: Tables) -> dict[str, DataFrame]:
    """Named URLs become listings (if new), observations and confirmed matches.

    ``rows``: org_id, store_id, source_id, source_kind ('product' or 'listing'), url, title, price, availability, observed_at.
    A source that is a listing is promoted to an own product first.
    """
    r = rows.withColumn("url_hash", U.url_hash("url"))
    known = t.listings.select("org_id", "store_id", "url_hash", F.col("listing_id").alias("known_id"))
    known = known.groupBy("org_id", "store_id", "url_hash").agg(F.min("known_id").alias("known_id"))
    r = r.join(known, ["org_id", "store_id", "url_hash"], "left")
    # a new listing gets an id that follows from its identity, so a repeated run yields the same id
    new_id = F.xxhash64("org_id", "store_id", "url_hash")
    r = r.withColumn("listing_id", F.coalesce("known_id", new_id))
    fresh = first_per_key(r.where(F.col("known_id").isNull()).select("listing_id", "org_id", "store_id", "url", "url_hash", "title", F.col("price").alias("last_snapshot_price"),
                          F.col("availability").alias("last_snapshot_availability"), F.col("observed_at").alias("last_scraped_at")), ["listing_id"], ["last_scraped_at", "url"])
    obs = r.where(F.col("price").isNotNull()).select("listing_id", "org_id", "store_id", F.col("observed_at").alias("scraped_at"), "price",
                  F.coalesce(X.schema_availability("availability"), F.lit("unknown")).alias("availability"), F.lit("ok").alias("status"))
    promoted = r.where(F.col("source_kind") == "listing").select(F.col("source_id").alias("listing_id")).distinct().join(t.listings, "listing_id")
    products = promoted.select(F.col("listing_id").alias("source_id"), "org_id", F.coalesce("sku", F.col("listing_id").cast("string")).alias("sku"), "gtin", "brand",
                               F.coalesce(F.nullif("title", F.lit("")), "url").alias("name"), F.coalesce("last_snapshot_currency", F.lit("EUR")).alias("currency"))
    edge = lambda df, kind, src, lst: df.select("org_id", F.lit(kind).alias("source_kind"), src.alias("source_id"), lst.alias("listing_id"))
    own = edge(promoted, "listing", F.col("listing_id"), F.col("listing_id"))
    named = r.select("org_id", "source_kind", "source_id", "listing_id")
    links = named.unionByName(own).distinct().withColumns({"method": F.lit("manual"), "confidence": F.lit(1.0), "status": F.lit("confirmed")})
    return {"listings": fresh, "snapshots": obs, "products": products, "matches": links}


def dedupe_products(d: DataFrame, within: tuple[str, ...] = ("org_id", "run_id")) -> DataFrame:
    """Merge found products of one tenant and crawl run that share a URL, SKU, GTIN or EAN, also over several steps.

    The first non-null value (by product id) of every field wins; confidence is the highest.
    """
    scope = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in within])
    tag = lambda name, c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.concat(scope, F.lit(f"|{name}:"), F.col(c)))
    keys = F.array_compact(F.array(tag("url", "normalized_url"), tag("sku", "sku"), tag("gtin", "gtin"), tag("ean", "ean")))
    rows = d.select(F.col("product_id").alias("row_id"), F.explode(keys).alias("key"))
    comp = components(rows).withColumnRenamed("row_id", "product_id")
    j = d.join(comp, "product_id", "left").withColumn("component", F.coalesce("component", "product_id"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("product_id"))).alias(c)
    merged = j.groupBy("component").agg(
        *[first(c) for c in ("normalized_url", "title", "price", "currency", "availability", "image_url", "brand", "sku", "ean", "gtin")],
        *[F.min(c).alias(c) for c in within], F.count(F.lit(1)).alias("merged_rows"), F.max("confidence").alias("confidence"),
        F.when(F.max(F.col("source") == "product_detail"), "product_detail").otherwise(F.min_by("source", "product_id")).alias("source"),
    )
    # distinct values only: map-side combine removes the copies before the shuffle
    words = j.select("component", F.explode("breadcrumbs").alias("w")).distinct().groupBy("component").agg(F.array_sort(F.collect_set("w")).alias("breadcrumbs"))
    errs = j.select("component", F.explode("errors").alias("w")).distinct().groupBy("component").agg(F.array_sort(F.collect_set("w")).alias("errors"))
    return merged.join(words, "component", "left").join(errs, "component", "left")


def normalised_products(entities: DataFrame) -> DataFrame:
    """One row per tenant and product key, led by the entity with the highest confidence."""
    e = entities.withColumn("normalized_key", X.product_key("canonical_title", "brand"))
    lead = F.struct((-F.col("confidence")).alias("c"), F.col("entity_id").alias("e"))
    return e.groupBy("org_id", "normalized_key").agg(
        F.min_by("canonical_title", lead).alias("canonical_title"), F.min_by("brand", lead).alias("brand"), F.max("confidence").alias("confidence"),
        F.count(F.lit(1)).alias("entities"), F.min_by("entity_id", lead).alias("leading_entity"),
    )


def product_aliases(members: DataFrame, entities: DataFrame) -> DataFrame:
    keyed = entities.select("entity_id", X.product_key("canonical_title", "brand").alias("normalized_key"))
    a = members.select("org_id", "entity_id", F.col("title").alias("alias")).where(F.col("alias").isNotNull()).join(keyed, "entity_id")
    return a.groupBy("org_id", "normalized_key", "alias").agg(F.count(F.lit(1)).alias("listings"))


def product_specifications(normalised: DataFrame) -> DataFrame:
    return normalised.select("org_id", "normalized_key", X.specs("canonical_title", "brand").alias("s")).select("org_id", "normalized_key", "s.*")


def matching_logs(scored: DataFrame) -> DataFrame:
    return scored.select(*PAIR, F.lit("suggested").alias("action"), "method", "score", F.to_json("reasons").alias("reasons"))


def match_review(t: Tables, status: str = "suggested", k: int = 200) -> DataFrame:
    """Matches of one status, strongest and newest first; names are joined for the rows shown."""
    m = top_k(t.matches.where(F.col("status") == status), ["org_id"], [F.desc("confidence"), F.desc("created_at"), F.asc("match_id")], k, rank="position")
    own = t.my_products.select("product_id", F.col("name").alias("my_name"), F.col("sku").alias("my_sku"))
    seen = t.listings.select("listing_id", "store_id", F.col("title").alias("listing_title"), "url")
    st = t.stores.select("store_id", F.col("name").alias("store_name"))
    return m.join(own, "product_id").join(seen, "listing_id").join(st, "store_id").select(
        "org_id", "position", "match_id", "my_name", "my_sku", "listing_title", "url", "store_name", "method", S.dbl("confidence").alias("confidence"))


def prior_ok(t: Tables) -> DataFrame:
    """Last good observation at or before each failed one.

    Failures look back through the lag of good rows: a running ``last`` is replaced by a carried value.
    """
    from ..operators.ordered import carry_forward

    s = t.snapshots.withColumn("ok_row", F.when(F.col("status") == "ok", F.struct("scraped_at", "price", "availability")))
    c = carry_forward(s, {"prior": "ok_row"}, sizes=t.snapshots.select("listing_id", "scraped_at"))
    return c.where(F.col("status") != "ok").select(
        "snapshot_id", "listing_id", "scraped_at", "status", F.col("prior.scraped_at").alias("prior_at"), S.dbl("prior.price").alias("prior_price"), F.col("prior.availability").alias("prior_availability"))


def category_of_discovered(d: DataFrame, categories: DataFrame) -> DataFrame:
    """Category id of a found product by the category's URL within the run."""
    c = categories.select("run_id", F.col("url").alias("category_url"), "category_id")
    return d.join(c, ["run_id", "category_url"], "left")
