"""URL functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import col, let
from .text import grab

# fixed list: parameters that only serve tracking
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "gclid", "fbclid", "msclkid", "yclid", "pk_campaign", "pk_kwd",
]
# fixed patterns
BINARY = r"(?i)\.(?:pdf|jpg|jpeg|png|gif|webp|avif|svg|zip|rar|7z|mp4|mp3|webm|woff2?|ttf|ico)$"
BLOCKED_PATH = r"(?i)/(?:account|konto|login|signin|register|cart|warenkorb|checkout|kasse|wishlist|compare|search|suche)(?:/|$)"
CATEGORY_PATH = r"(?i)/(?:category|collections|collection|shop|c|kategorie|produkt-kategorie|bikes|e-bikes|ebikes|parts|zubehoer|zubehör|sale|marken)(?:/|$)"
PRODUCT_PATH = r"(?i)/(?:product|products|produkt|p|artikel|item)(?:/|$)|-[a-z0-9]*\d{5,}(?:$|/)"
HTTP_URL = r"(?i)^(https?)://([^/?#]+)([^?#]*)(\?[^#]*)?"


def url_hash(url) -> Column:
    return F.sha2(F.lower(F.trim(col(url))), 256)


def scheme(url) -> Column:
    return F.lower(grab(col(url), HTTP_URL, 1))


def host(url) -> Column:
    """Host with port, without user information."""
    return F.lower(F.regexp_replace(grab(col(url), HTTP_URL, 2), r"^[^@]*@", ""))


def hostname(url) -> Column:
    return F.regexp_replace(host(url), r":\d+$", "")


def path(url) -> Column:
    return F.coalesce(grab(col(url), HTTP_URL, 3), F.lit("/"))


def query(url) -> Column:
    return F.regexp_replace(F.regexp_extract(col(url), HTTP_URL, 4), r"^\?", "")


def origin(url) -> Column:
    return F.concat(scheme(url), F.lit("://"), host(url))


def remove_dots(p: Column) -> Column:
    """Resolve ``.`` and ``..`` segments."""
    parts = F.split(p, "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
        .when(s == ".", acc)
        .otherwise(F.array_append(acc, s)),
    )
    trailing = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    needs_dots = p.rlike(r"(^|/)\.\.?(/|$)")
    return F.when(needs_dots, F.concat(F.array_join(kept, "/"), trailing)).otherwise(p)


def escape_rest(text: Column) -> Column:
    """Percent-encode blanks and characters outside ASCII; everything else stays."""
    one = lambda ch: F.when(ch.rlike(r"[^\x21-\x7e]"), F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20"))).otherwise(ch)
    return F.when(text.rlike(r"[^\x21-\x7e]"), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)


def resolve(url, base) -> Column:
    """Absolute http(s) URL of a reference found on a page at ``base``; null if it is no such URL."""
    def join(b):
        root = let(b, lambda x: F.struct(x.alias("b"), origin(x).alias("o"), scheme(x).alias("s"), path(x).alias("p")))
        return let(F.struct(F.trim(col(url)).alias("u"), root.alias("r")), against)

    def against(x):
        u, r = x["u"], x["r"]
        bare = F.regexp_replace(u, r"#.*$", "")
        relative = F.concat(r["o"], F.regexp_replace(r["p"], r"[^/]*$", ""), bare)
        absolute = (
            F.when(u.rlike(r"(?i)^https?://[^/?#\s]+"), u)
            .when(u.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None))
            .when(u.startswith("//"), F.concat(r["s"], F.lit(":"), u))
            .when(u.startswith("/"), F.concat(r["o"], u))
            .when(u.startswith("?"), F.concat(r["o"], r["p"], u))
            .when((u == "") | u.startswith("#"), F.concat(r["o"], r["p"], F.regexp_extract(r["b"], HTTP_URL, 4)))
            .otherwise(relative)
        )
        return let(absolute, tidy)

    def tidy(a):
        ok = a.rlike(r"(?i)^https?://[^/?#\s]+")
        rest = F.concat(let(path(a), remove_dots), F.regexp_extract(a, HTTP_URL, 4))
        return F.when(ok, F.concat(origin(a), let(rest, escape_rest)))

    return join(F.trim(col(base)))


def normalise_url(url, base, root=None, allow_hosts: list[str] | None = None, include: list[str] | None = None,
                  exclude: list[str] | None = None, allow_search: bool = False) -> Column:
    """Canonical form of a link, or null when it should not be followed."""
    u = F.trim(col(url))
    root_host = hostname(col(base) if root is None else col(root))
    allowed = [h.split("://")[-1].split("/")[0].lower() for h in allow_hosts or []]
    any_of = lambda full, words: reduce(lambda a, w: a | F.contains(full, F.lit(w)), words, F.lit(False))

    def checked(full):
        return let(F.struct(full.alias("f"), path(full).alias("p"), hostname(full).alias("h"), origin(full).alias("o")), build)

    def build(x):
        full, p = x["f"], x["p"]
        ok = full.isNotNull() & ~p.rlike(BINARY) & ((x["h"] == root_host) | x["h"].isin(allowed) if allowed else x["h"] == root_host)
        if not allow_search:
            ok = ok & ~p.rlike(BLOCKED_PATH)
        if exclude:
            ok = ok & ~any_of(full, exclude)
        if include:
            ok = ok & any_of(full, include)
        clean = F.regexp_replace(F.regexp_replace(p, r"/{2,}", "/"), r"(?<=.)/$", "")
        return F.when(ok, F.concat(x["o"], clean, let(query(full), clean_query)))

    usable = (u != "") & ~u.rlike(r"(?i)^(?:mailto|tel|javascript|data):")
    return F.when(usable, let(resolve(u, base), checked))


def clean_query(q: Column) -> Column:
    """Parameters without tracking ones, sorted by name, each pair once."""
    pairs = F.filter(F.split(q, "&"), lambda kv: (kv != "") & ~F.lower(F.substring_index(kv, "=", 1)).isin(TRACKING_PARAMS))
    pairs = F.transform(pairs, lambda kv: F.when(F.contains(kv, F.lit("=")), kv).otherwise(F.concat(kv, F.lit("="))))
    keyed = F.transform(pairs, lambda kv, i: F.struct(F.substring_index(kv, "=", 1).alias("k"), i.alias("i"), kv.alias("kv")))
    kept = F.array_distinct(F.transform(F.array_sort(keyed), lambda x: x["kv"]))
    return F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))


def is_category_url(url) -> Column:
    return F.lower(path(url)).rlike(CATEGORY_PATH)


def is_product_url(url) -> Column:
    return ~is_category_url(url) & F.lower(path(url)).rlike(PRODUCT_PATH)


def depth(url) -> Column:
    return F.size(F.filter(F.split(path(url), "/"), lambda s: s != ""))


def resolve_image_url(value, base) -> Column:
    v = F.trim(col(value))
    rooted = F.when(v.rlike(r"(?i)^https?://[^/?#]+$"), F.concat(v, F.lit("/"))).otherwise(v)
    return (
        F.when(v.isNull() | (v == ""), F.lit(None).cast("string"))
        .when(v.startswith("//"), F.concat(F.lit("https:"), v))
        .when(v.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), rooted)
        .otherwise(resolve(v, base))
    )


# fixed templates: search page per shop technology, and words in a domain that hint at one
SEARCH_TEMPLATES = {
    "amazon": "https://{domain}/s?k={q}",
    "shopify": "https://{domain}/search?q={q}",
    "woocommerce": "https://{domain}/?s={q}&post_type=product",
    "magento": "https://{domain}/catalogsearch/result/?q={q}",
    "prestashop": "https://{domain}/index.php?controller=search&s={q}",
    "tilda": "https://{domain}/search/?q={q}",
    "default": "https://{domain}/search?q={q}",
}
DOMAIN_HINTS = {"amazon": "amazon", "ebay": "default", "shopify": "shopify", "myshopify": "shopify", "woocommerce": "woocommerce"}


def encode_component(c: Column) -> Column:
    """Percent encoding of a query value (blank as %20; ! ' ( ) * ~ stay)."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, ch in {"%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}.items():
        out = F.replace(out, F.lit(code), F.lit(ch))
    return out


def search_url(q, domain, framework=None, preset=None, max_chars: int | None = None) -> Column:
    d = F.regexp_replace(F.regexp_replace(col(domain), r"^https?://", ""), r"/$", "")
    tech = F.lower(F.coalesce(*( [col(framework)] if framework is not None else []), *([col(preset)] if preset is not None else []), F.lit("")))
    known = F.create_map(*[F.lit(x) for kv in SEARCH_TEMPLATES.items() for x in kv])
    hinted = None
    for word, key in DOMAIN_HINTS.items():
        cond = F.contains(d, F.lit(word))
        hinted = F.when(cond, SEARCH_TEMPLATES[key]) if hinted is None else hinted.when(cond, SEARCH_TEMPLATES[key])
    template = F.coalesce(F.try_element_at(known, tech), hinted, F.lit(SEARCH_TEMPLATES["default"]))
    text = F.trim(col(q))
    text = encode_component(text if max_chars is None else F.substring(text, 1, max_chars))
    return F.replace(F.replace(template, F.lit("{domain}"), d), F.lit("{q}"), text)
