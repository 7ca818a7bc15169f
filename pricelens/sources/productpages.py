"""Product pages for the test binding: one HTML document per listing, in five kinds of markup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S


def product_page_html(listings: DataFrame) -> DataFrame:
    k = F.col("listing_id")
    title = F.concat(F.coalesce("title", F.lit("no name")), F.lit(" no "), k.cast("string"), F.lit(" model"))
    price = F.coalesce("last_snapshot_price", F.lit(19.99).cast("decimal(12,2)"))
    p = price.cast("string")
    more = (price + 100).cast("string")
    avail = F.when(F.col("last_snapshot_availability") == "out_of_stock", "OutOfStock").otherwise("InStock")
    q = lambda name, value: F.concat(F.lit(f'"{name}":"'), value, F.lit('"'))
    offer = F.concat(F.lit('{"@type":"Offer","price":"'), p, F.lit('","highPrice":'), more, F.lit(',"priceCurrency":"eur","availability":"https://schema.org/'), avail, F.lit('"}'))
    product = F.concat(
        F.lit('{"@type":"Product",'), q("name", title), F.lit(","), q("sku", F.col("sku")), F.lit(","), F.when(F.col("gtin").isNotNull(), F.concat(q("gtin13", F.col("gtin")), F.lit(","))).otherwise(""),
        F.lit('"brand":{"name":"'), F.col("brand"), F.lit('"},"image":["/img/'), k.cast("string"), F.lit('.jpg"],"url":"'), F.col("url"), F.lit('","offers":['), offer, F.lit("]}"),
    )
    ld = lambda j: F.concat(F.lit('<script type="application/ld+json">'), j, F.lit("</script>"))
    item_list = F.concat(F.lit('{"@context":"x","@graph":[{"@type":"WebSite"},{"@type":"ItemList","itemListElement":[{"url":"/alt","item":'), product, F.lit('},{"position":2}]}]}'))
    og = F.concat(
        F.lit('<meta property="og:title" content="'), title, F.lit('"><meta content="'), p, F.lit('" property="product:price:amount"><meta property="product:price:currency" content="eur"><meta property="og:image" content="/img/'),
        k.cast("string"), F.lit('.jpg"><meta property="product:availability" content="'), F.lower(avail), F.lit('">'),
    )
    node = F.concat(F.lit('{'), q("name", title), F.lit(',"price":'), p, F.lit(',"currency":"EUR",'), q("url", F.col("url")), F.lit(","), q("sku", F.col("sku")), F.lit(',"brand":{"name":"'), F.col("brand"), F.lit('"}}'))
    payload = F.concat(
        F.lit('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"items":['), node, F.lit("]}}}</script><script>window.dataLayer = ["), node, F.lit("];</script>"),
    )
    kind = k % 5
    head = F.when(kind == 0, ld(product)).when(kind == 1, ld(item_list)).when(kind == 2, og).when(kind == 3, payload).otherwise("")
    card = lambda i: F.concat(F.lit(f'<div class="product-card p-2 jsx-100{i}"><a href="/p/'), (F.floor(k / 5) + i).cast("string"), F.lit(f'">next {i}</a></div>\n'))
    eu = F.translate(F.format_number(price, 2), ",.", ".,")
    eu_more = F.translate(F.format_number(price + 100, 2), ",.", ".,")
    text = F.when(kind == 4, F.concat(F.lit("<p>"), title, F.lit("</p>\n<p>"), eu, F.lit(" €</p>\n<p>statt "), eu_more, F.lit(" €</p>\n<p>Sofort "), F.when(avail == "InStock", "verfügbar").otherwise("nicht verfügbar"), F.lit("</p>\n"))).otherwise("")
    html = F.concat(
        F.lit('<html lang="de"><head><title>'), title, F.lit("</title>"), head, F.lit("</head>\n<body>\n<nav aria-label=\"breadcrumb\"><a href=\"/\">Home</a><a href=\"/shop/x\">"), F.col("brand"),
        F.lit("</a></nav>\n<h1>Item</h1>\n"), text, F.lit('<div class="grid">\n'), card(1), card(2), card(3), F.lit('</div>\n<a rel="next" href="?page=2">2</a>\n</body></html>'),
    )
    return S.computed(listings, [k.alias("page_id"), "store_id", "url", F.lit(200).alias("http_status")], html=html)
