"""Scores, ratios and labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    Repeating a costly expression in a plan repeats its work; a one-element transform binds it to a variable.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def computed(df, keep: list, **cols: Column):
    """Columns worked out exactly once per row.

    They leave through a generator, so no later filter or projection can pull copies of them below it.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def dbl(c: Column | str) -> Column:
    return col(c).cast("double")


def rnd(c: Column | str, digits: int) -> Column:
    """Half-up rounding through a decimal, so ties do not depend on binary fractions."""
    return F.round(col(c).cast("decimal(28,8)"), digits).cast("double")


def count_if(cond: Column) -> Column:
    return F.count_if(cond)


def mean(c: Column | str, digits: int = 2) -> Column:
    """Average of an exact column: one exact sum, one division."""
    return rnd(dbl(F.sum(col(c))) / F.count(col(c)), digits)


def median(c: Column | str, digits: int = 2) -> Column:
    """Interpolated median; nulls are ignored."""
    return rnd(F.percentile(col(c), F.lit(0.5)), digits)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), rnd(c, 2)))


def is_discounted(price: Column | str, old: Column | str) -> Column:
    return F.coalesce(col(old) > col(price), F.lit(False))


def discount_pct(price: Column | str, old: Column | str, null_when_none: bool = False) -> Column:
    """Discount in percent.  Analytics counts no discount as 0, product pages leave it null."""
    p, o = col(price), col(old)
    raw = dbl(o - p) / dbl(o) * 100
    if null_when_none:
        return F.when(o > p, raw)
    return F.when((o > 0) & (o > p), raw).otherwise(F.lit(0.0))


def pct_change(cur: Column | str, prev: Column | str) -> Column:
    return F.when(col(prev) > 0, dbl(col(cur) - col(prev)) / dbl(prev) * 100)


def pct_delta(cur: Column | str, prev: Column | str, digits: int | None = 1) -> Column:
    """Change against a previous measure; from zero it is 0 or 100."""
    c, p = dbl(cur), dbl(prev)
    raw = (c - p) / F.abs(p) * 100
    raw = raw if digits is None else rnd(raw, digits)
    return F.when(p == 0, F.when(c == 0, 0.0).otherwise(100.0)).when(c.isNotNull() & p.isNotNull(), raw)


def freshness_pct(total: Column | str, fresh: Column | str) -> Column:
    return F.when(col(total) > 0, rnd(dbl(fresh) / dbl(total) * 100, 0)).otherwise(0.0)


def aggressiveness(drops, discounted, changes, stock_changes, failed) -> Column:
    raw = dbl(drops) * 2 + dbl(discounted) * 1.5 + dbl(changes) + dbl(stock_changes) * 0.5 + dbl(failed) * 0.5
    return clamp(raw * 5, 0, 100)


def volatility(low, high, avg) -> Column:
    ok = col(low).isNotNull() & col(high).isNotNull() & (dbl(avg) > 0)
    return F.when(ok, rnd(dbl(col(high) - col(low)) / dbl(avg) * 100, 1)).otherwise(0.0)


def category_volatility(low, high, avg, changes) -> Column:
    ok = col(low).isNotNull() & col(high).isNotNull() & (dbl(avg) > 0)
    spread = F.when(ok, dbl(col(high) - col(low)) / dbl(avg) * 100).otherwise(0.0)
    return clamp(spread * 0.7 + dbl(changes) * 5, 0, 100)


# fixed weights of the quality score
QUALITY_WEIGHTS = {"price": 22, "title": 16, "confidence": 22, "recent": 16, "ok": 16, "url": 8}


def quality_score(has_price: Column, has_title: Column, confidence: Column, recent: Column, ok: Column, valid_url: Column) -> Column:
    w = QUALITY_WEIGHTS
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(dbl(confidence), F.lit(0.0))))
    flags = [(has_price, w["price"]), (has_title, w["title"]), (recent, w["recent"]), (ok, w["ok"]), (valid_url, w["url"])]
    total = conf * w["confidence"]
    for cond, weight in flags:
        total = total + F.when(cond, float(weight)).otherwise(0.0)
    return rnd(total, 0)


def trend(first, last, vol=None) -> Column:
    """falling / rising at three percent, volatile first when a volatility is given."""
    known = col(last).isNotNull() & (col(first) > 0)
    pct = dbl(col(last) - col(first)) / dbl(first) * 100
    out = F.when(~F.coalesce(known, F.lit(False)), "unknown")
    if vol is not None:
        out = out.when(dbl(vol) >= 12, "volatile")
    return out.when(pct <= -3, "falling").when(pct >= 3, "rising").otherwise("stable")


def stock_status(in_stock, out, unknown) -> Column:
    i, o = col(in_stock), col(out)
    return (
        F.when((i > 0) & (o > 0), "mixed").when(i > 0, "in_stock").when(o > 0, "out_of_stock").otherwise("unknown")
    )


def stock_ratio(in_stock, total) -> Column:
    return F.when(col(total) > 0, rnd(dbl(in_stock) / dbl(total), 2)).otherwise(0.0)


def price_band(price) -> Column:
    p = dbl(price)
    return (
        F.when(p.isNull(), "missing price")
        .when(p < 500, "< 500")
        .when(p < 1500, "500-1499")
        .when(p < 3000, "1500-2999")
        .when(p < 5000, "3000-4999")
        .otherwise("5000+")
    )


def volatility_class(vol) -> Column:
    return F.when(dbl(vol) >= 20, "high volatility").when(dbl(vol) >= 8, "medium volatility").otherwise("low volatility")


def entity_confidence(matched, competitors, has_gtin, has_sku, has_brand, has_price) -> Column:
    bonus = [(col(competitors) > 1, 0.12), (col(has_gtin), 0.14), (col(has_sku), 0.08), (col(has_brand), 0.06), (col(has_price), 0.05)]
    total = F.when(col(matched), 0.62).otherwise(0.42)
    for cond, weight in bonus:
        total = total + F.when(cond, weight).otherwise(0.0)
    return F.least(F.lit(0.98), rnd(total, 2))


def age_hours(ts, as_of) -> Column:
    return (F.unix_seconds(col(as_of)) - F.unix_seconds(col(ts))).cast("double") / 3600


def format_pct(value, digits: int = 1) -> Column:
    v = dbl(value)
    text = F.format_string(f"%.{digits}f%%", rnd(v, digits))
    return F.when(v.isNull(), "—").otherwise(F.concat(F.when(v > 0, "+").otherwise(""), text))


def format_currency(amount, currency) -> Column:
    # fixed display symbols
    symbol = F.create_map(*[F.lit(x) for kv in {"EUR": "€", "USD": "$", "GBP": "£", "UAH": "UAH "}.items() for x in kv])
    a = dbl(amount)
    body = F.format_number(F.abs(rnd(a, 2)), 2)
    shown = F.concat(F.when(a < 0, "-").otherwise(""), F.coalesce(F.try_element_at(symbol, col(currency)), F.concat(col(currency), F.lit(" "))), body)
    return F.when(a.isNull(), "—").otherwise(shown)


def time_ago(ts, as_of) -> Column:
    minutes = F.floor((F.unix_seconds(col(as_of)) - F.unix_seconds(col(ts))) / 60)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    return (
        F.when(col(ts).isNull(), "never")
        .when(minutes < 1, "just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .when(days < 30, F.concat(days.cast("string"), F.lit("d ago")))
        .otherwise(F.date_format(col(ts), "M/d/yyyy"))
    )


def kpi_hours(c: Column) -> Column:
    return rnd(c, 0)
