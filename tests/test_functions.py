"""Literal expectations of the scalar functions and of filter parsing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pricelens.functions import scores as S
from pricelens.functions import text as X
from pricelens.functions import urls as U
from pricelens.plans import dashboard as D
from pricelens.plans import rules as RU
from pricelens.plans import shipments as SH
from pricelens.plans.filters import Filters, parse_dashboard_filters, parse_entity_filters, parse_filters, resolve_dashboard_range, resolve_range


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


L = F.lit


@pytest.mark.parametrize("text,expected", [("€1.299,00", 1299.0), ("€19,99", 19.99), ("$1,299.99", 1299.99), ("1699 - 1991 грн.", 1699.0), ("out of stock", None), ("1.299", 1.299), ("1,234,567", None)])
def test_parse_price(spark, text, expected):
    assert value(spark, X.parse_price(L(text))) == expected


def test_parse_price_custom_regex(spark):
    assert value(spark, X.parse_price(L("now 12 was 34,50"), r"was (\d+,\d+)")) == 34.5
    assert value(spark, X.parse_price(L("now 12 was 34,50"), r"\d+,\d+")) == 34.5


def test_scores(spark):
    assert value(spark, S.category_volatility(L(100), L(140), L(120), L(3))) == pytest.approx(38.33)
    assert [value(spark, S.discount_pct(L(p).cast("int"), L(100))) for p in (80, 120, None)] == [20.0, 0.0, 0.0]
    assert [value(spark, S.pct_delta(L(a), L(b))) for a, b in ((120, 100), (80, 100), (0, 0), (5, 0))] == [20.0, -20.0, 0.0, 100.0]
    assert value(spark, S.aggressiveness(L(1), L(2), L(1), L(0), L(0))) == 30.0
    assert value(spark, S.trend(L(100.0), L(96.0))) == "falling"
    assert value(spark, S.trend(L(100.0), L(96.0), L(15.0))) == "volatile"
    assert value(spark, S.trend(L(None).cast("double"), L(96.0))) == "unknown"
    assert [value(spark, S.price_band(L(p))) for p in (499.0, 500.0, 4999.0, 5000.0)] == ["< 500", "500-1499", "3000-4999", "5000+"]


def test_median(spark):
    for values, expected in (([3, 1, 2], 2.0), ([10, 20, 30, 40], 25.0)):
        assert spark.createDataFrame([(v,) for v in values], "v int").agg(S.median("v").alias("m")).first()["m"] == expected


def test_specs(spark):
    s = value(spark, X.specs(L("Kettler Quadriga Comp CX11 750 Wh 28 Zoll 2026 Bosch Performance CX"), L("Kettler")))
    assert (s["battery_wh"], s["wheel_size"], s["year"], s["motor"]) == (750, '28"', 2026, "bosch performance cx")


def test_urls(spark):
    base = L("https://example.com/shop/")
    assert value(spark, U.normalise_url(L("/shop/bikes/?utm_source=x&page=2&page=2#top"), base)) == "https://example.com/shop/bikes?page=2"
    assert value(spark, U.normalise_url(L("../a/./b?z=1&a=2"), base)) == "https://example.com/a/b?a=2&z=1"
    for bad in ("mailto:x@y", "https://other.com/x", "/cart", "/img/a.png", "javascript:void(0)", ""):
        assert value(spark, U.normalise_url(L(bad), base)) is None
    assert value(spark, U.normalise_url(L("https://cdn.com/x"), base, allow_hosts=["https://cdn.com/"])) == "https://cdn.com/x"
    assert value(spark, U.normalise_url(L("/a?keep=1"), base, include=["/b"])) is None


def test_ups_number(spark):
    assert value(spark, X.is_ups_number(L("1Z0R6D896828244757")))
    assert not value(spark, X.is_ups_number(L("1Z0R6D896828244758")))


@pytest.mark.parametrize("status,override,minutes", [("customs", 720, 720), ("customs", None, 60), ("in_transit", 5, 180), ("in_transit", 1_000_000, 10080)])
def test_next_check(spark, status, override, minutes):
    assert value(spark, SH.next_check_minutes(L(status), L(override).cast("int"))) == minutes


@pytest.mark.parametrize("rate,failed,broken,sessions,stale,expected", [(99, 0, 0, 0, 0, "healthy"), (80, 0, 2, 0, 0, "warning"), (40, 1, 0, 0, 0, "critical")])
def test_health(spark, rate, failed, broken, sessions, stale, expected):
    reasons = D.health_reasons(L(rate), L(failed), L(broken), L(sessions), L(stale))
    assert value(spark, D.health_status(L(rate), L(failed), L(sessions), reasons)) == expected


def test_repair_policy(spark):
    ask = lambda status, fails, conf=0.9, same=0, hour=0, art=True: value(spark, RU.repair_decision(L(status), L(fails), L(art), L(True), L(conf), L(same), L(hour)))
    assert ask("parse_failed", 1) == "parse_failed"
    assert ask("ok", 1, 0.4) == "low_confidence"
    assert ask("captcha", 3) == "non_repairable_captcha"
    assert ask("parse_failed", 1, same=1) == "already_attempted_this_scrape_run"
    assert ask("parse_failed", 1, hour=3) == "competitor_hourly_limit_reached"
    assert ask("parse_failed", 1, art=False) == "html_artifact_missing"


def test_provider_breaker(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, 1, "a", "failed", 10.0, t0 + dt.timedelta(minutes=i)) for i in range(4)]
    schema = "check_id bigint, org_id bigint, provider string, state string, duration_ms double, checked_at timestamp"
    captchas = [(10 + i, 1, "a", "captcha", 10.0, t0 + dt.timedelta(hours=1, minutes=i)) for i in range(10)]
    h = SH.provider_health(spark.createDataFrame(rows + captchas, schema)).first()
    assert (h["consecutive_failures"], h["disabled_until"]) == (4, None)
    h = SH.provider_health(spark.createDataFrame([*rows, (9, 1, "a", "error", 10.0, t0 + dt.timedelta(minutes=9))], schema)).first()
    assert h["consecutive_failures"] == 5 and h["disabled_until"] == t0 + dt.timedelta(minutes=39)


def test_provider_health_continues_from_state(spark):
    t0 = dt.datetime(2024, 1, 1)
    schema = "check_id bigint, org_id bigint, provider string, state string, duration_ms double, checked_at timestamp"
    rows = [(i, 1, "a", s, float(i), t0 + dt.timedelta(minutes=i)) for i, s in enumerate(["success", "failed", "captcha", "success", "failed", "failed"])]
    whole = SH.provider_health(spark.createDataFrame(rows, schema)).first()
    first = SH.provider_health(spark.createDataFrame(rows[:3], schema))
    then = SH.provider_health(spark.createDataFrame(rows[3:], schema), first).first()
    assert abs(whole["success_rate"] - then["success_rate"]) < 2e-4 and whole["consecutive_failures"] == then["consecutive_failures"] == 2


def test_ranges():
    now = dt.datetime(2026, 5, 24, 12)
    assert resolve_range("7d", now).date_from == dt.datetime(2026, 5, 17, 12)
    assert resolve_range("7d", now).previous_from == dt.datetime(2026, 5, 10, 12)
    assert resolve_range("all", now).date_from is None
    assert resolve_dashboard_range("today", now).previous_from == dt.datetime(2026, 5, 23, 12)


def test_filter_parsing():
    assert parse_filters({"range": "9y", "competitor": " all ", "minPrice": "1,5", "discountOnly": "true"}) == Filters(min_price=1.5, discount_only=True)
    assert parse_entity_filters({"page": "0", "pageSize": "500", "groupBy": "x"}).page_size == 100
    assert parse_dashboard_filters({"competitor": "no-uuid", "activeOnly": "false"}).active_only is False
