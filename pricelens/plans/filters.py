"""Request filters: parsed once at the driver, then turned into predicates only where they are set."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed lengths of the selectable periods
RANGE_DAYS = {"24h": 1, "7d": 7, "30d": 30, "90d": 90, "1y": 365}
# fixed number of points a chart of the period shows
MAX_POINTS = {"24h": 24, "7d": 7, "30d": 30, "90d": 90}


@dataclass(frozen=True)
class Period:
    date_from: dt.datetime | None
    previous_from: dt.datetime | None
    previous_to: dt.datetime | None


@dataclass(frozen=True)
class Filters:
    range: str = "30d"
    competitor: str | None = None
    category: str | None = None
    brand: str | None = None
    availability: str | None = None
    discount_only: bool = False
    in_stock_only: bool = False
    stale_only: bool = False
    low_confidence_only: bool = False
    reviewed_only: bool = False
    changes_only: bool = False
    stock_changes_only: bool = False
    min_price: float | None = None
    max_price: float | None = None
    min_volatility: float | None = None
    max_volatility: float | None = None

    def period(self, as_of: dt.datetime) -> Period:
        return resolve_range(self.range, as_of)

    @property
    def max_points(self) -> int:
        return MAX_POINTS.get(self.range, 60)


def resolve_range(name: str, as_of: dt.datetime) -> Period:
    """Half-open periods ``[from, as_of)`` and the equally long one before; ``all`` has no bounds."""
    if name == "all":
        return Period(None, None, None)
    span = dt.timedelta(days=RANGE_DAYS.get(name, 30))
    return Period(as_of - span, as_of - 2 * span, as_of - span)


@dataclass(frozen=True)
class DashboardFilters:
    range: str = "today"
    store_id: int | None = None
    category_id: str | None = None
    active_only: bool = True
    failed_only: bool = False

    def period(self, as_of: dt.datetime) -> Period:
        return resolve_dashboard_range(self.range, as_of)


def resolve_dashboard_range(name: str, as_of: dt.datetime) -> Period:
    if name in ("7d", "30d"):
        start = as_of - dt.timedelta(days=int(name[:-1]))
    else:
        start = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    return Period(start, start - (as_of - start), start)


def time_bucket(ts: Column | str, name: str) -> Column:
    """Hour for one day, month for a year or everything, day otherwise."""
    unit = "hour" if name in ("24h", "today") else "month" if name in ("1y", "all") else "day"
    return F.date_trunc(unit, F.col(ts) if isinstance(ts, str) else ts)


@dataclass(frozen=True)
class EntityFilters:
    search: str | None = None
    brand: str | None = None
    category: str | None = None
    competitor: int | None = None
    availability: str | None = None
    stock: str | None = None
    discount: str | None = None
    advanced: str | None = None
    group_by: str = "none"
    sort: str = "updated_desc"
    page: int = 1
    page_size: int = 50
    min_price: float | None = None
    max_price: float | None = None
    specs: dict = field(default_factory=dict)


GROUP_BY = ["none", "brand", "category", "competitor", "stock", "volatility", "discount", "price_range"]
SPEC_FIELDS = ["motor", "battery", "wheelSize", "travel", "frameMaterial", "drivetrain", "brakes", "weight", "year"]
UUID = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$", re.I)


def _one(v):
    return v[0] if isinstance(v, list) and v else (None if isinstance(v, list) else v)


def clean(value, limit: int) -> str | None:
    text = (_one(value) or "").strip()
    return None if text in ("", "all", "none") else text[:limit]


def number(value) -> float | None:
    text = _one(value)
    try:
        parsed = float(text.replace(",", ".", 1)) if text else None
    except ValueError:
        return None
    return parsed if parsed is not None and abs(parsed) != float("inf") and parsed == parsed else None


def _flag(params, name, default=False) -> bool:
    value = _one(params.get(name))
    return value != "false" if default else value == "true"


def parse_filters(params: dict) -> Filters:
    name = _one(params.get("range"))
    return Filters(
        range=name if name in (*RANGE_DAYS, "all") else "30d",
        **{k: clean(params.get(k), 140) for k in ("competitor", "category", "brand", "availability")},
        discount_only=_flag(params, "discountOnly"),
        in_stock_only=_flag(params, "inStockOnly"),
        stale_only=_flag(params, "staleOnly"),
        low_confidence_only=_flag(params, "lowConfidenceOnly"),
        reviewed_only=_flag(params, "reviewedOnly"),
        changes_only=_flag(params, "changesOnly"),
        stock_changes_only=_flag(params, "stockChangesOnly"),
        min_price=number(params.get("minPrice")),
        max_price=number(params.get("maxPrice")),
        min_volatility=number(params.get("minVolatility")),
        max_volatility=number(params.get("maxVolatility")),
    )


def parse_dashboard_filters(params: dict) -> DashboardFilters:
    name = _one(params.get("range"))
    ids = {k: _one(params.get(k)) for k in ("competitor", "category")}
    ok = {k: v if v and UUID.match(v) else None for k, v in ids.items()}
    return DashboardFilters(
        range=name if name in ("today", "7d", "30d") else "today",
        store_id=ok["competitor"], category_id=ok["category"],
        active_only=_flag(params, "activeOnly", True), failed_only=_flag(params, "failedOnly"),
    )


def _positive(value, fallback: int) -> int:
    parsed = number(value)
    return int(parsed) if parsed is not None and parsed >= 1 and parsed == int(parsed) else fallback


def parse_entity_filters(params: dict) -> EntityFilters:
    group = _one(params.get("groupBy"))
    text = {k: clean(params.get(k), 120) for k in ("search", "category", "brand", "competitor", "availability", "stock", "discount", "advanced")}
    return EntityFilters(
        **text,
        group_by=group if group in GROUP_BY else "none",
        sort=clean(params.get("sort"), 120) or "updated_desc",
        page=_positive(params.get("page"), 1),
        page_size=min(100, _positive(params.get("pageSize"), 50)),
        min_price=number(params.get("minPrice")),
        max_price=number(params.get("maxPrice")),
        specs={k: v for k in SPEC_FIELDS if (v := clean(params.get(k), 120))},
    )
