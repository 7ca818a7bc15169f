"""Parcel tracking: page classification, consensus, state updates and provider health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.scores import col
from ..functions.text import ascii_edges
from ..operators.ordered import latest_per_key
from ..operators.writes import append_if_absent, first_per_key
from ..sources.catalog import Tables

# fixed patterns, tested in this order
CAPTCHA = ["captcha", "verify (?:that )?you are human", "human verification", "checking your browser", "security verification", "just a moment", "триває перевірка безпеки", "cf-chl-"]
BLOCKED = ["403 error", "request blocked", "the request could not be satisfied", "access denied", "unable to complete your tracking request"]
PAYWALL = ["payment required", "upgrade (?:your|the) plan", "buy (?:more )?credits", "subscribe to continue", "pricing plan required", "paid plan required"]
NOT_FOUND = [
    "tracking (?:number|information) (?:was )?not found", "no tracking information", "no information (?:was )?found",
    "no information about (?:your|this|the) (?:package|parcel|shipment)", "no information (?:is )?available for (?:this|the) (?:package|parcel|shipment)",
    "could(?: not|n't) find (?:the )?(?:parcel|shipment|tracking)", "unknown tracking number", "shipment not found",
]
STATUS_PHRASES = [
    ("delivered", [r"\bdelivered\b", "successfully delivered"]),
    ("returned", ["return(?:ed|ing) to sender", "shipment returned"]),
    ("out_for_delivery", ["out for delivery", "with delivery courier", "courier is delivering"]),
    ("customs", ["customs clearance", "held (?:at|by) customs"]),
    ("exception", ["delivery exception", "delivery failed", "delivery attempt"]),
    ("in_transit", [r"\bin transit\b", "departed (?:from )?(?:facility|hub)", "arrived at (?:facility|hub)"]),
    ("registered", ["label created", "created a label", "(?:shipment )?(?:information|info) received", "pre-advice"]),
]
# fixed rank of a status in the consensus
STATUS_RANK = {"pending": 0, "unknown": 1, "info_received": 2, "in_transit": 3, "customs": 4, "out_for_delivery": 5, "exception": 6, "returned": 7, "delivered": 8}
# fixed check intervals in minutes
CHECK_MINUTES = {"out_for_delivery": 30, "exception": 60, "customs": 60, "in_transit": 180, "info_received": 360, "delivered": 10080, "returned": 10080}
FINAL = ["delivered", "returned"]
# fixed vocabulary of the canonical result
SOURCES = ["ups", "postal_ninja", "parcelsapp", "ship24", "17track"]
SOURCE_STATES = ["success", "captcha", "blocked", "paywall", "not_found", "irrelevant", "not_configured", "timeout", "error"]
STATUS_HINTS = ["registered", "in_transit", "customs", "out_for_delivery", "delivered", "exception", "returned", "unknown"]


def any_of(patterns: list[str]) -> str:
    return ascii_edges("(?iu)" + "|".join(f"(?:{p})" for p in patterns))


def _place(i: int, status: str):
    return lambda pos: F.when(pos > 0, F.struct(pos.alias("pos"), F.lit(i).alias("i"), F.lit(status).alias("status")))


def first_status(text: Column) -> Column:
    """Status whose phrase stands first in the text."""
    found = []
    for i, (status, patterns) in enumerate(STATUS_PHRASES):
        found.append(S.let(F.regexp_instr(text, F.lit(any_of(patterns))), _place(i, status)))
    return F.array_min(F.array_compact(F.array(*found)))["status"]


def classify_tracking(pages: DataFrame) -> DataFrame:
    """``pages``: tracking_number, text.  Adds state and status_hint."""
    txt = F.trim("text")
    number = F.lower(F.trim("tracking_number"))
    early = (
        F.when(txt.rlike(any_of(CAPTCHA)), "captcha").when(txt.rlike(any_of(BLOCKED)), "blocked").when(txt.rlike(any_of(PAYWALL)), "paywall")
        .when(txt.rlike(any_of(NOT_FOUND)), "not_found").when((number != "") & ~F.contains(F.lower(txt), number), "irrelevant")
    )
    # the phrases are searched once, and only in texts that nothing before decides
    told = S.let(early, lambda e: F.struct(e.alias("early"), F.when(e.isNull(), first_status(txt)).alias("hint")))
    read = S.computed(pages, [c for c in pages.columns if c not in ("state", "status_hint")], _told=told)
    state = F.coalesce("_told.early", F.when(F.col("_told.hint").isNotNull(), "success").otherwise("irrelevant"))
    return read.select("*", state.alias("state"), F.col("_told.hint").alias("status_hint")).drop("_told")


def rank_of(status: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for kv in STATUS_RANK.items() for x in kv])
    return F.coalesce(F.try_element_at(ranks, status), F.lit(1))


def normalise_status(c) -> Column:
    return F.when(col(c) == "registered", "info_received").otherwise(F.coalesce(col(c), F.lit("unknown")))


def consensus(results: DataFrame, keys: list[str]) -> DataFrame:
    """Highest-ranked status among successful providers of a check."""
    ok = F.col("state") == "success"
    st = normalise_status("status")
    g = results.groupBy(*keys).agg(
        F.max(F.when(ok, F.struct(rank_of(st).alias("r"), st.alias("s")))).alias("best"), F.count_if(ok).alias("successes"),
        F.max(ok & (F.col("provider") == "ups")).alias("by_ups"), F.max("checked_at").alias("checked_at"), F.count(F.lit(1)).alias("providers"),
    )
    conf = F.when(F.col("successes") == 0, 0.0).otherwise(F.least(F.lit(0.98), S.rnd(F.col("successes") * 0.12 + 0.55, 4)))
    return g.select(*keys, F.coalesce("best.s", F.lit("unknown")).alias("status"), conf.alias("confidence"), F.when(F.col("by_ups"), "UPS").alias("carrier"), "successes", "providers", "checked_at")


def shipment_run_status(results: DataFrame, keys: list[str], has_presentation: bool = True) -> DataFrame:
    ok = F.col("state") == "success"
    g = results.groupBy(*keys).agg(F.count_if(ok).alias("ok"), F.count(F.lit(1)).alias("n"), F.max(F.col("state") == "not_found").alias("missing"))
    full = (F.col("ok") == F.col("n")) & F.lit(has_presentation)
    status = F.when((F.col("ok") == 0) & F.col("missing"), "partial").when(F.col("ok") == 0, "failed").when(full, "succeeded").otherwise("partial")
    return g.select(*keys, status.alias("run_status"))


def next_check_minutes(status, override) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CHECK_MINUTES.items() for x in kv])
    usual = F.coalesce(F.try_element_at(table, col(status)), F.lit(720))
    fixed = F.when(col(override) >= 15, F.least(F.lit(10080), F.round(col(override)).cast("int")))
    return F.coalesce(fixed, usual)


def next_check(status, override, at) -> Column:
    return col(at) + F.make_dt_interval(mins=next_check_minutes(status, override))


def apply_checks(shipments: DataFrame, checks: DataFrame) -> DataFrame:
    """Shipments after their newest check with data.  Checks without data and shipments already switched off change nothing."""
    useful = checks.where(F.col("successes") > 0)
    newest = latest_per_key(useful, ["shipment_id"], ["status", "confidence", "carrier", "checked_at"], ["checked_at", "status"])
    newest = newest.select("shipment_id", *[F.col(c).alias(f"n_{c}") for c in ("status", "confidence", "carrier", "checked_at")])
    j = shipments.join(newest, "shipment_id", "left")
    hit = F.col("n_status").isNotNull() & F.col("tracking_enabled")
    final = F.col("n_status").isin(FINAL)
    return j.select(
        "shipment_id", "org_id", F.when(hit, F.col("n_status")).otherwise(F.col("current_status")).alias("current_status"),
        F.when(hit, F.col("current_status")).otherwise(F.col("previous_status")).alias("previous_status"),
        F.when(hit, F.when(F.col("n_status") == "delivered", F.col("n_checked_at"))).otherwise(F.col("delivered_at")).alias("delivered_at"),
        F.when(hit, ~final).otherwise(F.col("tracking_enabled")).alias("tracking_enabled"),
        F.when(hit, next_check("n_status", "check_interval_override_minutes", "n_checked_at")).otherwise(F.col("next_check_at")).alias("next_check_at"),
    )


def shipment_events(checks: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    stamp = F.date_format("checked_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    h = F.sha2(F.concat_ws("|", F.col("shipment_id").cast("string"), "status", F.lit(""), stamp), 256)
    e = checks.where(F.col("successes") > 0).select("org_id", "shipment_id", "status", F.col("checked_at").alias("event_at"), h.alias("event_hash"))
    once = first_per_key(e, ["shipment_id", "event_hash"], ["event_at"])
    return once if existing is None else append_if_absent(once, existing, ["shipment_id", "event_hash"])


DISABLE_STREAK, DISABLE_MINUTES = 5, 30


def newest_first(checks: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``k``, the place of a check counted from the newest of its key. Days are numbered alone and the counts of the days after
    them added, so that no task holds a key's whole history."""
    day = F.coalesce(F.date_trunc("day", "checked_at"), F.timestamp_seconds(F.lit(0)))
    dated = checks.withColumn("_day", day)
    later = Window.partitionBy(*key).orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    before = dated.groupBy(*key, "_day").agg(F.count(F.lit(1)).alias("_n")).select(*key, "_day", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*key, "_day").orderBy(F.desc("checked_at"), F.desc("check_id")))
    return dated.withColumn("_own", own).join(before, [*key, "_day"]).withColumn("k", F.col("_before") + F.col("_own")).drop("_day", "_own", "_before")


HEALTH_KEY = ["org_id", "provider"]


def health_fold(checks: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Unrounded running health per tenant and provider after ``checks``, all newer than ``state`` (a result of this function).

    The exponential average is a weighted sum over all checks, newest first, so parts of it add up: a state decays by 0.8 for each
    check after it. Streaks and times are plain grouped passes. A provider's checks are spread over tasks by day.
    """
    key = HEALTH_KEY
    c = checks.where(F.col("state") != "robots_disallowed")
    order = F.struct("checked_at", "check_id")
    ok, captcha = F.col("state") == "success", F.col("state") == "captcha"
    base = c.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.max(order).alias("last"), F.max(F.when(ok, F.col("checked_at"))).alias("last_success_at"),
        F.max(F.when(~ok, F.col("checked_at"))).alias("last_failure_at"), F.max(F.when(ok, order)).alias("_ok"),
    )
    hard = c.where(~ok & ~captcha).join(base.select(*key, "_ok"), key).where(F.col("_ok").isNull() | (order > F.col("_ok")))
    streak = hard.groupBy(*key).agg(F.count(F.lit(1)).alias("streak"))
    tail = newest_first(c, key).join(base.select(*key, "n"), key)
    if state is not None:
        old = state.select(*key, *[F.col(x).alias(f"o_{x}") for x in state.columns if x not in key])
        tail = tail.join(old.select(*key, "o_s"), key, "left")
        started = F.col("o_s").isNotNull()
    else:
        started = F.lit(False)
    # the very first check has full weight instead of a fifth
    share = F.when((F.col("k") == F.col("n")) & ~started, F.lit(1.0)).otherwise(0.2)
    w = F.pow(F.lit(0.8), (F.col("k") - 1).cast("double")) * share
    ema = tail.groupBy(*key).agg(
        F.sum(F.when(ok, w).otherwise(0.0)).alias("s"), F.sum(F.when(captcha, w).otherwise(0.0)).alias("c"), F.sum(w * F.col("duration_ms")).alias("ms"))
    j = base.join(ema, key).join(streak, key, "left").withColumn("streak", F.coalesce("streak", F.lit(0)).cast("bigint"))
    cols = ["n", "last", "last_success_at", "last_failure_at", "s", "c", "ms", "streak"]
    if state is None:
        return j.select(*key, *cols)
    j = j.join(old, key, "full_outer")
    decay = F.pow(F.lit(0.8), F.coalesce("n", F.lit(0)).cast("double"))
    added = lambda x: (F.coalesce(x, F.lit(0.0)) + F.coalesce(F.col(f"o_{x}").cast("double") * decay, F.lit(0.0))).alias(x)
    later = lambda x: F.greatest(x, f"o_{x}").alias(x)
    run = F.coalesce("streak", F.lit(0)) + F.when(F.col("_ok").isNull(), F.coalesce("o_streak", F.lit(0))).otherwise(0)
    return j.select(
        *key, (F.coalesce("n", F.lit(0)) + F.coalesce("o_n", F.lit(0))).alias("n"), F.coalesce("last", "o_last").alias("last"), later("last_success_at"), later("last_failure_at"),
        added("s"), added("c"), added("ms"), run.cast("bigint").alias("streak"))


def health_view(state: DataFrame) -> DataFrame:
    """Rates, label and pause of each provider, rounded for showing."""
    label = F.when(F.col("s") >= 0.7, "healthy").when(F.col("s") >= 0.3, "degraded").otherwise("unhealthy")
    off = F.when(F.col("streak") >= DISABLE_STREAK, F.col("last.checked_at") + F.make_dt_interval(mins=F.lit(DISABLE_MINUTES)))
    return state.select(
        *HEALTH_KEY, S.rnd(F.col("s"), 4).alias("success_rate"), S.rnd(F.col("c"), 4).alias("captcha_rate"), S.rnd(F.col("ms"), 0).alias("avg_duration_ms"),
        F.col("streak").alias("consecutive_failures"), label.alias("state"), "last_success_at", "last_failure_at", off.alias("disabled_until"))


def provider_health(checks: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Running health per tenant and provider after ``checks``, starting from a state of ``health_fold`` (or from rows that this
    function gave earlier, as exact as those are rounded)."""
    if state is not None and "success_rate" in state.columns:
        state = state.select(
            *HEALTH_KEY, F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("struct<checked_at: timestamp, check_id: bigint>").alias("last"), "last_success_at", "last_failure_at",
            F.col("success_rate").alias("s"), F.col("captcha_rate").alias("c"), F.col("avg_duration_ms").alias("ms"), F.col("consecutive_failures").alias("streak"))
    return health_view(health_fold(checks, state))


def excerpt(text, number, limit: int | None = None, before: int | None = None) -> Column:
    """Distinct lines with the tracking number masked; ``before`` and ``limit`` cut a window of characters around it."""
    lines = F.transform(F.split(col(text), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"[\s ]+", " ")))
    joined = F.array_join(F.array_distinct(F.filter(lines, lambda x: x != "")), "\n")
    no = F.trim(col(number))
    at = F.instr(F.lower(joined), F.lower(no))
    start = F.lit(0) if before is None else F.when(at - 1 > before, at - 1 - before).otherwise(0)
    window = joined if before is None and limit is None else F.substring(joined, start + 1, F.char_length(joined) if limit is None else F.lit(limit))
    masked = F.regexp_replace(window, F.concat(F.lit(r"(?i)\Q"), no, F.lit(r"\E")), F.lit("[TRACKING_NUMBER]"))
    return F.when(no == "", window).otherwise(masked)


# fixed pattern of lines worth showing
RELEVANT = r"(?i)label|information received|info received|in transit|customs|out for delivery|delivered|exception|returned|shipper|carrier|origin|destination|\b[A-Z]{2,3}\b"


def evidence(text, max_lines: int | None = None, max_chars: int | None = None) -> Column:
    lines = F.filter(F.transform(F.split(col(text), r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & x.rlike(ascii_edges(RELEVANT)))
    lines = F.array_distinct(lines)
    joined = F.array_join(lines if max_lines is None else F.slice(lines, 1, max_lines), " · ")
    return F.nullif(joined if max_chars is None else F.substring(joined, 1, max_chars), F.lit(""))


def available(configured: DataFrame, health: DataFrame, as_of) -> DataFrame:
    off = health.where(F.col("disabled_until") > F.lit(as_of)).select("org_id", "provider")
    return configured.join(off, ["org_id", "provider"], "left_anti")


def import_numbers(rows: DataFrame, existing: DataFrame) -> DataFrame:
    clean = rows.select("org_id", F.upper(F.regexp_replace("tracking_number", r"\s+", "")).alias("tracking_number")).where(F.col("tracking_number") != "").distinct()
    return append_if_absent(clean, existing, ["org_id", "tracking_number"])


PUBLIC_COLS = ["shipment_id", "org_id", "tracking_number", "display_name", "current_status", "previous_status", "last_checked_at", "next_check_at", "delivered_at", "updated_at"]


def public_shipments(shipments: DataFrame) -> DataFrame:
    return shipments.select(*[c for c in PUBLIC_COLS if c in shipments.columns])


def due_by_last_run(shipments: DataFrame, runs: DataFrame, as_of, minutes: int, k: int | None = None) -> DataFrame:
    """``runs``: shipment_id, run_id, status, created_at, completed_at."""
    newest = latest_per_key(runs, ["shipment_id"], ["status", "created_at", "completed_at"], ["created_at", "run_id"])
    open_ = shipments.where(F.col("tracking_enabled") & ~F.col("current_status").isin("delivered", "returned", "cancelled"))
    j = open_.select("shipment_id", "org_id").join(newest, "shipment_id", "left")
    busy = F.coalesce(F.col("status").isin("queued", "running"), F.lit(False))
    last = F.coalesce("completed_at", "created_at")
    due = j.where(~busy & (last.isNull() | (last <= F.lit(as_of) - F.make_dt_interval(mins=F.lit(minutes))))).select("shipment_id", "org_id", last.alias("last_run_at"))
    return due if k is None else due.orderBy(F.asc_nulls_first("last_run_at"), "shipment_id").limit(k)


def canonical_results(checks: DataFrame) -> DataFrame:
    hint = F.when(F.col("status") == "info_received", "registered").otherwise(F.col("status"))
    known = checks.where(F.col("provider").isin(SOURCES))
    return known.select(
        "check_id", F.col("provider").alias("source"), F.when(F.col("state").isin(SOURCE_STATES), F.col("state")).otherwise("error").alias("state"), "checked_at",
        F.when(hint.isin(STATUS_HINTS), hint).alias("status_hint"), F.trim(F.coalesce(F.nullif(F.trim("provider"), F.lit("")), F.lit("?"))).alias("label"),
        F.when(F.trim("excerpt") != "", F.col("excerpt")).alias("excerpt"),
    )


def route_facts(checks: DataFrame) -> DataFrame:
    """Origin and destination of a shipment from the first successful excerpt that names them."""
    def labelled(labels):
        return rf"(?iu)(?:^|\n)(?:{'|'.join(labels)}):?\s*\n([^\n]+)"
    order = F.struct("checked_at", "check_id")
    ok = checks.where((F.col("state") == "success") & F.col("excerpt").isNotNull())
    pick = lambda labels: F.nullif(F.regexp_extract("excerpt", labelled(labels), 1), F.lit(""))
    ok = ok.withColumns({"o": pick(["Origin country", "From address", "Откуда"]), "d": pick(["Destination country", "To address", "Куда"])})
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order))
    def fact(c):
        v = F.trim(first(c))
        return F.when(~v.rlike(r"(?i)^(?:-|—|unknown|not provided|n/a|null)$"), F.nullif(v, F.lit("")))
    return ok.groupBy("org_id", "shipment_id").agg(fact("o").alias("origin"), fact("d").alias("destination"))
