"""Named views over the shared bases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ordered import latest_per_key
from ..sources.catalog import Tables
from .dashboard import org_dashboard, price_movers

LATEST = ["snapshot_id", "org_id", "price", "old_price", "currency", "availability", "status", "scraped_at"]

# SQL functions a user may want next to the views; the bodies stay native expressions
SQL_FUNCTIONS = {
    "trigrams": (
        "t STRING",
        "array_distinct(flatten(transform(filter(split(lower(t), '[^\\\\p{L}\\\\p{N}]+'), w -> w <> ''), "
        "w -> transform(sequence(1, length(w) + 1), i -> substring(concat('  ', w, ' '), i, 3)))))",
    ),
}


def create_views(t: Tables) -> None:
    latest_per_key(t.snapshots, ["listing_id"], LATEST).createOrReplaceTempView("v_latest_snapshot")
    org_dashboard(t).createOrReplaceTempView("v_org_dashboard")
    price_movers(t).createOrReplaceTempView("v_price_movers")


def create_functions(spark) -> None:
    for name, (args, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURN {body}")
