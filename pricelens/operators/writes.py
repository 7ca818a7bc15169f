"""Append-if-absent and upsert, as plans: the caller decides where the result is written."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Iterable[str], order: Iterable[str]) -> DataFrame:
    """Keep the first row of every key (partial aggregation, so repeated keys shrink before the shuffle)."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def append_if_absent(new: DataFrame, existing: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet (``new`` must already be unique by key)."""
    keys = list(keys)
    return new.join(existing.select(*keys), keys, "left_anti")


def upsert(current: DataFrame, changes: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Full-outer merge: columns of ``changes`` win where its row exists; other columns are kept."""
    keys = list(keys)
    c, n = current.alias("c"), changes.alias("n").withColumn("_hit", F.lit(True))
    joined = c.join(n.alias("n"), keys, "full_outer")
    cols = []
    for name in current.columns:
        if name in keys:
            cols.append(F.col(name))
        elif name in changes.columns:
            cols.append(F.when(F.col("n._hit"), F.col(f"n.{name}")).otherwise(F.col(f"c.{name}")).alias(name))
        else:
            cols.append(F.col(f"c.{name}"))
    return joined.select(*cols)
