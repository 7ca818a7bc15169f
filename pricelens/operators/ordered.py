"""Order-dependent operators that stay parallel when one key holds a large share of the rows.

``lag`` needs every row of a key in order, which a plain window puts into one task.  A key with more
than ``hot_rows`` rows is therefore cut into time slices.  Each slice is windowed on its own and its
first row takes the value carried over from the slice before it.  Keys below the limit have exactly
one slice, so for them the plan is an ordinary window.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SNAPSHOT_ORDER = ("scraped_at", "snapshot_id")
DEFAULT_HOT_ROWS = 2_000_000


def hot_rows_setting(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.pricelens.hotRows", str(DEFAULT_HOT_ROWS)))


def hot_key_slices(sizes: DataFrame, key: str, ts: str, hot_rows: int) -> DataFrame:
    """Keys with more than ``hot_rows`` rows, their time span and number of slices.

    The result has fewer than ``rows / hot_rows`` rows, which bounds its broadcast.
    """
    micros = F.unix_micros(F.col(ts))
    return (
        sizes.groupBy(F.col(key).alias("_hot_key"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min(micros).alias("_lo"), F.max(micros).alias("_hi"))
        .where(F.col("_n") > hot_rows)
        .select(
            "_hot_key",
            "_lo",
            (F.col("_hi") - F.col("_lo") + 1).cast("double").alias("_span"),
            F.ceil(F.col("_n") / hot_rows).cast("int").alias("_slices"),
        )
    )


def slice_hot_keys(df: DataFrame, hot: DataFrame, key: str, ts: str) -> DataFrame:
    """Add the window partition ``_part`` (key and time slice) and the flags the carry-over needs."""
    micros = F.unix_micros(F.col(ts))
    position = F.floor((micros - F.col("_lo")) / F.col("_span") * F.col("_slices")).cast("int")
    sliced = (
        df.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
        .withColumn("_slice", F.coalesce(F.greatest(F.lit(0), F.least(position, F.col("_slices") - 1)), F.lit(0)))
        .withColumn("_hot", F.col("_slices").isNotNull())
        .drop("_hot_key", "_lo", "_span", "_slices")
    )
    # a struct key: the exchange below must not be skipped because of an earlier one on ``key`` alone
    return sliced.withColumn("_part", F.struct(F.col(key).alias("k"), F.col("_slice").alias("s")))


def with_previous(
    df: DataFrame,
    values: Mapping[str, str],
    key: str = "listing_id",
    order: Iterable[str] = SNAPSHOT_ORDER,
    sizes: DataFrame | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Add ``{new: source}`` columns with the value of the row before, per ``key`` in ``order``.

    ``sizes`` may name a cheaper frame that holds at least the rows of ``df`` (it only decides how many
    slices a key gets, never the result).
    """
    order = list(order)
    ts = order[0]
    hot_rows = hot_rows or hot_rows_setting(df)
    hot = hot_key_slices(df if sizes is None else sizes, key, ts, hot_rows)
    sliced = slice_hot_keys(df, hot, key, ts)
    within = Window.partitionBy("_part").orderBy(*order)
    seq = sliced.withColumn("_first", F.row_number().over(within) == 1)
    for new, source in values.items():
        seq = seq.withColumn(new, F.lag(source).over(within))

    tails = (
        sliced.where("_hot")
        .groupBy(F.col(key).alias("_k"), F.col("_slice").alias("_s"))
        .agg(F.max_by(F.struct(*[F.col(s).alias(n) for n, s in values.items()]), F.struct(*order)).alias("_tail"))
    )
    chain = Window.partitionBy("_k").orderBy("_s")
    # joined on the window's own partitioning, so the long side is not moved again
    carried = tails.select(F.struct(F.col("_k").alias("k"), F.col("_s").alias("s")).alias("_part"), F.lag("_tail").over(chain).alias("_carry"))
    out = seq.join(carried, "_part", "left")
    for new in values:
        out = out.withColumn(new, F.when(F.col("_first"), F.col(f"_carry.{new}")).otherwise(F.col(new)))
    return out.drop("_carry", "_first", "_slice", "_hot", "_part")


def carry_forward(
    df: DataFrame,
    values: Mapping[str, str],
    key: str = "listing_id",
    order: Iterable[str] = SNAPSHOT_ORDER,
    sizes: DataFrame | None = None,
    hot_rows: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Add ``{new: source}`` with the last non-null source strictly before each row (as-of lookup).

    Hot keys are cut into slices like in ``with_previous``; not where ``rows``, an upper bound of the rows of ``df``, rules them out.
    """
    order = list(order)
    if rows is not None and rows <= (hot_rows or hot_rows_setting(df)):
        before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({new: F.last(source, ignorenulls=True).over(before) for new, source in values.items()})
    hot_rows = hot_rows or hot_rows_setting(df)
    hot = hot_key_slices(df if sizes is None else sizes, key, order[0], hot_rows)
    seq = sliced = slice_hot_keys(df, hot, key, order[0])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    for new, source in values.items():
        seq = seq.withColumn(new, F.last(source, ignorenulls=True).over(within))
    known = lambda c, then: F.when(F.col(c).isNotNull(), then)
    tails = (
        sliced.where("_hot")
        .groupBy(F.col(key).alias("_k"), F.col("_slice").alias("_s"))
        .agg(*[F.max_by(known(s, F.col(s)), known(s, F.struct(*order))).alias(f"_t_{n}") for n, s in values.items()])
    )
    chain = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(F.struct(F.col("_k").alias("k"), F.col("_s").alias("s")).alias("_part"), *[F.last(f"_t_{n}", ignorenulls=True).over(chain).alias(f"_c_{n}") for n in values])
    out = seq.join(carried, "_part", "left")
    for new in values:
        out = out.withColumn(new, F.coalesce(new, f"_c_{new}"))
    return out.drop("_slice", "_hot", "_part", *[f"_c_{n}" for n in values])


def latest_per_key(df: DataFrame, keys: Iterable[str], cols: Iterable[str], order: Iterable[str] = SNAPSHOT_ORDER) -> DataFrame:
    """Newest row per key by partial aggregation: every task combines its rows, so hot keys shrink before the shuffle.

    Struct buffers make Spark sort within the task; that sort is local and can spill.
    """
    keys, cols, order = list(keys), [c for c in cols], list(order)
    rest = [c for c in cols if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def top_k(df: DataFrame, keys: Iterable[str], order: Iterable[Column], k: int | None, rank: str | None = None) -> DataFrame:
    """At most ``k`` rows per key, all without ``k``.  Spark cuts each task's input to ``k`` rows per key before the shuffle."""
    if k is None and rank is None:
        return df
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = out if k is None else out.where(F.col(name) <= k)
    return out.withColumn(name, F.col(name).cast("bigint")) if rank else out.drop(name)
