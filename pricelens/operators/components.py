"""Connected components over shared keys, as rounds of grouped minima with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def components(row_keys: DataFrame, row: str = "row_id", key: str = "key", max_rounds: int = 60) -> DataFrame:
    """(row, component) for rows linked through equal keys; the component is the smallest row id in it.

    A round is two aggregations with map-side combine and two joins, so a key shared by very many rows costs
    one partial minimum per task.  The state is checkpointed every round: the plan stays flat and a lost
    executor does not replay earlier rounds.
    """
    spark = row_keys.sparkSession
    checkpoint_dir(spark)
    pairs = row_keys.select(F.col(row).alias("r"), F.col(key).alias("k")).distinct()
    shared = pairs.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("k")
    links = pairs.join(shared, "k", "left_semi").checkpoint()
    labels = links.select("r").distinct().withColumn("c", F.col("r")).checkpoint()
    for _ in range(max_rounds):
        per_key = links.join(labels, "r").groupBy("k").agg(F.min("c").alias("m"))
        best = links.join(per_key, "k").groupBy("r").agg(F.min("m").alias("m"))
        step = labels.join(best, "r").select("r", F.least("c", "m").alias("m"), F.col("c").alias("old"))
        # pointer jumping: take over the label of the row the label names
        jump = labels.select(F.col("r").alias("m"), F.col("c").alias("m2"))
        nxt = step.join(jump, "m", "left").select("r", F.least("m", "m2").alias("c"), "old").checkpoint()
        moved = nxt.where(F.col("c") != F.col("old")).limit(1).count()
        labels = nxt.select("r", "c")
        if not moved:
            break
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    every = row_keys.select(F.col(row).alias("r")).distinct()
    return every.join(labels, "r", "left").select(F.col("r").alias(row), F.coalesce("c", "r").alias("component"))
