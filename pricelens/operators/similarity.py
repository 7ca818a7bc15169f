"""Set-similarity join on trigram sets: prefix filter on rare grams, then an exact check.

Two sets can only reach Jaccard ``t`` if they share one of their ``n - ceil(t*n) + 1`` rarest grams, so only
those grams are joined on.  Work is done on distinct titles; rows are attached by the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trigram_similarity, trigrams


def distinct_titles(df: DataFrame, title: str) -> DataFrame:
    return df.where(F.col(title).isNotNull()).select("org_id", F.col(title).alias("title")).distinct()


def _prefixes(titles: DataFrame, frequency: DataFrame, threshold: float) -> DataFrame:
    grams = titles.select("org_id", "title", F.explode(trigrams("title")).alias("gram"))
    ranked = grams.join(frequency, ["org_id", "gram"]).groupBy("org_id", "title").agg(
        # at most one entry per trigram of one title
        F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("g"),
    )
    n = F.size("g")
    keep = n - F.ceil(F.lit(threshold) * n).cast("int") + 1
    return ranked.select("org_id", "title", n.alias("n"), F.explode(F.slice("g", 1, F.least(keep, n))).alias("e")).select("org_id", "title", "n", F.col("e.gram").alias("gram"))


def similar_titles(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs of distinct titles of one tenant with trigram similarity of at least ``threshold``.

    ``left`` and ``right`` hold (org_id, title).
    """
    both = left.unionByName(right).distinct().select("org_id", F.explode(trigrams("title")).alias("gram"))
    frequency = both.groupBy("org_id", "gram").agg(F.count(F.lit(1)).alias("df"))
    a = _prefixes(left, frequency, threshold).select("org_id", "gram", F.col("title").alias("left_title"), F.col("n").alias("ln"))
    b = _prefixes(right, frequency, threshold).select("org_id", "gram", F.col("title").alias("right_title"), F.col("n").alias("rn"))
    sizes = (F.col("rn") >= F.ceil(F.col("ln") * threshold)) & (F.col("ln") >= F.ceil(F.col("rn") * threshold))
    cand = a.join(b, ["org_id", "gram"]).where(sizes).select("org_id", "left_title", "right_title").distinct()
    scored = cand.withColumn("similarity", trigram_similarity("left_title", "right_title"))
    return scored.where(F.col("similarity") >= threshold)
