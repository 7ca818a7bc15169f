"""Drop lines that many documents share (operator 2). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, settled


def _without(lines: Column, drop: Column) -> Column:
    """The lines but those at the sorted zero-based positions ``drop``: the runs between them, in order, so linear in a long text."""
    runs = F.transform(drop, lambda p, i: F.slice(
        lines, F.when(i == 0, 1).otherwise(F.get(drop, i - 1) + 2), p - F.when(i == 0, 0).otherwise(F.get(drop, i - 1) + 1)))
    last = F.get(drop, F.size(drop) - 1)
    return F.concat(F.flatten(runs), F.slice(lines, last + 2, F.size(lines) - last - 1))


def drop_shared_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text",
                      carry: list[str] | None = None) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, and the columns named in ``carry``): each document without the lines that at least ``min_docs`` documents share.

    A line's key is the line, ASCII white space stripped, A-Z lower-cased; keys of fewer than ``min_chars`` code points
    never match. A shared key keeps its lines in the largest doc_id that holds it, all of them, and loses them elsewhere.
    Lines are exploded with position and a 128-bit key hash; documents per hash are counted after (hash, document) is made
    distinct, so a line found everywhere costs one partial count per task. What is dropped returns to its document as a
    list of positions, and the text is put together from the runs between them.

    Null or empty text: one empty line. Null doc_id: its lines neither count nor keep, but shared ones are dropped.
    Repeated rows: the same id counts once; every row comes back with its own text. Empty table: empty result. Other
    columns are ignored; a carried column called n_lines or n_dropped takes that name.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry or [])])
    base = base.withColumn("_t", F.xxhash64("text"))
    lines = base.select("doc_id", "_t", F.posexplode(F.split("text", "\n", -1)).alias("_p", "_line"))
    keyed = lines.where(F.char_length("_line") >= min_chars).withColumn("_k", ascii_lower(F.btrim("_line", F.lit(WHITE))))
    seen = keyed.where(F.char_length("_k") >= min_chars).select(
        "doc_id", "_t", "_p", F.xxhash64("_k").alias("_a"), F.xxhash64(F.lit(1), "_k").alias("_b"))
    shared = seen.where("doc_id is not null").select("_a", "_b", "doc_id").distinct().groupBy("_a", "_b").agg(
        F.count("doc_id").alias("_n"), F.max("doc_id").alias("_keeper")).where(F.col("_n") >= min_docs)
    # settled, so that the exchange stands right below the join and Spark can split a line that a third of the documents have
    shared = settled(shared)
    drop = seen.join(shared, ["_a", "_b"]).where("doc_id is null or doc_id < _keeper").groupBy(
        F.col("doc_id").alias("_d"), F.col("_t").alias("_dt")).agg(F.sort_array(F.collect_set("_p")).alias("_drop"))
    both = base.join(drop, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_dt")), "left")
    parts = F.split("text", "\n", -1)
    measured = {"n_lines": F.size(parts).cast("long"), "n_dropped": F.coalesce(F.size("_drop"), F.lit(0)).cast("long")}
    return both.select(
        "doc_id",
        F.when(F.col("_drop").isNull(), F.col("text")).otherwise(F.array_join(_without(parts, F.col("_drop")), "\n")).alias("text"),
        *[c.alias(name) for name, c in measured.items() if name not in {x.lower() for x in carry or []}],
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry or [])])
