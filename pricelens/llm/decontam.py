"""Find benchmark passages in documents (operator 8): a prefix-filtered set join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, settled, without

#: What lies between words once A-Z are lower-cased: all ASCII but digits and a-z.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows are broadcast while they take up to so many bytes; beyond, the same join shuffles.
BROADCAST_BYTES = 48 << 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), BREAKS), "")


def _shingles(w: Column, s: int) -> Column:
    """At each position the word and the s - 1 after it, as fields w0, w1, w2 (null beyond the end)."""
    return F.arrays_zip(*[(w if k == 0 else F.slice(w, k + 1, F.greatest(F.size(w) - k, F.lit(0)))).alias(f"w{k}") for k in range(s)])


def _hinted(df: DataFrame, bytes_: int) -> DataFrame:
    return F.broadcast(df) if bytes_ <= BROADCAST_BYTES else df


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """One row per item and window: item_id, s (words per shingle), len (words), sids (the shingles' hashes), grams (the shingles)."""
    w = items.select(F.col("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("n", F.size("w")).withColumn("s", F.least(F.lit(3), "n")).withColumn("len", F.least(F.lit(window), "n"))
    grams = F.transform(F.sequence(F.lit(1), F.col("n") - F.col("s") + 1), lambda i: F.slice("w", i, F.col("s")))
    w = w.withColumn("grams", grams).withColumn("start", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("len") + 1)))
    return w.select("item_id", "s", "len", F.slice("grams", F.col("start"), F.col("len") - F.col("s") + 1).alias("grams")).withColumn(
        "sids", F.transform("grams", lambda g: F.when(F.size(g) == 3, F.xxhash64(g[0], F.get(g, F.lit(1)), F.get(g, F.lit(2))))
                            .when(F.size(g) == 2, F.xxhash64(g[0], F.get(g, F.lit(1)))).otherwise(F.xxhash64(g[0]))))


def find_items(docs: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, n_words, n_hit, items): words of a document that lie in an occurrence of a window, and the items that have one.

    A window is ``window`` consecutive words of an item, or the whole item if it has fewer. Containment of a window is
    containment of its set of 3-word shingles at consecutive positions (1- or 2-word ones in items that short), at
    threshold 1, so one shingle is a necessary prefix: the one that is rarest in the documents. Documents are read once;
    of their shingles those stay that some item has (equal words, not only equal hashes). Their counts give the order;
    then documents join windows on the prefix shingle alone, windows that would begin before the text or end after it
    fall out by position and length, and the others are compared shingle by shingle over the window's own length.

    Null text: no words. Documents without words: zero counts. Null item_id: its windows hit, but it isn't listed.
    Repeated rows: one row per (doc_id, text). Repeated items: listed once. Empty tables: no hits, or no rows. Other
    columns are ignored.
    """
    wins = settled(item_windows(items.select("item_id", "text"), window).groupBy("s", "len", "sids").agg(
        F.first("grams").alias("grams"), F.sort_array(F.collect_set("item_id")).alias("ids")))
    facts = {r["s"]: r["b"] for r in wins.groupBy("s").agg(F.sum(F.size("sids") * 8 + F.size("ids") * 8 + 64).alias("b")).collect()}  # at most 3 rows
    size = sum(facts.values())
    w = docs.select("doc_id", F.xxhash64("text").alias("t"), words(F.coalesce(F.col("text"), F.lit(""))).alias("w"))
    found = None
    for s in sorted({3, *facts}):
        mine = wins.where(F.col("s") == s).select(F.explode("grams").alias("g")).distinct().select(
            *[F.col("g")[k].alias(f"g{k}") for k in range(s)])
        mine = mine.withColumn("sid", F.xxhash64(*[f"g{k}" for k in range(s)]))
        each = w.select("doc_id", "t", F.size("w").alias("n"), F.posexplode_outer(_shingles(F.col("w"), s)).alias("p", "x"))
        each = each.withColumn("h", F.xxhash64(*[F.col(f"x.w{k}") for k in range(s)]))
        same = F.col("h") == F.col("sid")
        for k in range(s):
            same &= F.col(f"x.w{k}") == F.col(f"g{k}")
        # the row of position 0, or of none, stays for every document: it carries the number of words
        hit = each.join(_hinted(mine, size), same, "left").where("sid is not null or p is null or p = 0").select(
            "doc_id", "t", "n", F.lit(s).alias("s"), F.when(F.col("sid").isNotNull(), F.struct("p", "sid")).alias("ps"))
        found = hit if found is None else found.unionByName(hit)
    # per document and shingle length, the hits in order of position
    marks = settled(found.groupBy("doc_id", "t", "s").agg(F.max("n").alias("n"), F.sort_array(F.collect_set("ps")).alias("hits")))
    rarity = marks.select(F.explode("hits.sid").alias("sid")).groupBy("sid").agg(F.count(F.lit(1)).alias("f"))
    order = wins.select("s", "len", "sids", F.posexplode("sids").alias("j", "sid")).join(rarity, "sid", "left")
    prefix = order.groupBy("s", "len", "sids").agg(
        F.min(F.coalesce("f", F.lit(0))).alias("least"), F.min_by(F.struct("sid", "j"), F.struct("f", "j")).alias("rare")).where("least > 0")
    prefix = prefix.join(wins.select("s", "len", "sids", "ids"), ["s", "len", "sids"]).select(
        F.col("s").alias("ws"), "len", "sids", "ids", F.col("rare.sid").alias("rare"), F.col("rare.j").alias("j"))
    m, first = F.size("sids"), F.col("k") - F.col("j")
    cand = marks.where(F.size("hits") > 0).select("doc_id", "t", "s", "hits", F.posexplode("hits").alias("k", "at"))
    cand = cand.join(_hinted(prefix, size), (F.col("at.sid") == F.col("rare")) & (F.col("s") == F.col("ws")))
    cand = cand.where((first >= 0) & (first + m <= F.size("hits")))
    cand = cand.where((F.get("hits.p", first + m - 1) - F.get("hits.p", first) == m - 1) & (F.slice("hits.sid", first + 1, m) == F.col("sids")))
    spans = cand.select("doc_id", "t", "ids", (F.col("at.p") - F.col("j")).alias("b"), "len")
    per = spans.groupBy(F.col("doc_id").alias("d"), F.col("t").alias("dt")).agg(
        F.sort_array(F.collect_set(F.struct("b", (F.col("b") + F.col("len")).alias("e")))).alias("iv"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"))
    covered = F.aggregate("iv", F.struct(F.lit(0).alias("n"), F.lit(0).alias("e")), lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["b"], a["e"]))).alias("n"), F.greatest(a["e"], x["e"]).alias("e")), lambda a: a["n"])
    per = per.select("d", "dt", covered.alias("n_hit"), "items")
    all_docs = marks.where(F.col("s") == 3).select("doc_id", "t", "n")
    return all_docs.join(per, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("t").eqNullSafe(F.col("dt")), "left").select(
        "doc_id", F.col("n").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), "t")


def contaminated(n_words: Column, n_hit: Column) -> Column:
    """At least a twentieth of the words lie in benchmark windows."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns, whatever these are called.

    A contaminated row goes with all its repetitions; null doc_ids are compared like others. Null or empty text: stays. Empty tables:
    ``docs`` as it is.
    """
    found = find_items(docs, items, window)
    return without(docs, found.where(contaminated(F.col("n_words"), F.col("n_hit"))).select("doc_id", "t"))
