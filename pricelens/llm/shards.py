"""Shards of near equal bytes by a k-d tree over document metadata (operator 5)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled

#: A coordinate is 24 bits: 10 of the dimension's value, 14 of the text's hash for ties; a median is found in two passes of 12 bits.
VALUE_BITS, TIE_BITS, PASS_BITS = 10, 14, 12
DIMS = ("length", "source", "lang")
#: Buckets within a shard for numbering its rows.
SLOT_BUCKETS = 512


@dataclass
class Node:
    path: str
    dim: str
    cut: int  # the first coordinate of the right side


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the 128-bit key of the text, and the metadata as numbers from 0 to 1."""
    text = F.col("text")
    code = lambda c: F.crc32(F.coalesce(F.col(c), F.lit("")).cast("binary")) / F.lit(float(2**32))
    return docs.select(
        F.col("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("a"), F.xxhash64(F.lit(1), F.coalesce(text, F.lit(""))).alias("b"),
        (F.log2(F.coalesce(F.octet_length(text), F.lit(0)) + 1.0) / 31).alias("length"), code("source").alias("source"), code("lang").alias("lang"))


def _coordinate(dim: str, low: Column, high: Column, heavy: Column) -> Column:
    """Value within the node's range, then the text's hash; a group heavier than a tenth of a leaf goes first, so that no cut falls into the middle of it."""
    span = F.when(high > low, high - low).otherwise(F.lit(1.0))
    value = F.least(F.floor((F.col(dim) - low) / span * (2**VALUE_BITS - 1)).cast("long") + 1, F.lit(2**VALUE_BITS - 1))
    tie = F.shiftrightunsigned(F.col("b"), 64 - TIE_BITS)
    return F.shiftleft(F.when(heavy, F.lit(0).cast("long")).otherwise(value), TIE_BITS).bitwiseOR(tie)


def plan(groups: DataFrame, levels: int) -> tuple[DataFrame, list[Node]]:
    """The groups with their leaf's path ('0'/'1' per level), and the cuts.

    Per level, for all its nodes at once: one aggregation finds each dimension's weighted variance against the root's and
    so the widest; two more find the weighted median as sums over 4096 bins of the coordinate, first of its upper, then of
    its lower bits. What comes to the driver is at most 2**level * 4096 sums, whatever the input.
    """
    leaf = groups.agg(F.sum("size")).first()[0] or 0
    heavy = F.col("size") * 10 * 2**levels > F.lit(leaf)
    now = groups.withColumn("path", F.lit(""))
    root: dict[str, float] = {}
    nodes: list[Node] = []
    for level in range(levels):
        stats = [F.sum("size").alias("w")]
        for d in DIMS:
            stats += [F.min(d).alias(f"{d}_lo"), F.max(d).alias(f"{d}_hi"), F.sum(F.col(d) * F.col("size")).alias(f"{d}_1"), F.sum(F.col(d) * F.col(d) * F.col("size")).alias(f"{d}_2")]
        found = {r["path"]: r for r in now.groupBy("path").agg(*stats).collect()}
        if not found:
            break
        spread = {p: {d: max(0.0, r[f"{d}_2"] / r["w"] - (r[f"{d}_1"] / r["w"]) ** 2) for d in DIMS} for p, r in found.items()}
        root = root or spread[""]
        widest = {p: max(DIMS, key=lambda d: (s[d] / root[d] if root[d] > 0 else 0.0)) for p, s in spread.items()}
        at = None
        for p in sorted(found):
            d = widest[p]
            here = _coordinate(d, F.lit(found[p][f"{d}_lo"]), F.lit(found[p][f"{d}_hi"]), heavy)
            at = F.when(F.col("path") == p, here) if at is None else at.when(F.col("path") == p, here)
        now = now.withColumn("at", at)
        shift = VALUE_BITS + TIE_BITS - PASS_BITS
        done: dict[str, float] = {p: 0.0 for p in found}
        prefix: dict[str, int] = {p: 0 for p in found}
        cuts: dict[str, int] = {}
        for last in (False, True):
            bins = now
            if last:
                keep = F.lit(False)
                for p in found:
                    keep |= (F.col("path") == p) & (F.shiftright("at", shift) == prefix[p])
                bins = now.where(keep)
            bin_ = F.col("at").bitwiseAND(2**shift - 1) if last else F.shiftright("at", shift)
            sums: dict[str, list[tuple[int, int]]] = {p: [] for p in found}
            for r in bins.groupBy("path", bin_.alias("bin")).agg(F.sum("size").alias("w")).collect():
                sums[r["path"]].append((r["bin"], r["w"]))
            for p, each in sums.items():
                half, before = found[p]["w"] / 2, done[p]
                for b, w in sorted(each):
                    if before + w >= half:
                        break
                    before += w
                if not last:
                    done[p], prefix[p] = before, b
                else:  # the nearer of the two bounds of the bin that holds the middle
                    cuts[p] = (prefix[p] << shift) + b + (1 if before + w - half < half - before else 0)
        right = F.lit("")
        for p in sorted(found):
            nodes.append(Node(p, widest[p], cuts[p]))
            right = F.when(F.col("path") == p, F.when(F.col("at") >= cuts[p], "1").otherwise("0")).otherwise(right)
        now = settled(now.withColumn("path", F.concat("path", right)).drop("at"))
    return now, nodes


def kd_shards(docs: DataFrame, levels: int = 4) -> tuple[DataFrame, list[Node]]:
    """(doc_id, size, text_crc32, shard, slot) for 2**levels shards of near equal bytes, and the tree.

    Size: UTF-8 bytes of the text (null: none) plus 1. Equal texts stay together: the tree is built over distinct texts
    with the bytes of all their copies, and the metadata of the copy with the smallest doc_id. Dimensions: log of the
    length, source and language (each as a number from its checksum); nulls count as the empty string. Nodes are split at
    the weighted median along the dimension with the widest weighted spread; leaves are all at the same depth, so the
    target is the total over 2**levels. Ties in a dimension are broken by the text's hash. A text whose copies weigh more
    than a shard should makes its shard larger.

    slot numbers a shard's rows from 0 without gaps: rows are numbered within 512 hashed buckets of the shard, and the
    counts of the buckets before are added. Repeated rows stay and get slots of their own. Empty table: empty result.
    """
    base = settled(sized(docs))
    groups = settled(base.groupBy("a", "b").agg(
        F.sum("size").alias("size"), *[F.min_by(d, "doc_id").alias(d) for d in DIMS]).fillna(0.0, list(DIMS)))
    leaves, nodes = plan(groups, levels)
    shard = F.conv(F.col("path"), 2, 10).cast("int")
    placed = base.select("doc_id", "size", "text_crc32", "a", "b").join(leaves.select("a", "b", shard.alias("shard")), ["a", "b"])
    return numbered(placed), nodes


def numbered(placed: DataFrame) -> DataFrame:
    """Adds slot. The buckets' counts are at most 512 a shard, so their broadcast has a fixed bound."""
    from pyspark.sql import Window

    rows = placed.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "a"), F.lit(SLOT_BUCKETS)).alias("bucket"))
    rows = settled(rows)
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("shard", "bucket", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("own", own).join(F.broadcast(counts), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("own") - 1).cast("long").alias("slot"))
